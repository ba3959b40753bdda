"""Checksums and tables of MPEG audio, and line dedup under both ways of counting pages."""

import random
import struct

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexlode.llm import line_dedup, mpeg_audio as M
from tests.duck import rows


def division(bits):
    """The checksum of a list of bits, bit by bit."""
    c = 0xFFFF
    for b in bits:
        top = (c >> 15) ^ b
        c = (c << 1) & 0xFFFF
        if top:
            c ^= 0x8005
    return c


def bits_of(data):
    return [x >> (7 - i) & 1 for x in data for i in range(8)]


def frame(header, body):
    """A frame of the header with body's bits behind its checksum, which covers the first n."""
    f = M.frame_of(header)
    return f, header, body[: f[0] - 6]


@pytest.mark.parametrize("mode", [0x00, 0x40, 0x50, 0x70, 0xC0])
@pytest.mark.parametrize("second", [0xFC, 0xFE, 0xF4])  # MPEG 1 Layer II, Layer I, MPEG 2 Layer II; each with a checksum
def test_checksums_of_all_layers(second, mode):
    r, out = random.Random(second * mode), b""
    for _ in range(5):
        header = bytes((0xFF, second, 0xA4, mode))
        f = M.frame_of(header)
        body = bytes(r.randrange(256) for _ in range(f[0] - 6))
        bits, channels = bits_of(body), f[3]
        bound = 4 * ((mode >> 4 & 3) + 1) if mode >> 6 == 1 else 32 * (channels == 2)
        if f[6] == 1:
            n = sum(4 * (2 if band < bound else 1) for band in range(32))
        else:
            table, n, chosen = M.allocation(f[2], f[4], channels, f[5]), 0, 0
            for band, size in enumerate(table):
                for _ in range(2 if band < bound else 1):
                    chosen += any(bits[n : n + size]) * (channels if channels == 2 and band >= bound else 1)
                    n += size
            n += 2 * chosen
        out += header + struct.pack(">H", division(bits_of(header[2:]) + bits[:n])) + body
    good = M.read_audio(out)
    assert good["frames"] == 5 and good["bad_crc"] == 0 and good["samples"] == 5 * f[1]
    broken = bytearray(out)
    broken[good["offsets"][2] + 7] ^= 16
    assert M.read_audio(bytes(broken))["bad_crc"] == 1


def test_tables():
    r = M.read_audio(M.write_audio(b"x" * 5000))
    n = len(r["offsets"])
    assert r["stated_frames"] == n == 9 and r["stated_bytes"] == 10 * M.FRAME and len(r["table_points"]) == 100
    assert all(abs(p - (r["offsets"][0] + i * n * M.FRAME / 100)) <= r["stated_bytes"] / 256 + 1 for i, p in enumerate(r["table_points"]))
    plain = M.OPEN_HEADER + bytes(M.FRAME - 4)
    vbri = bytearray(M.OPEN_HEADER + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4 * M.FRAME, 3, 3, 2, 2, 1) + struct.pack(">HHH", M.FRAME // 2, M.FRAME // 2, M.FRAME // 2))
    r = M.read_audio(bytes(vbri).ljust(M.FRAME, b"\0") + plain * 3)
    assert (r["table"], r["stated_frames"], r["stated_bytes"], r["table_points"]) == ("VBRI", 3, 4 * M.FRAME, [0, M.FRAME, 2 * M.FRAME]) and r["frames"] == 3


@pytest.mark.parametrize("distinct_pages", [True, False])
def test_line_dedup_against_sql(spark, distinct_pages):
    r = random.Random(9)
    docs = [(i, r.choice((None, "a", "b")), r.choice((None, "", f"own {i}\n shared here \n\nx{i}", f"own {i}\nshared here", "the same page\nin whole", f"only {i}"))) for i in range(300)]
    frame = pd.DataFrame(docs, columns=["doc_id", "source", "text"])
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("_dropped", F.lit("x"))
    got = line_dedup.drop_boilerplate(df, ratio=line_dedup.RATIO, distinct_pages=distinct_pages).withColumnRenamed("_dropped", "n_dropped").drop("source").toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    assert rows(got) == rows(con.execute(line_dedup.oracle_sql(distinct_pages)).df()) and got.n_dropped.sum() > 50
    assert (got[got.text == ""].n_dropped > 0).any() != distinct_pages
