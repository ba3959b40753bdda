"""Media columns holding MPEG audio: a writer, and a reader that resynchronises, checks and indexes frames.

`write_audio` stores bytes as the ancillary data of silent Layer III frames, 576 to a frame, each with its CRC, behind
an ID3v2 tag (with the number of bytes) and a frame with a variable-bitrate table. `read_audio` takes any MPEG 1, 2 or
2.5 stream of layers I to III: it parses ID3v1, ID3v2, Xing, Info and VBRI (frames, bytes and seek points), follows frame headers,
searches for the next pair of fitting headers where one is broken, verifies the checksums of all layers, and gives exact samples
and every frame's offset.

Null and empty texts give one frame of 255s. Null media gives null features. Repeated rows give equal values. Other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Fixed values of the format: bitrates in kbit/s by (MPEG 1, layer), sampling rates by version bits, samples of a frame by (MPEG 1, layer).
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}

#: Fixed values of Layer II: bits of each subband's allocation, by table (the letters of the standard's; "l" is that of MPEG 2).
ALLOCATION = {"a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10, "l": (4,) * 4 + (3,) * 7 + (2,) * 19}

UNIT = 576
#: MPEG 1, Layer III, 192 kbit/s, 44.1 kHz, one channel: 626 bytes a frame; with a CRC, and without.
HEADER, OPEN_HEADER = bytes((0xFF, 0xFA, 0xB0, 0xC4)), bytes((0xFF, 0xFB, 0xB0, 0xC4))
FRAME, SIDE = 626, 17
DATA_AT = 4 + 2 + SIDE
TAG_KEY = "hexlode_bytes"


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16 of the first bits of data."""
    c = crc16(data[: bits // 8])
    for i in range(bits // 8 * 8, bits):
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (data[i // 8] >> (7 - i % 8) & 1) else 0)
    return c


@lru_cache(maxsize=4096)
def allocation(hz: int, kbps: int, channels: int, version: str) -> tuple[int, ...]:
    """Bits of each subband's allocation in a Layer II frame."""
    each = kbps // channels
    if version != "1":
        return ALLOCATION["l"]
    if hz == 48000:
        return ALLOCATION["a" if each >= 56 else "c"]
    return ALLOCATION["b" if each >= 96 else "a" if each >= 56 else "d" if hz == 32000 else "c"]


def protected_bits(frame: bytes, f: tuple) -> int:
    """How many bits behind a frame's checksum it covers: side information, or allocations and (Layer II) the choice of scale factors."""
    _, _, hz, channels, kbps, version, layer, _, side = f
    if layer == 3:
        return 8 * side
    bound = (frame[3] >> 4 & 3) * 4 + 4 if frame[3] >> 6 == 1 else 32 * (channels == 2)  # subbands from there on share their allocation
    if layer == 1:
        return 4 * (32 + bound)
    value, at = int.from_bytes(frame[6:], "big"), 8 * (len(frame) - 6)
    table, chosen = allocation(hz, kbps, channels, version), 0
    for band, bits in enumerate(table):
        for _ in range(2 if band < bound else 1):
            at -= bits
            if at < 0:
                return 0
            chosen += (value >> at & ((1 << bits) - 1) > 0) * (channels if band >= bound else 1)
    return 8 * (len(frame) - 6) - at + 2 * chosen


@lru_cache(maxsize=4096)
def frame_of(header: bytes) -> tuple | None:
    """(length, samples, rate, channels, kbit/s, version, layer, has a CRC, bytes of side information); None if it is no header."""
    if len(header) < 4 or header[0] != 0xFF or header[1] & 0xE0 != 0xE0:
        return None
    version, layer = header[1] >> 3 & 3, 4 - (header[1] >> 1 & 3)
    bits, rate = header[2] >> 4, header[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or header[3] & 3 == 2:
        return None
    first = version == 3
    kbps, hz, pad = BITRATES[first, layer][bits], RATES[version][rate], header[2] >> 1 & 1
    samples = SAMPLES[first, layer]
    length = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    mono = header[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if first else (9 if mono else 17)
    return length, samples, hz, 1 if mono else 2, kbps, VERSIONS[version], layer, not header[1] & 1, side


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def write_audio(data: bytes) -> bytes:
    """data, padded with 255 to a positive multiple of 576, as an MPEG audio stream."""
    payload = np.frombuffer(padded(data), dtype=np.uint8).reshape(-1, UNIT)
    n = len(payload)
    frames = np.zeros((n, FRAME), dtype=np.uint8)
    crc = crc16(HEADER[2:] + bytes(SIDE))
    frames[:, :6] = np.frombuffer(HEADER + struct.pack(">H", crc), dtype=np.uint8)
    frames[:, DATA_AT : DATA_AT + UNIT] = payload
    text = b"\x00" + TAG_KEY.encode() + b"\x00" + str(len(data)).encode()
    tag = b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    toc = bytes(min(255, int(256 * (FRAME + i * n * FRAME / 100) / ((n + 1) * FRAME))) for i in range(100))
    table = b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc
    head = (OPEN_HEADER + bytes(SIDE) + table).ljust(FRAME, b"\x00")
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + head + frames.tobytes()


def _id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """Where the audio begins, and the tag's user texts."""
    at, texts = 0, {}
    while data[at : at + 3] == b"ID3" and len(data) >= at + 10 and max(data[at + 6 : at + 10]) < 128:
        a, b, c, d = data[at + 6 : at + 10]
        end = at + 10 + (a << 21 | b << 14 | c << 7 | d)
        p = at + 10
        while p + 10 <= min(end, len(data)) and re.fullmatch(rb"[A-Z0-9]{4}", data[p : p + 4]):
            raw = data[p + 4 : p + 8]
            size = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[at + 3] == 4 else int.from_bytes(raw, "big")
            if data[p : p + 4] == b"TXXX" and size > 1:
                key, _, value = data[p + 11 : p + 10 + size].partition(b"\x00")
                texts[key.decode("latin-1")] = value.decode("latin-1")
            p += 10 + size
        at = end + (10 if data[at + 5] & 16 else 0)
    return at, texts


def _table(frame: bytes, side: int, crc: bool) -> tuple[str, int | None, int | None, list[int]] | None:
    """The kind of a variable-bitrate table, the frames and bytes it states, and its seek points in bytes from its frame on; None if the frame is none."""
    number = lambda at, n=4: int.from_bytes(frame[at : at + n], "big")
    for at in {4 + side, 4 + side + 2 * crc}:
        if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
            flags, p, stated = number(at + 4), at + 8, [None, None]
            for k in (0, 1):
                if flags & 1 << k:
                    stated[k], p = number(p), p + 4
            toc = list(frame[p : p + 100]) if flags & 4 and len(frame) >= p + 100 else []
            return frame[at : at + 4].decode(), stated[0], stated[1], [x * stated[1] // 256 for x in toc] if stated[1] is not None else []
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        points, scale, size, offset, at = number(54, 2), number(56, 2), number(58, 2), 0, 62
        seek = []
        for k in range(points if 1 <= size <= 4 and len(frame) >= at + points * size else 0):
            seek.append(offset)
            offset += number(at + k * size, size) * scale
        return "VBRI", number(50), number(46), seek
    return None


def _next_sync(data: bytes, at: int, end: int) -> int:
    """The next place with a header whose frame ends at another header of the same kind, or at the end; end if there is none."""
    while 0 <= (at := data.find(b"\xff", at, end)):
        if (f := frame_of(data[at : at + 4])) and at + f[0] <= end:
            after = frame_of(data[at + f[0] : at + f[0] + 4])
            if at + f[0] == end or after and after[2] == f[2] and after[5:7] == f[5:7]:
                return at
        at += 1
    return end


def read_audio(data: bytes) -> dict:
    """The payload of this package's frames, and what the stream's frames say; broken stretches are skipped and counted.

    TAG 128 bytes from the end begins an ID3v1 tag unless frames can be followed over it to the very end.
    """
    at, texts = _id3v2(data)
    if len(data) - at >= 128 and data[-128:-125] == b"TAG":
        r, whole = _followed(data, at, len(data), texts)
        return r if whole else _followed(data, at, len(data) - 128, texts)[0]
    return _followed(data, at, len(data), texts)[0]


def _followed(data: bytes, at: int, end: int, texts: dict[str, str]) -> tuple[dict, bool]:
    """What the frames up to end say, and whether the last one ends there."""
    whole = -1
    offsets, parts, rates = [], [], set()
    samples = bad = resyncs = 0
    kind, stated, size, points, first = "none", None, None, [], None
    while at < end:
        f = frame_of(data[at : at + 4])
        if f is None or at + f[0] > end:
            resyncs, at = resyncs + 1, _next_sync(data, at + (f is not None), end)
            continue
        length, n, hz, channels, kbps, version, layer, crc, side = f
        if first is None:
            first = f
            if layer == 3 and (found := _table(data[at : at + length], side, crc)):
                kind, stated, size, points = found
                points = [at + x for x in points]
                at = whole = at + length
                continue
        if crc:
            bits = protected_bits(data[at : at + (6 if layer == 3 else length)], f)
            if int.from_bytes(data[at + 4 : at + 6], "big") != crc16_bits(data[at + 2 : at + 4] + data[at + 6 : at + 7 + bits // 8], 16 + bits):
                bad += 1
                if (again := _next_sync(data, at, end)) != at:
                    resyncs, at = resyncs + 1, again
                    continue
        offsets.append(at)
        samples += n
        rates.add(kbps)
        if length == FRAME and crc:
            parts.append(data[at + DATA_AT : at + DATA_AT + UNIT])
        at = whole = at + length
    return {
        "payload": b"".join(parts), "n_bytes": int(texts[TAG_KEY]) if texts.get(TAG_KEY, "").isdigit() else None, "frames": len(offsets), "samples": samples,
        "sample_rate": first[2] if first else None, "channels": first[3] if first else None, "version": first[5] if first else None, "layer": first[6] if first else None,
        "kbps": sorted(rates), "table": kind, "stated_frames": stated, "stated_bytes": size, "table_points": points, "bad_crc": bad, "resyncs": resyncs, "offsets": offsets, "id3v1": end < len(data),
    }, whole == end


@F.pandas_udf(T.BinaryType())
def _stored(text: pd.Series) -> pd.Series:
    return text.map(lambda t: write_audio((t or "").encode()), na_action=None)


_LONGS = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "frames", "samples", "sample_rate", "bad_crc", "resyncs")
_STRINGS = ("payload_sha256", "media_sha256", "feature")
FEATURES = T.StructType(
    [T.StructField(n, T.LongType()) for n in _LONGS]
    + [T.StructField(n, T.StringType()) for n in _STRINGS]
    + [T.StructField("duration_s", T.DoubleType()), T.StructField("seek_offsets", T.ArrayType(T.LongType()))]
)


def _features(data: bytes | None) -> dict:
    if data is None:
        return dict.fromkeys(FEATURES.names)
    r = read_audio(data)
    payload, rate = r["payload"], r["sample_rate"]
    seek = zlib.crc32(np.array(r["offsets"], dtype="<u8").tobytes())
    said = f"mpeg{r['version']}-layer{r['layer']};{rate}Hz;channels={r['channels']};kbps={','.join(map(str, r['kbps']))};frames={r['frames']};samples={r['samples']};table={r['table']}:{r['stated_frames']}:{r['stated_bytes']}:{zlib.crc32(np.array(r['table_points'], dtype='<u8').tobytes()):08x};bad_crc={r['bad_crc']};resyncs={r['resyncs']};seek={seek:08x}"
    return {
        "n_bytes": r["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "frames": r["frames"], "samples": r["samples"], "sample_rate": rate,
        "duration_s": r["samples"] / rate if rate else None, "bad_crc": r["bad_crc"], "resyncs": r["resyncs"], "seek_offsets": r["offsets"], "feature": said,
    }


@F.pandas_udf(FEATURES)
def _probed(media: pd.Series) -> pd.DataFrame:
    found = [_features(x) for x in media]
    return pd.DataFrame({n: pd.Series([f[n] for f in found], dtype="Int64" if n in _LONGS else "object") for n in FEATURES.names})


def store(text: Column | str) -> Column:
    """A binary column with the MPEG audio form of a text column."""
    return _stored(text)


def probe(media: Column | str) -> Column:
    """A struct column of payload digests, durations, checks and seek offsets of a column of MPEG audio."""
    return _probed(media)


def media_table(docs: DataFrame, folder: str) -> DataFrame:
    """doc_id and media of all documents, written as Parquet to folder and read back."""
    docs.select("doc_id", store("text").alias("media")).write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)
