"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlode.llm import capfilters, html_extract, license_scan, line_dedup, mixing, mpeg_audio, ngram_join, packing, toxicity, warc
from hexlode.llm.components import components

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
TEXTS = [None, "", "  \n ", "one", "one", "one two three four five", "one two three four five", LONG, LONG, "MIT License, CC-BY", "\x00 é ß İ 日本"]
CLASHES = ("_slot", "_block", "_at", "_row", "_host", "_key", "_keys", "_id", "n", "node", "key", "root", "component", "text2", "p", "s", "k", "t", "score", "label", "labels", "filter", "media", "total")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 2}" if i else None, len(t or "")) for i, t in enumerate(TEXTS)] + [(None, "null id here", None, None, None), (3, "one", "en", "s1", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHES})


OPERATORS = {
    "ngram": lambda d: ngram_join.classes(d),
    "one_of_each": lambda d: ngram_join.one_of_each(d),
    "license": lambda d: license_scan.scan(d),
    "lines": lambda d: line_dedup.drop_boilerplate(d),
    "mixing": lambda d: mixing.mix(d),
    "mixed": lambda d: mixing.mixed_order(d),
    "packing": lambda d: packing.pack(d),
    "media": lambda d: d.select("doc_id", mpeg_audio.probe(mpeg_audio.store("text")).alias("f")),
    "html": lambda d: html_extract.extract(d.withColumn("html", F.col("text"))),
    "warc": lambda d: warc.read_archives(warc.write_archives(d.withColumns({"page_id": F.col("doc_id"), "url": F.col("source"), "html": F.col("text")}))),
    "toxicity": lambda d: toxicity.scores(d, d.selectExpr("doc_id", "doc_id % 2 AS toxic", "'x' AS text", "'x' AS _toxic")),
    "rejected": lambda d: toxicity.rejected_dropped(d, d.selectExpr("doc_id", "cast(null AS int) AS toxic")),
    "vectors": lambda d: capfilters.near_duplicates(d.selectExpr("doc_id AS vec_id", "if(doc_id % 3 = 0, null, lang) AS label", "if(doc_id = 4, null, array(float(doc_id % 4), float(length(text)))) AS embedding", "'x' AS node", "'x' AS copies", "'x' AS links", "'x' AS filters", "'x' AS vector")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    got = OPERATORS[name](docs).collect()
    assert len(got) >= (8 if name == "one_of_each" else len(TEXTS) + 2)
    assert OPERATORS[name](docs.where(F.lit(False))).count() == 0


def test_ngram_rows(docs):
    got = {r["doc_id"]: r for r in ngram_join.classes(docs).collect()}
    assert got[0]["n_shingles"] == got[1]["n_shingles"] == got[2]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[2]["component_id"] == 2
    assert got[4]["component_id"] == 3 and got[4]["n_shingles"] == 1 and got[6]["component_id"] == 5 and got[6]["n_shingles"] == 2 and got[8]["component_id"] == 7
    assert got[None]["component_id"] is None
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()} == {0, 1, 2, 3, 5, 7, 9, 10, None}


def test_ngram_against_brute_force_on_random_sets(spark):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(4, 60)))]
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(40)}"
            texts.append(" ".join(["the same opening words of all documents"] * int(rng.integers(2)) + w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))} for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(df).collect()}
    assert got == {i: top(i) for i in range(len(sets))}


def test_sizes_and_boundary():
    for n in range(1, 60):
        for m in range(1, 60):
            links = [o for o in range(min(n, m) + 1) if 100 * o >= 85 * (n + m - o)]
            assert (m in ngram_join.partners(n)) == bool(links)
            if links:
                assert ngram_join.needed(n, m) == min(links) and min(links) in ngram_join.subset_sizes(n) and n - min(links) + 1 <= ngram_join.prefix(n)
    assert ngram_join.boundary({8: 10, 30: 10}, 1.0) < 30 <= ngram_join.boundary({30: 10}, 1e9)
    a, b = np.arange(300, dtype=np.uint64) * np.uint64(7919), np.arange(10, 900, dtype=np.uint64) * np.uint64(7919)
    assert ngram_join.differing(ngram_join.parity(a), ngram_join.parity(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (5, 5), (None, 3)], "u long, v long")
    got = components(chain).groupBy("root").agg(F.count("*").alias("n"), F.min("node").alias("m")).collect()
    assert {(r["m"], r["n"]) for r in got} == {(0, 201), (900, 2)}


def test_license_diagonals(spark):
    texts = ["This program is free software; you can REDISTRIBUTE it and/or modify it under the terms of the new GNU General Public License.", "cc by, cc-by", "gnu general public", "mit\nlicense", None]
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["labels"] == "gpl,notice-gpl" and 0.7 <= got[0]["score"] <= 1 and got[0]["n_base"] == 1
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 0, 2) and got[2]["n_base"] == 0 and got[2]["labels"] == "" and got[3]["labels"] == "mit"
    assert got[4]["n_words"] == 0 and got[4]["first_word"] is None and got[4]["score"] == 0


def test_html():
    model = html_extract.default_model()
    text = lambda x: html_extract.main_text(x, model)
    assert text(None) == text("") == "" and text("<p>" * 2000 + "deep words, in it.") == "deep words, in it."
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class=ad>Buy &amp; go.</div><article><h1>A  title</h1><p>First &lt;b&gt;\n part<br>here.<p><b>Second<script>var a='</p>';</script>, bit.<aside><p>Aside words.</p></aside></article><div id=comments><p>I like it, thanks.</p></div><footer>&copy; x</footer><p"
    assert text(page) == "A title\nFirst <b> part here.\nSecond, bit."
    for belief in html_extract.marginals(html_extract.dom(page), model):
        assert 0 <= belief <= 1


def test_marginals_are_exact():
    """Against sums over all labellings of a small tree."""
    from itertools import product

    import math

    model = html_extract.default_model()
    nodes = html_extract.dom("<div class=content><p>Some words, here.</p><ul><li><a>x</a></li></ul></div>")
    sums = np.zeros(len(nodes))
    total = 0.0
    for labels in product((0, 1), repeat=len(nodes)):
        w = 0.0
        for v, x in enumerate(nodes):
            w += model.node(x.features)[labels[v]]
            if v:
                w += model.edge[labels[x.parent], "leaf" if x.text is not None else "element"][labels[v]]
        total += math.exp(w)
        sums += math.exp(w) * np.array(labels)
    assert np.allclose(html_extract.marginals(nodes, model), sums / total)


def test_mpeg_resynchronises():
    data = bytes(range(256)) * 20
    whole = mpeg_audio.write_audio(data)
    r = mpeg_audio.read_audio(whole)
    assert r["payload"] == mpeg_audio.padded(data) and r["n_bytes"] == len(data) and r["table"] == "Info" and r["stated_frames"] == r["frames"] == 9
    at = r["offsets"][4]
    broken = whole[:at] + b"\xff\xfa junk" + whole[at:] + b"TAG" + bytes(125)
    again = mpeg_audio.read_audio(broken)
    assert again["payload"] == r["payload"] and again["resyncs"] == 1 and again["id3v1"]
    flipped = bytearray(whole)
    flipped[at + 8] ^= 1
    assert mpeg_audio.read_audio(bytes(flipped))["bad_crc"] == 1
    assert mpeg_audio.read_audio(b"")["frames"] == 0 and mpeg_audio.read_audio(b"\xff" * 700)["frames"] == 0
    assert mpeg_audio.frame_of(bytes((0xFF, 0xFB, 0x90, 0x64)))[:5] == (417, 1152, 44100, 2, 128)
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7


def test_warc(spark):
    big = "<p>" + "x" * 200
    rows = [(5, "http://a/ b", big), (2, "http://c", big), (9, None, big), (1, "u", "small"), (3, "u", "small"), (4, "u", None), (None, "u", big), (7, "u", "é" * 60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(df)).collect()}
    assert len(got) == len(rows) and got[2]["record_type"] == "response" and all(got[i]["record_type"] == "revisit" and got[i]["refers_to"] == 2 for i in (5, 9, None))
    assert all(got[i]["record_type"] == "response" and got[i]["refers_to"] is None for i in (1, 3, 4, 7)) and got[4]["payload_bytes"] == 0 and got[7]["payload_bytes"] == 120
    assert warc.read_archives(warc.write_archives(df.where(F.lit(False)))).count() == 0
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    records = [f"record {i} with the usual words of a page".encode() * 9 for i in range(40)]
    for r in records:
        w.add(r)
    w.close()
    assert list(warc.archive_records(io.BytesIO(out.getvalue()))) == records and out.getvalue()[:4] == b"\x5d\x2a\x4d\x18"


def test_earliest_deadlines_keep_their_windows():
    rng = np.random.default_rng(1)
    for _ in range(20):
        share = mixing.parts({f"s{i}": float(w) for i, w in enumerate(rng.random(int(rng.integers(1, 9))) + 0.01)}, 64)
        order = mixing.earliest_deadlines(share)
        got = dict.fromkeys(share, 0)
        for t, k in enumerate(order):
            got[k] += 1
            assert all(abs((t + 1) * share[s] / 64 - got[s]) < 1 for s in share)
    plan = mixing.phases({"a": 10, "b": 3, None: 0}, {"a": 1.0, "b": 1.0, None: 1.0}, 8)
    slots = sorted(start + 8 * (b // a) + cycle[b % a] for _, start, _, taken, a, cycle in plan for b in range(taken))
    assert slots == list(range(13))
    with pytest.raises(ValueError):
        mixing.parts(dict.fromkeys(range(9), 1.0), 8)


def test_best_cuts_against_all_cuts():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.unique(rng.integers(1, 40, 9))
        at = np.unique(np.append(at, [8, 16, 24, 32, 40]))
        cost = rng.integers(0, 9, len(at))

        def price(cuts):
            starts = [0, *cuts[:-1]]
            if any(e - s > 12 for s, e in zip(starts, cuts, strict=True)):
                return 10**9
            return sum(12 - (e - s) + cost[np.searchsorted(at, e)] for s, e in zip(starts, cuts, strict=True))

        inner = at[:-1].tolist()
        least = min(price([*c, int(at[-1])]) for n in range(len(inner) + 1) for c in combinations(inner, n))
        assert price(packing.best_cuts(at, cost, 12)) == least


def test_packing_streams_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 500)
    e = packing.Encoder.of(packing.default_path())
    s = packing.Stream(e, 128, 0)
    rows, rng = [], np.random.default_rng(0)
    for i in range(60):
        s.add(i, "some words here. " * int(rng.integers(0, 60)) + "<|endoftext|>")
        if s.held >= packing.CHUNK:
            rows += s.flush(False).to_pylist()
    rows += s.flush(True).to_pylist()
    by = {}
    for r in rows:
        assert r["start"] == by.get(r["doc_id"], 0)
        by[r["doc_id"]] = r["start"] + r["length"]
        assert r["offset"] + r["length"] <= 128
    assert len(by) == 60 and sorted({r["sequence_id"] for r in rows}) == list(range(max(r["sequence_id"] for r in rows) + 1))


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.scores(docs, labels).collect()
    assert len(got) == len(TEXTS) + 2 and all(r["predicted"] == 0 for r in got) and len({r["score"] for r in got}) == 1
    assert toxicity.rejected_dropped(docs, labels).columns == docs.columns
    some = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, "fine words here" + " vile" * (i % 2)) for i in range(40)], "doc_id long, text string")
    scored = toxicity.scores(texts, some).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 for r in scored)


def test_line_dedup_by_host(spark):
    rows = [(i, f"Menu | Home\nstory {i}\n\n menu | home", "a") for i in range(30)] + [(100 + i, f"Menu | Home\nother {i}", "b") for i in range(3)] + [(200 + i, "copied page\nwhole", "c") for i in range(9)] + [(300, None, None), (301, "Menu | Home", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"_keys": F.lit(1), "_host": F.lit(2), "_dropped2": F.lit(3)})
    got = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0]["text"] == "story 0\n" and got[0]["_dropped"] == 2 and got[100]["text"] == "Menu | Home\nother 0" and got[200]["text"] == "copied page\nwhole"
    assert got[300]["text"] is None and got[301]["text"] == "" and got[301]["_keys"] == 1


def test_html_takes_time_in_proportion_to_length():
    import time

    model, began = html_extract.default_model(), time.perf_counter()
    n = 60_000
    for page in ('<a t=" ' * n, '<a t=">' * n, "<!" * n, "<div>" * n + "</x>" * n, "<div>" * n + "<li>" * n, "<p t=\"" + "<p t='>" * n, "<script>" + "</script " * n, '<a t="x" \'' * n):
        html_extract.main_text(page, model)
    assert time.perf_counter() - began < 60  # about 3 MB; minutes to hours if any were quadratic


def test_html_without_an_article_tag(spark):
    import re

    model = html_extract.default_model()
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        wanted = html_extract.main_text(r["html"], model)
        assert html_extract.main_text(re.sub(r"<(/?)article>", r"<\1div>", r["html"]), model) == wanted


def test_packing_has_the_ids_of_tokenizers():
    """On hostile texts: the rank file's ids against those of the tokenizers file."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.Encoder.of(packing.default_path())
    texts = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|", " " * 5000, "\t\n \r\n" * 300, "a" * 100_000, "e\u0301" * 2000, "\x00\x01\x7f\x80\x9f" * 50, "\u200d\ufeff\u2028\u00a0" * 99, "\U0001f469\u200d\U0001f4bb" * 300, "don't I'LL we'Ve 's", "12345678901234567890" * 50, "\u4e2d\u6587" * 3000, "\u0645\u0631\u062d\u0628\u0627 " * 500, "", " x", "x ", "\ud7ff\ue000\uffff"]
    for t in texts:
        assert encoder.ids(t).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing_of_texts_that_are_one_run(spark):
    """A million characters of one kind have the ids that the tokenizers file gives."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 1_000_000 + "a", "\n" * 1_000_000, "a" * 1_000_000, "e\u0301" * 200_000, "\t \u3000" * 400_000 + "<|endoftext|>"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = got[got.doc_id == i].sort_values("start")
        assert pieces.length.sum() == len(ids) == pieces.doc_tokens.iloc[0]
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in pieces.itertuples())


def test_packing_of_many_small_parts(spark, tmp_path):
    """Parts of files that are smaller than a megabyte have sequences of their own."""
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["one", "two", "three", "four"], 300)) + str(rng.random())) for i in range(3000)], "doc_id long, text string")
    docs.repartition(2).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "d"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        read = spark.read.parquet(str(tmp_path / "d"))
        assert read.rdd.getNumPartitions() > 2 and packing.numbered(read)
        got = packing.pack_files(read).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got.doc_id.nunique() == 3000 and got.groupby("sequence_id").length.sum().max() <= 2048
    assert not got.duplicated(["sequence_id", "offset"]).any()


def test_html_of_names_that_tell_nothing():
    """Layout classes, numbers and random names are no sign of boilerplate; precision and recall of blocks on pages that weren't learned from."""
    model = html_extract.default_model()
    text = lambda x: html_extract.main_text(x, model)
    p = "<p>Some words of a paragraph stand here, and there are a few more of them.</p>"
    for name in ("col-1", "row 1", "css-1x2y", "css-9x2y", "zq1", "box", "wrap 3", "l-col8 inner", "x"):
        for page in (f'<div class="{name}"><h1>A title</h1>{p}{p}</div>', f'<nav><ul><li><a href=x>Home</a></ul></nav><div id="{name}"><h1>A title</h1>{p}{p}</div><footer>&copy; me</footer>'):
            got = text(f"<html><body>{page}</body></html>").split("\n")
            assert got[0] == "A title" and len(got) == 3, name
    noted = text(f'<html><body><div class="zq1"><h1>A title</h1>{p}{p}</div><div class="l-col4"><h3>Most read</h3><ul><li><a href=x>One thing</a><li><a href=x>Two things</a></ul></div><div class="signup-form-x"><form><input name=a><button>Go</button> Sign up</form></div></body></html>')
    assert "Most read" not in noted and "thing" not in noted and "Sign up" not in noted
    right = found = wanted = empty = 0
    pages = list(html_extract.labelled_pages(300, seed=99))
    for page in pages:
        nodes = html_extract.dom(page)
        leaves = [(b >= 0.5, bool(x.label)) for x, b in zip(nodes, html_extract.marginals(nodes, model), strict=True) if x.text is not None]
        right, found, wanted = right + sum(a and b for a, b in leaves), found + sum(a for a, _ in leaves), wanted + sum(b for _, b in leaves)
        empty += not any(a for a, _ in leaves)
    assert right > 0.9 * found and right > 0.9 * wanted and empty <= 3
