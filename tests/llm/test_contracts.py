"""Each registered query on the smallest tables, held against a brute-force version of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from hexlode.llm import queries
from tests.duck import CHECKED, SMALL, rows, sql_rows

Q, UPPER = queries.queries(), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, name, folder=SMALL):
    return spark.read.parquet(f"{folder}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert rows(Q[name](spark, CHECKED).toPandas()) == sql_rows(queries.oracle_sql()[name], CHECKED)


def test_op1_finds_articles(spark):
    import html

    got = Q["op1_html_extract"](spark, SMALL).toPandas().set_index("page_id")
    for p in table(spark, "pages").itertuples():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got.loc[p.page_id].text == "\n".join(b for b in blocks if b) and got.loc[p.page_id].n_chars == len(got.loc[p.page_id].text)


def test_op2_deviates_by_less_than_a_block(spark):
    got = Q["op2_mixing"](spark, SMALL).toPandas()
    n = len(table(spark, "documents"))
    assert len(got) == n == got.position.nunique()
    blocks = got.drop_duplicates(["source", "block"]).sort_values("slot")
    assert (blocks.slot.to_numpy() == np.arange(len(blocks))).all() and (blocks.groupby("source").block.apply(list).map(lambda b: b == sorted(b))).all()


def components(ids, links):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_op4_links(spark):
    sets = {}
    for d in table(spark, "documents").itertuples():
        w = re.findall(r"[^\x20\x09-\x0D]+", (d.text or "").translate(UPPER))
        sets[d.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = Q["op4_ngram_join"](spark, SMALL).toPandas()
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == components(ids, links)
    assert dict(zip(got.doc_id, got.n_shingles, strict=True)) == {i: len(s) for i, s in sets.items()} and len(links)


def test_op5_base_places(spark):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = Q["op5_license_scan"](spark, CHECKED).toPandas().set_index("doc_id")
    hit = 0
    for d in table(spark, "documents", CHECKED).itertuples():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d.text or "").translate(UPPER))
        at = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got.loc[d.doc_id]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        if at:
            hit += 1
            assert (r.first_word, r.last_word) == (min(at)[0], max(at)[0]) and set(r.base_labels.split(",")) < set(r.labels.split(",")) and 0 < r.score <= 1
    assert hit > 10


def test_op6_accuracy_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = Q["op6_toxicity"](spark, folder).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all() and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out].merge(table(spark, "labels", folder), on="doc_id")
    toxic = held.toxic == 1
    assert held.predicted[~toxic].mean() < 0.01 and held.predicted[toxic].mean() > 0.5


def test_op8_round_trip(spark):
    got = Q["op8_mpeg_audio"](spark, SMALL).toPandas().set_index("doc_id")
    for d in table(spark, "documents").itertuples():
        b = (d.text or "").encode()
        p, r = b + b"\xff" * (-len(b) % 576 if b else 576), got.loc[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r.frames == len(p) // 576 and r.bad_crc == 0 and r.resyncs == 0 and r.duration_s == r.frames * 1152 / 44100


def test_op9_holds_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d.doc_id: [*t.encode(d.text or "", add_special_tokens=False).ids, 1] for d in table(spark, "documents").itertuples()}
    got = Q["op9_packing"](spark, SMALL).toPandas()
    for doc, pieces in got.sort_values("start").groupby("doc_id"):
        at = 0
        for p in pieces.itertuples():
            assert p.start == at and p.doc_tokens == len(ids[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[doc][at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids[doc])
    assert set(got.doc_id) == set(ids)
    padding = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == list(np.cumsum([0, *s.length[:-1]])) and s.length.sum() <= 2048
        padding += 0 if (n := int(s.length.sum())) & (n - 1) == 0 else 2048 - n
    assert padding < 0.03 * got.length.sum()


def test_op10_recall(spark):
    from pyspark.sql import functions as F

    from hexlode.llm import capfilters

    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 64))
    noise = rng.standard_normal((400, 64))
    noise -= (noise * base).sum(1)[:, None] * base / (base * base).sum(1)[:, None]
    near = base / np.linalg.norm(base, axis=1)[:, None] * 0.95 + noise / np.linalg.norm(noise, axis=1)[:, None] * np.sqrt(1 - 0.95**2)
    x = np.vstack([base, near, base[:50]]).astype(np.float32)
    label = [i % 3 for i in range(400)] * 2 + [i % 3 for i in range(50)]
    extra = [(900, 0, None), (901, 0, [0.0] * 64), (902, None, x[0].tolist()), (903, 0, [float("nan")] * 64), (904, 0, [1.0, None] * 32), (905, 0, [float("inf")] * 64), (906, 0, [])]
    df = spark.createDataFrame([(i, lab, v.tolist()) for i, (lab, v) in enumerate(zip(label, x, strict=True))] + extra, "vec_id long, label int, embedding array<float>")
    got = capfilters.near_duplicates(df, chunk=64).toPandas().set_index("vec_id").sort_index()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = (u @ u.T >= 0.93) & (np.array(label)[:, None] == np.array(label)[None, :])
    np.fill_diagonal(s, False)
    assert (got.n_links[: len(x)].to_numpy() <= s.sum(1)).all() and got.n_links[: len(x)].sum() >= 0.95 * s.sum()
    bad = got.loc[900:]
    assert (bad.n_links == 0).all() and (bad.component_id == bad.index).all() and bad.kept.all()
    assert capfilters.near_duplicates(df.where(F.lit(False))).count() == 0


def test_op7_by_hand(spark):
    pages = table(spark, "documents", CHECKED)
    got = Q["op7_line_dedup"](spark, CHECKED).toPandas().set_index("doc_id")
    held, total = defaultdict(set), defaultdict(set)
    for p in pages.itertuples():
        total[p.source].add(p.text)
        for line in {x.strip(" \t\r\x0b\x0c") for x in p.text.split("\n")} - {""}:
            held[p.source, line].add(p.text)
    bad = {k for k, v in held.items() if len(v) >= 5 and len(total[k[0]]) >= 5 and len(v) > 0.05 * len(total[k[0]])}
    assert bad
    for p in pages.itertuples():
        assert got.loc[p.doc_id].text == "\n".join(x for x in p.text.split("\n") if (p.source, x.strip(" \t\r\x0b\x0c")) not in bad)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, "documents", CHECKED)
    folder, kept = CHECKED, spark.read.parquet(f"{CHECKED}/documents.parquet")
    columns, sizes = kept.columns, Counter()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, kept, folder).toPandas(), kept.schema)
        assert kept.columns == columns
        sizes[name] = kept.count()
    assert len(docs) > sizes["toxicity"] == sizes["line_dedup"] > sizes["ngram_join"] == sizes["mixing"]
    out = corpus_pipeline.run(spark, folder).toPandas()
    assert set(out.doc_id) == {r["doc_id"] for r in kept.select("doc_id").collect()}
