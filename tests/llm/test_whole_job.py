"""Cases in which an operator once did less than its whole job."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hexlode.llm import capfilters, html_extract, mixing, mpeg_audio, ngram_join

SCALES = {"8": np.ones(8), "16": np.ones(16), "decay": 1 / np.arange(1, 65), "power": 0.95 ** np.arange(64), "half": (np.arange(64) < 32).astype(float), "short": np.ones(2)}


@pytest.mark.parametrize("name", SCALES)
def test_op10_recall_on_any_spread_of_energy(spark, name):
    scale = SCALES[name]
    rng = np.random.default_rng(4)
    base, noise = rng.standard_normal((2, 300, len(scale))) * scale
    noise -= (noise * base).sum(1)[:, None] * base / (base * base).sum(1)[:, None]
    near = base / np.linalg.norm(base, axis=1)[:, None] * 0.935 + noise / np.linalg.norm(noise, axis=1)[:, None] * np.sqrt(1 - 0.935**2)
    x = np.vstack([base, near]).astype(np.float32)
    df = spark.createDataFrame([(i, i % 300, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<float>")
    got = capfilters.near_duplicates(df).toPandas()
    assert got.n_links.max() == 1 and got.n_links.sum() >= 0.95 * len(x)


def worst_deviation(blocks, weights, slots):
    """The greatest distance of a source from its share, over all slots and sources."""
    order = [k for _, k in sorted((t, k) for k, at in slots.items() for t in at)]
    assert sorted(t for at in slots.values() for t in at) == list(range(sum(blocks.values()))) and all(list(at) == sorted(at) and len(at) == blocks[k] for k, at in slots.items())
    got, share, worst, weights = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, Fraction(0)), Fraction(0), {k: Fraction(w) for k, w in weights.items()}
    for k in order:
        got[k] += 1
        rest = Fraction(1)
        while rest and (active := [x for x in blocks if blocks[x] > share[x]]):
            total = sum(weights[x] for x in active)
            step = min(rest, *((blocks[x] - share[x]) * total / weights[x] for x in active))
            for x in active:
                share[x] += weights[x] * step / total
            rest -= step
        worst = max(worst, *(abs(got[x] - share[x]) for x in blocks))
    return worst


def test_op2_keeps_to_exact_weights():
    rng = np.random.default_rng(6)
    for n in (2, 7, 12):
        blocks = {f"s{i}": int(rng.integers(1, 30)) for i in range(n)}
        for weights in ({k: float(rng.random()) + 0.001 for k in blocks}, {k: b**0.5 for k, b in blocks.items()}):
            assert worst_deviation(blocks, weights, mixing.exact_slots(blocks, weights)) < 1
    blocks = dict.fromkeys(range(200), 2) | {0: 200}
    weights = {k: Fraction(1, 3) if k == 0 else Fraction(2, 3 * 199) for k in blocks}
    assert worst_deviation(blocks, weights, mixing.exact_slots(blocks, weights)) < 1


def test_op2_takes_any_number_of_sources(spark):
    docs = spark.range(10_000).selectExpr("id AS doc_id", "concat('s', if(id < 3000, 0, id % 5000)) AS source")
    got = mixing.mix(docs, {f"s{i}": 1.0 if i else 2500.0 for i in range(5000)}).toPandas()
    assert len(got) == 10_000 and got._slot.max() + 1 == got._slot.nunique()
    first = got[(got.source == "s0") & (got._at == 0)]._slot.sort_values().tolist()
    assert all(abs(j - (t + 1) * 2500 / 7499) < 1 for j, t in enumerate(first[:100], 1))


def test_pipeline_packs_in_the_mixtures_order(spark, tmp_path):
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('s', int(sqrt(id % 25))) AS source", "'' AS text")
    mixed = mixing.mix(docs).withColumn("text", F.expr("repeat('some words here. ', int(1 + _slot / 4))"))
    wanted = [r["doc_id"] for r in mixed.orderBy("_slot", "_at").select("doc_id").collect()]
    # Later files are larger, so they are read first.
    mixed.repartitionByRange(6, "_slot", "_at").sortWithinPartitions("_slot", "_at").select("doc_id", "source", "text").write.parquet(f"{tmp_path}/mixed")
    got = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").toPandas().sort_values(["sequence_id", "offset"])
    assert list(dict.fromkeys(got.doc_id)) == wanted and (got[got.start > 0].doc_id.isin(wanted)).all()


@pytest.mark.parametrize("units", [1, 3])
def test_op8_keeps_a_last_frame_that_holds_tag(units):
    data = b"x" * (576 * (units - 1) + 475) + b"TAG" + b"y" * 98
    whole = mpeg_audio.write_audio(data)
    assert whole[-128:-125] == b"TAG"
    r = mpeg_audio.read_audio(whole)
    assert r["payload"] == data and r["frames"] == units and not r["id3v1"] and r["resyncs"] == r["bad_crc"] == 0
    tagged = mpeg_audio.read_audio(whole + b"TAG" + bytes(125))
    assert tagged["payload"] == data and tagged["frames"] == units and tagged["id3v1"] and tagged["resyncs"] == 0
    short = mpeg_audio.read_audio(whole[:-40] + b"TAG" + bytes(125))  # the last frame is cut off in front of a tag
    assert short["frames"] == units - 1 and short["id3v1"]


def test_pipeline_links_at_five_words_and_four_fifths(spark):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"b{i}" for i in range(200)), " ".join([*(f"b{i}" for i in range(200)), *(f"c{i}" for i in range(40))])]
    for g in range(50):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(5, 70)))]
        for _ in range(4):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(40)}"
            texts.append(" ".join(w + [f"y{rng.integers(90)}" for _ in range(int(rng.integers(0, 6)))]))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and root[i] != root[j]:
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs, 5, 80).collect()}
    assert got == dict(enumerate(root)) and got[1] == 0
    assert {r["doc_id"] for r in corpus_pipeline.ngram_join_stage(spark, docs, "").collect()} == set(root)


def test_op1_keeps_text_behind_stray_quotes_and_empty_comments():
    text = lambda x: html_extract.main_text(x, html_extract.default_model())
    page = "<article>{}<p>Some words of an article, one {}two</a> three.</p><p>It isn't four, and \"five\" is.</p></article>"
    wanted = "Some words of an article, one two three.\nIt isn't four, and \"five\" is."
    for tag in ("<a title=don't href=x>", "<a href=x' >", "<a x y\">", "<a title='a > b' href = \"c > d\">", "<a href=x?a=\"b>"):
        assert text(page.format("", tag)) == wanted
    for comment in ("<!-->", "<!--->", "<!-- > -->", "<!---->"):
        assert text(page.format(comment, "<a>")) == wanted


@pytest.mark.parametrize("slots", [None, 64])
def test_mixed_order_writes_the_mixture_file_by_file(spark, tmp_path, slots):
    """By one shuffle of whole rows, in the order of mix(), with columns named as its own."""
    docs = spark.range(30_000).selectExpr("if(id < 10, null, id) AS doc_id", "if(id % 3 = 0, null, concat('s', int(sqrt(id % 50)))) AS source", "id AS _slot", "concat('text ', id) AS text")
    wanted = [r["text"] for r in mixing.mix(docs, slots=slots).where("doc_id is not null").orderBy("_slot", "_at").collect()]
    mixing.mixed_order(docs, slots=slots).write.parquet(f"{tmp_path}/{slots}")
    files = sorted(str(f) for f in (tmp_path / str(slots)).glob("*.parquet"))
    got = [x for f in files for x in spark.read.parquet(f).orderBy(F.monotonically_increasing_id()).select("doc_id", "_slot", "text").collect()]
    assert len(got) == 30_000 and [r["text"] for r in got if r["doc_id"] is not None] == wanted and all(r["text"] == f"text {r['_slot']}" for r in got)
