import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlode.functions import filters, text as X, vectors as V
from hexlode.operators import bm25, evaluate, ingest, vector
from hexlode.schema import check_bounds


def test_porter():
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "rational": "ration", "triplicate": "triplic", "hopeful": "hope", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control", "rate": "rate", "sky": "sky"}
    assert {w: X.porter(w) for w in known} == known


def test_filters(spark):
    metas = [{"a": 1, "t": "x", "l": [1, 2], "s": ["u", "v"], "b": True}, {"a": 5, "t": "y"}, {"a": "1"}, {}]
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(metas)] + [(9, None)], "i int, metadata string")
    hit = lambda c: sorted(r["i"] for r in df.where(filters.metadata_filter(c)).collect())
    assert hit({"a": 1}) == [0] and hit({"a": "1"}) == [2] and hit({"t": "x", "a": 1}) == [0] and hit({"b": True}) == [0]
    assert hit({"l": 2}) == [0] and hit({"s": "v"}) == [0] and hit({"s": "w"}) == []
    assert hit({"a": {"$gt": 1}}) == [1] and hit({"a": {"$gte": 1, "$lt": 5}}) == [0] and hit({"a": {"$lte": 1}}) == [0]
    assert hit({"a": {"$ne": 1}}) == [1, 2] and hit({"a": {"$in": [1, 5]}}) == [0, 1] and hit({"a": {"$nin": [1]}}) == [1, 2]
    assert hit({"a": {"$near": 3}}) == [0, 1, 2] and hit({"a": {}}) == [0, 1, 2] and hit({"z": 1}) == [] and hit(None) == [0, 1, 2, 3, 9]
    assert sorted(r["i"] for r in df.where(filters.exact_filter({"t": None})).collect()) == [2, 3, 9]


def test_text(spark):
    df = spark.createDataFrame([("\n Hello there. How are  you? Ok. ", "<p>A &amp; B</p>\n\nC")], "t string, h string")
    r = df.select(X.sentences(F.col("t")).alias("s"), X.cleaned(F.col("h"), 50).alias("c"), X.tokens(F.lit("Running A runs-9x"), True).alias("k"), X.word_tokens(F.lit("Été où")).alias("w"), X.route(F.lit("Who is it in 1999?")).alias("r"), X.strip(F.lit("\t x \n")).alias("x")).first()
    assert r["s"] == ["Hello there.", "How are  you?"] and r["c"] == "A & B C" and r["k"] == ["run", "run", "9x"] and r["w"] == ["été", "où"] and r["r"] == "temporal" and r["x"] == "x"
    assert X.human_size(0) == "0.0 B" and X.human_size(1536) == "1.5 KB" and X.human_size(1024**5) == "1024.0 TB"
    with pytest.raises(ValueError):
        check_bounds(top_k=0)


def test_bm25_counts_repeated_query_tokens(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, "!"), (4, "green grass")], "node_id long, text string")
    q = spark.createDataFrame([("one", "red"), ("two", "red red")], "query_id string, text string")
    got = {r["query_id"]: r["score"] for r in bm25.search(bm25.build(docs), q).collect()}
    idf, dl, avg = np.log((3 - 1 + 0.5) / 1.5 + 1), 3, 7 / 3
    one = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got["one"] == pytest.approx(one, abs=1e-6) and got["two"] == pytest.approx(2 * one, abs=1e-6)


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "node_id long, embedding array<float>")
    got = vector.similar(df, df, 1, "node_id", "node_id", exclude_self=True).orderBy("source_node_id").collect()
    assert [(r[0], r[1]) for r in got] == [(1, 2), (2, 1), (3, 2), (4, 1)]
    assert df.select(V.cosine(F.col("embedding"), F.lit([0.0, 0.0]).cast("array<float>")).alias("c")).first()["c"] == 0.0
    e = vector.auto_edges(df, 0.9).collect()
    assert {(r[0], r[1], r["type"]) for r in e} == {(1, 2, "derived_from"), (2, 1, "derived_from")}
    assert vector.upsert(df, df.where("node_id = 1").withColumn("embedding", F.array(F.lit(0.5), F.lit(0.5)).cast("array<float>"))).count() == 4
    assert len(spark.range(1).select(V.mock_embed(F.lit("x"), 8).alias("v")).first()["v"]) == 8


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3)], "query_id string, node_id string, rank int")
    qrels = spark.createDataFrame([("q", "b"), ("q", "z"), ("other", "x")], "query_id string, node_id string")
    got = {r["query_id"]: r for r in evaluate.metrics(ranked, qrels, 10).collect()}
    assert got["q"]["precision"] == pytest.approx(1 / 3, abs=1e-6) and got["q"]["recall"] == 0.5 and got["q"]["mrr"] == 0.5 and got["q"]["hit"] == 1
    assert got["q"]["ndcg"] == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)), abs=1e-6)
    assert got["other"]["precision"] == 0 and got["other"]["mrr"] == 0
    assert evaluate.metrics(ranked, qrels, 10, divisor="k").where("query_id = 'q'").first()["precision"] == 0.1


def test_facts(spark):
    schema = "session_id string, key_facts array<string>, entities array<string>, relationships array<struct<source:string,relationship:string,target:string>>, date string"
    x = spark.createDataFrame([("s", [" Ann met BOB ", ""], ["Bob", "Eve"], [("Ann", "knows", "Bob"), ("", "x", "y")], "d")], schema)
    got = {r["fact"]: r["entities"] for r in ingest.flatten_facts(x).collect()}
    assert got == {"Ann met BOB": ["Bob"], "Ann knows Bob": ["Ann", "Bob"]}
