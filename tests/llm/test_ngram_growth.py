"""Work of the n-gram join that grows with its input: sets that are in too few lists leave them, near copies meet pivots."""

import numpy as np
from pyspark.sql import functions as F

from hexlode.llm import ngram_join
from hexlode.llm.common import scratch


def components_of(texts, words=4, percent=85):
    sets = [{tuple(t.split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))} for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root[i], root[j]))
                root = [x if k == y else k for k in root]
    return dict(enumerate(root))


def found(spark, texts, words=4, percent=85):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in ngram_join.classes(docs, words, percent).collect()}


def test_large_sets_at_the_limit_keep_their_links(spark):
    rng, texts = np.random.default_rng(11), []
    for g in range(14):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(60, 500)))]
        for _ in range(5):
            w = list(base)
            for _ in range(int(rng.integers(0, 2 + len(base) // 50))):
                w[int(rng.integers(len(w)))] = f"x{rng.integers(40)}"
            w += [f"y{g}z{rng.integers(9999)}" for _ in range(int(rng.integers(0, len(base) // 8)))]
            texts.append(" ".join(w))
    for words, percent in ((4, 85), (5, 80)):
        want = components_of(texts, words, percent)
        assert 14 < len(set(want.values())) < len(texts) - 10
        assert found(spark, texts, words, percent) == want


def test_sets_that_share_a_phrase_or_two_leave_the_lists(spark):
    texts = [" ".join([*(f"t{i}w{j}" for j in range(150)), f"one phrase of pair{i // 2}", *(f"t{i}w{j}" for j in range(150, 300))]) for i in range(200)]
    near = [" ".join([*(f"n{j}" for j in range(300)), f"end{i}"]) for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    with scratch(spark):
        left = ngram_join.Join(docs).postings()
        assert left.select("node").distinct().count() == 2


def test_near_copies_are_not_compared_all_with_all(spark, monkeypatch):
    rng, texts, counted = np.random.default_rng(3), [], []
    for i in range(300):
        w = [f"w{j}" for j in range(200)]
        for e in rng.choice(45, 1 if i % 8 == 0 else 2, replace=False):
            w[int(e) * 4 + 6] = f"e{i}x{e}"
        texts.append(" ".join(w))
    plain = ngram_join.Join.verified

    def verified(self, pairs):
        counted.append(pairs.select(F.col("u")).count())
        return plain(self, pairs)

    monkeypatch.setattr(ngram_join.Join, "verified", verified)
    assert set(found(spark, texts).values()) == {0}
    assert sum(counted) < 20 * len(texts)


def test_texts_are_not_shuffled_to_drop_copies(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"a b c d e f g h {i // 2}") for i in range(20)], "doc_id long, source string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = ngram_join.one_of_each(docs)
        assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 20, 2))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_are_found_by_more_ids_than_are_broadcast(spark, monkeypatch):
    docs = spark.range(20000).selectExpr("IF(id % 1000 = 7, NULL, id) AS doc_id", "'x' AS text").union(spark.sql("SELECT 5L, 'y'"))
    ids = spark.range(0, 20000, 10).select((F.col("id") + 5).alias("__id"))
    for most in (1, 1000):
        monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", most)
        marked = ngram_join._marked(docs, "doc_id", ids)
        assert marked.where("__maybe").count() < (20002 if most == 1 else 3000)
        assert ngram_join.among(docs, "doc_id", ids).count() == 2001
        rest = ngram_join.among(docs, "doc_id", ids, "left_anti")
        assert rest.columns == docs.columns and rest.count() == 18000 and rest.where("doc_id IS NULL").count() == 20 and rest.where("doc_id % 10 = 5").isEmpty()


def test_copies_go_when_their_ids_are_too_many_to_be_broadcast(spark, monkeypatch):
    texts = [" ".join([*(f"t{i // 3}w{j}" for j in range(80)), *[f"end{i}"] * (i % 3)]) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (60, None), (1, texts[1])], "doc_id long, text string")
    kept = lambda: sorted((str(r["doc_id"]) for r in ngram_join.one_of_each(docs).collect()))
    want = sorted(map(str, [*range(0, 60, 3), 60, None]))
    assert kept() == want
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 4)
    assert kept() == want
