"""The inverted file of vectors, keyed merges and spanning forests."""

import numpy as np
import pytest

from hexlode.operators import changes, forest, ivf, vector
from hexlode.sources.store import Conflict

FOLDER = "/root/testdata/sf0.1"


def test_recall_against_exact_search(spark, tmp_path):
    v = spark.read.parquet(f"{FOLDER}/embeddings.parquet").withColumnRenamed("vec_id", "node_id")
    index = ivf.VectorIndex.create(spark, str(tmp_path / "i"), v)
    probes = index.probes_for(0.95)
    cells = len(index.middle())
    assert cells == 45 and 1 <= probes < cells
    queries = v.where("node_id % 20 = 0").withColumnRenamed("node_id", "query_id")
    exact = {(r["query_id"], r["node_id"]) for r in vector.vector_search(v, queries).collect()}
    found = index.search(queries, 10, probes).collect()
    assert len(exact & {(r["query_id"], r["node_id"]) for r in found}) >= 0.9 * len(exact)
    # pieces of cells and of queries change nothing
    assert sorted(map(tuple, index.search(queries, 10, probes, group=7).collect())) == sorted(map(tuple, found))


def test_index_changes(spark, tmp_path):
    rng = np.random.default_rng(1)
    frame = lambda ids, x: spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, x, strict=True)], "node_id long, embedding array<float>")
    x = rng.standard_normal((60, 8)).astype(np.float32)
    index = ivf.VectorIndex.create(spark, str(tmp_path / "i"), frame(range(50), x[:50]).union(spark.createDataFrame([(90, None), (91, [1.0])], "node_id long, embedding array<float>")), cells=4)
    s = index.stats().first()
    assert (s["vectors"], s["cells"], s["deltas"]) == (50, 4, 0)
    index.upsert(frame(range(45, 60), x[45:]))
    index.delete(spark.createDataFrame([(0,), (59,), (1000,)], "node_id long"))
    index.upsert(frame([0], -x[:1]))
    ids = spark.createDataFrame([(0,), (59,), (55,), (1000,)], "node_id long")
    for _ in range(2):
        assert {tuple(r) for r in index.has(ids).collect()} == {(0, True), (59, False), (55, True), (1000, False)}
        assert np.allclose(index.get(ids).where("node_id = 0").first()["embedding"], -x[0])
        q = frame([7], -x[:1]).withColumnRenamed("node_id", "query_id")
        assert index.search(q, 1, 1).first()["node_id"] == 0 and index.stats().first()["vectors"] == 59
        index.compact(refit=True)
    s = index.stats().first()
    assert (s["deltas"], s["changed"], index.store.manifest()["version"]) == (0, 0, 3)
    again = ivf.VectorIndex(spark, str(tmp_path / "i"))
    assert again.stats().first()["vectors"] == 59
    with pytest.raises(Conflict):
        index.store.update_manifest({"deltas": ["lost"]}, index.store.manifest()["revision"] - 1)


def test_vectors_that_do_not_pair(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, None, [1.0, 0.1]), (3, "", [1.0, 0.0]), (4, "a", [1.0, 0.0, 0.0, 0.0]), (5, None, [1.0, 0.0]), (6, "a", None), (7, "a", [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id long, g string, embedding array<float>")
    pairs = lambda **how: {(r["source_id"], r["target_id"]) for r in vector.similar(df, df, None, "id", "id", half=True, left_group="g", right_group="g", **how).collect()}
    assert pairs(same_group=True) == {(1, 7)} and pairs(same_group=False) == {(1, 3), (3, 7)}
    best = vector.similar(df, df, None, "id", "id", half=True, left_group="g", right_group="g", best_pairs=1).collect()
    assert {(r["group"], r["source_id"], r["target_id"]) for r in best} == {("a", 1, 3), (None, 2, 7), ("", 3, 5)}


def test_merge_of_odd_batches(spark):
    table = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, None, None), (None, "n", 0.0)], "k int, s string, v double")
    batch = spark.createDataFrame([(1, None, 5.0, 1, None), (1, "z", None, 0, None), (None, "q", 9.0, 1, None), (2, None, None, 1, None), (7, "a", None, 1, "delete")], "k int, s string, v double, at int, op string")
    merged = changes.merge(table, batch, "k", "at")
    assert sorted(map(tuple, merged.table.collect()), key=repr) == sorted([(1, "z", 5.0), (1, "z", 5.0), (2, None, None), (None, "n", 0.0)], key=repr)
    assert {tuple(r) for r in merged.changes.collect()} == {(1, "updated"), (2, "updated"), (7, "missing")}
    assert changes.merge(table, batch.limit(0), "k", "at").table.count() == 4


def test_forest_against_kruskal(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 40, 90), rng.integers(0, 40, 90), rng.integers(1, 6, 90) / 10, strict=True)] + [(3, 3, 0.9), (90, 91, None), (50, 51, 0.5), (51, 50, 0.2), (60, 61, 0.1)]
    df = spark.createDataFrame(edges, "source_id long, target_id long, weight double")

    def joined(pairs):
        root = {i: i for i in range(100)}
        top = lambda i: i if root[i] == i else top(root[i])
        kept = []
        for a, b, w in pairs:
            if top(a) != top(b):
                root[top(a)] = top(b)
                kept.append((a, b, w))
        return kept, top

    best = {}
    for a, b, w in edges:
        if a != b and w is not None:
            best[min(a, b), max(a, b)] = max(w, best.get((min(a, b), max(a, b)), 0))
    ranked = sorted(((a, b, w) for (a, b), w in best.items()), key=lambda e: (-e[2], -e[0], -e[1]))
    got = forest.maximum_spanning_forest(df)
    assert sorted(map(tuple, got.collect())) == sorted(joined(ranked)[0])
    nodes = spark.createDataFrame([(i,) for i in range(61)], "node_id long")  # 61 is an end without a node
    for r in forest.sweep(nodes, df, [0.1, 0.3, 0.5]).collect():
        inside = [e for e in ranked if e[2] >= r["threshold"] and e[1] < 61]
        top = joined(inside)[1]
        sizes = np.unique([top(i) for i in range(61)], return_counts=True)[1]
        assert (r["edges"], r["components"], r["largest"]) == (len(inside), len(sizes), sizes.max())
    assert forest.maximum_spanning_forest(df.limit(0)).count() == 0
