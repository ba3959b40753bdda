"""Work that grows with its input: searches by groups, paths from both ends, forests of tasks, passages looked for at once."""

import itertools
import math
import random
import re

import numpy as np

from hexlode.operators import bm25, evaluate, forest, graph, vector


def test_bm25_meets_in_groups(spark, monkeypatch):
    monkeypatch.setattr(bm25, "GROUP", 40)
    monkeypatch.setattr(bm25, "QUERY_GROUP", 3)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(50)], k=rng.randint(1, 30)))) for i in range(150)] + [(7, "w3 w3"), (900, None), (901, "a b")]
    queries = [(q, " ".join(rng.choices(words, k=8))) for q in range(8)] + [(50, "")]
    docs, asked = spark.createDataFrame(texts, "node_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index = bm25.build(docs)
    held = {}
    for i, t in texts:
        held.setdefault(i, []).extend(re.findall("[a-z0-9]{2,}", t or ""))
    held = {i: t for i, t in held.items() if t}
    mean, df = sum(map(len, held.values())) / len(held), {w: sum(w in t for t in held.values()) for w in words}
    idf = {w: math.log((len(held) - n + 0.5) / (n + 0.5) + 1) for w, n in df.items()}
    even = docs.where("node_id % 2 = 0").select("node_id")
    for among, ids in ((None, set(held)), (even, {i for i in held if i % 2 == 0})):
        got = {(r["query_id"], r["rank"]): (r["node_id"], r["score"]) for r in bm25.search(index, asked, 5, among=among).collect()}
        for q, t in queries:
            score = {i: round(sum(idf[w] * held[i].count(w) * 2.5 / (held[i].count(w) + 1.5 * (0.25 + 0.75 * len(held[i]) / mean)) for w in t.split()), 6) for i in ids}
            want = sorted(((-s, i) for i, s in score.items() if s > 0))[:5]
            assert [(i, -s) for s, i in want] == [got[q, r + 1] for r in range(len(want))]
    pairs = spark.createDataFrame([(q, i) for q in range(8) for i in range(0, 150, 3)] + [(50, 1), (0, 901)], "query_id long, node_id long")
    share = {(r["query_id"], r["node_id"]): r["share"] for r in bm25.shares(index, asked, pairs).collect()}
    assert share == {(q, i): len(set(queries[q][1].split()) & set(held[i])) / len(set(queries[q][1].split())) for q in range(8) for i in range(0, 150, 3)}


def test_sweep_of_forests(spark, monkeypatch):
    monkeypatch.setattr(vector, "GROUP", 30)
    x = np.random.default_rng(4).standard_normal((110, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s, want = np.round(u @ u.T, 6), {}
    for t in (0.9, 0.8, 0.6, 2.0):
        at = list(range(110))
        links = [(a, b) for a, b in itertools.combinations(range(110), 2) if s[a, b] >= t]
        for a, b in links:
            at = [at[b] if c == at[a] else c for c in at]
        want[t] = (len(links), len(set(at)), max(at.count(c) for c in set(at)))
    got = {r["threshold"]: (r["edges"], r["components"], r["largest"]) for r in forest.similarity_sweep(df, (0.9, 0.8, 0.6, 2.0)).collect()}
    assert got == want
    level = np.zeros(len(links := list(itertools.combinations(range(40), 2))), dtype=int)
    assert len(forest._spanning(*np.array(links).T, level, 40, 1)) == 39


def test_single_precision_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(vector, "SAMPLE", 8)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((30, 8)), 4, axis=0) + rng.choice([0, 1e-7], (120, 8))
    df = spark.createDataFrame([(i, v.tolist(), str(i % 3)) for i, v in enumerate(x)], "node_id long, embedding array<double>, label string")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    got = {}
    for r in vector.similar(df, df, 5, "node_id", "node_id", left_group="label", right_group="label", same_group=False).collect():
        got.setdefault(r["source_node_id"], {})[r["rank"]] = r["target_node_id"]
    for i in range(120):
        want = sorted((j for j in range(120) if j % 3 != i % 3), key=lambda j: (-s[i, j], j))[:5]
        assert [got[i][k + 1] for k in range(5)] == want


def test_paths_from_both_ends(spark):
    rng = random.Random(8)
    edges = sorted({(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(70)) if a != b})
    weights = {e: rng.choice([0.25, 0.5, 1.0]) for e in edges}
    df = spark.createDataFrame([(f"e{a}-{b}", a, b, "led_to", weights[a, b]) for a, b in edges], "edge_id string, source_id long, target_id long, type string, weight double")
    pairs = [(i, a, b) for i, (a, b) in enumerate(itertools.product(range(0, 25, 4), range(0, 25, 3)))] + [(900, 3, 3), (901, 3, 99)]
    got = {r["query_id"]: (r["cost"], r["length"], r["path"]) for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "query_id long, source_id long, target_id long")).collect()}
    want = {}
    for q, a, b in pairs:
        best = {a: (0.0, 0, [a])}
        for _ in range(25):
            for (s, t), w in weights.items():
                if s in best and t not in best[s][2]:
                    best[t] = min(best.get(t, (math.inf,)), (best[s][0] + 1 / w, best[s][1] + 1, best[s][2] + [t]))
        if b in best:
            want[q] = best[b]
    assert got == want


def test_proximity_of_all_nodes(spark):
    df = spark.createDataFrame([(f"e{i}", i, (i * 3 + 1) % 20, "led_to", 1.0) for i in range(20)], "edge_id string, source_id long, target_id long, type string, weight double")
    nodes, anchors = spark.range(22).withColumnRenamed("id", "node_id"), spark.createDataFrame([(0, 0), (1, 5), (1, 6)], "query_id long, node_id long")
    every = nodes.crossJoin(anchors.select("query_id").distinct())
    assert sorted(map(tuple, graph.proximity_of_all(df, nodes, anchors).collect())) == sorted(map(tuple, graph.proximity(df, every, anchors).collect()))


def test_passages_are_found_at_once(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abñ ", k=rng.randint(0, 60))) for _ in range(300)]
    passages = ["", "ab", "ñ", *(t[3:k] for t in texts[:40] for k in (10, 14, 30)), "abababab", "zzzzzzzzzzz"]
    nodes = spark.createDataFrame([*enumerate(texts), (999, None)], "node_id long, text string")
    asked = spark.createDataFrame([*enumerate(passages), (999, None)], "query_id long, text string")
    got = sorted(map(tuple, evaluate.holding(nodes, asked).collect()))
    assert got == sorted((q, i) for i, t in enumerate(texts) for q, p in enumerate(passages) if p in t)
