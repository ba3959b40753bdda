"""Paths of more hops than the search once took rounds."""

import pytest

from hexlode.operators import graph


def test_shortest_paths_of_any_length(spark):
    n = 103
    rows = [(f"e{i:03}", i, i + 1, "next_turn", 1.0) for i in range(n)] + [("far", 0, n, "same_session", 0.001)]
    edges = spark.createDataFrame(rows, "edge_id string, source_id long, target_id long, type string, weight double")
    pairs = spark.createDataFrame([("q", 1, n), ("r", n - 3, n)], "query_id string, source_id long, target_id long")
    got = {r["query_id"]: r for r in graph.shortest_paths(edges, pairs).collect()}
    assert got["q"]["path"] == list(range(1, n + 1)) and (got["q"]["length"], got["q"]["cost"], got["q"]["total_weight"]) == (n - 1, n - 1.0, n - 1.0)
    assert got["r"]["length"] == 3
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, pairs, rounds=2)
