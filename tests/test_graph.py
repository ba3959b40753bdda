from pyspark.sql import functions as F

from hexlode.operators import graph, ingest


def edges(spark, *rows):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], "edge_id string, source_id string, target_id string, type string, weight double")


def starts(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "query_id string, node_id string")


def found(df):
    return {r["node_id"]: r["depth"] for r in df.collect()}


def test_bfs_stops_at_its_depth(spark):
    e = edges(spark, ("A", "B", "led_to", 1.0), ("B", "C", "led_to", 1.0), ("C", "D", "led_to", 1.0))
    assert found(graph.bfs(e, starts(spark, "A"))) == {"B": 1, "C": 2}


def test_bfs_goes_along_a_type_alone(spark):
    e = edges(spark, ("author", "p1", "caused_by", 1.0), ("author", "p2", "supports", 1.0))
    assert found(graph.bfs(e, starts(spark, "author"), 1, types=["caused_by"])) == {"p1": 1}


def test_bfs_visits_a_cycle_once(spark):
    e = edges(spark, ("A", "B", "led_to", 1.0), ("B", "C", "led_to", 1.0), ("C", "A", "led_to", 1.0))
    assert found(graph.bfs(e, starts(spark, "A"), 5, "outgoing")) == {"B": 1, "C": 2}


def test_proximity_never_mixes_directions(spark):
    e = edges(spark, ("A", "X", "led_to", 1.0), ("B", "X", "led_to", 1.0))
    assert found(graph.bfs(e, starts(spark, "A"))) == {"X": 1, "B": 2}
    candidates = spark.createDataFrame([("A", "A"), ("A", "X"), ("A", "B")], "query_id string, node_id string")
    assert {r["node_id"]: r["proximity"] for r in graph.proximity(e, candidates, starts(spark, "A")).collect()} == {"A": 1.0, "X": 0.5, "B": 0.0}


def test_canonical_documents(spark):
    e = edges(spark, ("doc1", "doc4", "analogous_to", 0.8), ("doc2", "doc6", "derived_from", 0.9), ("doc6", "doc1", "depends_on", 0.6), ("doc3", "doc5", "analogous_to", 0.5), ("doc2", "doc5", "supports", 0.3))
    assert found(graph.bfs(e, starts(spark, "doc6"))) == {"doc1": 1, "doc2": 1, "doc4": 2, "doc5": 2}
    c = spark.createDataFrame([("doc6", f"doc{i}") for i in range(1, 6)], "query_id string, node_id string")
    near = {r["node_id"]: r["proximity"] for r in graph.proximity(e, c, starts(spark, "doc6"), 2).collect()}
    assert near == {"doc1": 0.5, "doc2": 0.5, "doc4": 0.3333, "doc5": 0.0, "doc3": 0.0}
    weighted = {r["node_id"]: r["proximity"] for r in graph.weighted_proximity(e, c, starts(spark, "doc6"), {"depends_on": 1.0}, 2).collect()}
    assert weighted["doc1"] == 0.6


def test_shortest_paths_weigh_edges(spark):
    e = edges(spark, ("a", "b", "led_to", 1.0), ("b", "d", "led_to", 1.0), ("a", "d", "led_to", 0.1), ("a", "c", "led_to", 0.0))
    pairs = spark.createDataFrame([("q", "a", "d"), ("r", "a", "c"), ("s", "d", "a")], "query_id string, source_id string, target_id string")
    got = {r["query_id"]: r for r in graph.shortest_paths(e, pairs).collect()}
    assert got["q"]["path"] == ["a", "b", "d"] and got["q"]["cost"] == 2.0 and got["q"]["total_weight"] == 2.0
    assert got["r"]["cost"] == 100.0 and "s" not in got
    assert {r["query_id"]: r["length"] for r in graph.shortest_paths(e, pairs, weighted=False).collect()} == {"q": 1, "r": 1}
    assert [r["edge_id"] for r in graph.path_edges(graph.shortest_paths(e, pairs).where("query_id = 'q'"), e).orderBy("position").collect()] == ["e0", "e1"]


def test_parallel_edges_keep_the_latest(spark):
    e = edges(spark, ("A", "B", "led_to", 1.0), ("A", "B", "supports", 0.4))
    assert [r["type"] for r in graph.graph_edges(e).collect()] == ["supports"]
    assert {r["node_id"]: (r["in_degree"], r["out_degree"]) for r in graph.degrees(e).collect()} == {"A": (0, 2), "B": (2, 0)}


def test_neighbours_and_components(spark):
    e = edges(spark, ("A", "B", "led_to", 1.0), ("B", "A", "supports", 0.4), ("C", "A", "led_to", 0.2))
    got = {r["neighbour_id"]: r["direction"] for r in graph.neighbours(e, starts(spark, "A")).collect()}
    assert got == {"B": "outgoing", "C": "incoming"}
    assert [r["node_id"] for r in graph.component(e, starts(spark, "A"), most=2).orderBy("depth", "node_id").collect()] == ["A", "B"]


def test_valid_edges_and_deletion(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "node_id string").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz")).withColumn("parent_id", F.lit(None).cast("string"))
    e = edges(spark, ("A", "B", "related_to", 1.0), ("A", "A", "led_to", 1.0), ("A", "Z", "led_to", 1.0), ("B", "C", "relates", 0.5), ("B", "C", "led_to", 1.5))
    assert [(r["source_id"], r["type"]) for r in ingest.valid_edges(e, nodes).collect()] == [("A", "analogous_to")]
    marked, left = ingest.soft_delete(nodes, e, starts(spark, "B"))
    assert sorted(r["node_id"] for r in ingest.active(marked).collect()) == ["A", "C"] and left.count() == 2
    assert [r["node_id"] for r in ingest.missing_ends(e, nodes).collect()] == ["Z"]
    assert ingest.needs_compaction(marked)
