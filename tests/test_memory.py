import json

import pytest

from hexlode.memory import Memory, tool_schemas


@pytest.fixture
def memory(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "m"))
    rows = [("a", "Cats sit on mats. They purr a lot."), ("b", "Dogs bark at cats."), ("c", "Graphs have edges.")]
    m.store(spark.createDataFrame(rows, "node_id string, text string"))
    return m


def test_store_recall_relate_forget(spark, memory):
    assert memory.nodes.count() == 7 and memory.edges.count() == 4
    memory.relate(spark.createDataFrame([("a", "b", "related_to", 0.9), ("a", "a", "led_to", 1.0)], "source_id string, target_id string, type string, weight double"))
    assert memory.edges.where("type = 'analogous_to'").count() == 1
    q = spark.createDataFrame([("q", "cats purr")], "query_id string, text string")
    best = memory.recall(q, 3).orderBy("rank").collect()
    assert best[0]["node_id"] in ("a", "b") and [r["combined_score"] for r in best] == sorted((r["combined_score"] for r in best), reverse=True)
    exact = spark.createDataFrame([("q", "Dogs bark at cats.")], "query_id string, text string")
    assert memory.recall(exact, 1, "vector").first()["node_id"] in ("b", "b_0")
    assert {r["node_id"] for r in memory.trace(exact, 2).collect()}
    with pytest.raises(ValueError):
        memory.recall(q, mode="graph")
    memory.forget(spark.createDataFrame([("b",)], "node_id string"), cascade_chunks=True)
    s = memory.stats().first()
    assert s["total_nodes"] == 5 and s["deleted_nodes"] == 2
    memory.compact()
    assert memory.nodes.count() == 5 and Memory(spark, str(memory.store_.path)).nodes.count() == 5


def test_sessions(spark, memory):
    memory.create_session("s1", "A session")
    memory.store(spark.createDataFrame([("t1", "Hello to all here.", "s1"), ("t2", "More was said there.", "s1")], "node_id string, text string, session_id string"), chunks=False)
    got = {r["session_id"]: r["node_count"] for r in memory.sessions().collect()}
    assert got == {"s1": 3}
    q = spark.createDataFrame([("q", "hello")], "query_id string, text string")
    members = {r["node_id"] for r in memory.nodes.where("metadata LIKE '%s1%'").collect()}
    assert {r["node_id"] for r in memory.session_recall(q, "s1").collect()} <= members and {"t1", "t2"} < members
    hello = spark.createDataFrame([("q", "Hello to all here.")], "query_id string, text string")
    assert memory.session_recall(hello, "s1", 1).first()["node_id"] == "t1"
    summary = memory.archive_session("s1").first()
    assert "- Hello to all here." in summary["text"] and summary["text"].startswith("Archived session s1\nNode count: 3\nEdge count: 4\n") and memory.sessions().count() == 0
    told = json.loads(summary["metadata"])
    assert told["archived_node_count"] == 3 == len(told["session_node_ids"]) and told["archived_edge_count"] == 4 and {"t1", "t2"} < set(told["session_node_ids"])
    assert memory.archive_session("none").count() == 0
    assert len(tool_schemas()) == 5


def test_auto_edges(spark, memory):
    memory.store_with_auto_edges(spark.createDataFrame([("d", "Dogs bark at cats.")], "node_id string, text string"), threshold=0.99)
    kinds = {(r["source_id"], r["target_id"]) for r in memory.edges.where("type = 'derived_from'").collect()}
    assert ("d", "b") in kinds and ("d", "d_0") not in kinds


def test_session_metadata_keeps_types(spark):
    from pyspark.sql import functions as F

    from hexlode.functions.filters import metadata_filter
    from hexlode.memory import SESSION, with_key

    rows = [(1, '{"year": 2020, "tags": ["a", "b"], "deep": {"x": null}}'), (2, '{"year": 2018, "sessionId": "old"}'), (3, "[1, 2]"), (4, "no json"), (5, None), (6, "{}")]
    made = spark.createDataFrame(rows, "i int, metadata string").withColumn("metadata", with_key(F.col("metadata"), SESSION, F.lit("s1")))
    got = {r["i"]: json.loads(r["metadata"]) for r in made.collect()}
    assert got[1] == {"year": 2020, "tags": ["a", "b"], "deep": {"x": None}, "sessionId": "s1"} and got[2] == {"year": 2018, "sessionId": "s1"}
    assert got[3] == {"value": [1, 2], "sessionId": "s1"} and got[4] == {"value": "no json", "sessionId": "s1"} and got[5] == got[6] == {"sessionId": "s1"}
    assert [r["i"] for r in made.where(metadata_filter({"year": {"$gte": 2019}})).collect()] == [1]


def test_updates(spark, memory):
    before = {r["node_id"]: r for r in memory.nodes.where("NOT is_chunk").collect()}
    rows = [("a", "An old text of it.", None, 1), ("a", "Cats have gone away.", None, 3), ("a", None, '{"x": 1}', 2), ("b", None, '{"y": 2}', 1), ("zz", "There is no such node.", None, 1)]
    told = memory.update(spark.createDataFrame(rows, "node_id string, text string, metadata string, at int"), order="at")
    assert {tuple(r) for r in told.collect()} == {("a", "updated"), ("b", "updated"), ("zz", "missing")}
    after = {r["node_id"]: r for r in memory.nodes.where("NOT is_chunk").collect()}
    assert after["a"]["text"] == "Cats have gone away." and after["a"]["metadata"] == '{"x": 1}' and after["a"]["embedding"] != before["a"]["embedding"] == before["a"]["raw_embedding"]
    assert after["b"]["text"] == before["b"]["text"] and after["b"]["embedding"] == before["b"]["embedding"] and after["b"]["updated_at"] > before["b"]["updated_at"] and after["c"] == before["c"]
    q = spark.createDataFrame([("q", "Cats have gone away.")], "query_id string, text string")
    assert memory.recall(q, 1, "vector").first()["node_id"] == "a"
    memory.update(spark.createDataFrame([("c", "Without a new vector.")], "node_id string, text string"), regenerate_embedding=False)
    c = memory.nodes.where("node_id = 'c'").first()
    assert c["text"] == "Without a new vector." and c["embedding"] == before["c"]["embedding"]
    with pytest.raises(ValueError):
        memory.update(spark.createDataFrame([("a", "")], "node_id string, text string"))


def test_edges_are_changed_and_listed(spark, memory):
    from hexlode.operators import ingest

    memory.relate(spark.createDataFrame([("e1", "a", "b", "supports", 0.9), ("e2", "b", "c", "led_to", 0.4), ("e3", "a", "c", "led_to", 0.2)], "edge_id string, source_id string, target_id string, type string, weight double"))
    told = memory.update_edges(spark.createDataFrame([("e1", "related_to", None), ("e2", None, 0.7), ("no", None, 0.7)], "edge_id string, type string, weight double"))
    assert {tuple(r) for r in told.collect()} == {("e1", "updated"), ("e2", "updated"), ("no", "missing")}
    ids = spark.createDataFrame([("e1",), ("e2",)], "edge_id string")
    assert {(r["edge_id"], r["type"], r["weight"]) for r in ingest.by_id(memory.edges, ids, "edge_id").collect()} == {("e1", "analogous_to", 0.9), ("e2", "led_to", 0.7)}
    assert [r["edge_id"] for r in ingest.list_edges(memory.edges, source_id="a", type="led_to").collect()] == ["e3"]
    assert [r["edge_id"] for r in ingest.list_edges(memory.edges.where("type <> 'belongs_to'"), skip=1, limit=1).collect()] == ["e2"]
    got = {(r["edge_id"], r["neighbour_id"], r["direction"]) for r in memory.get(spark.createDataFrame([("b",), ("none",)], "node_id string")).where("edge_type <> 'belongs_to'").collect()}
    assert got == {("e1", "a", "incoming"), ("e2", "c", "outgoing")}
    for bad in (("e1", "no_type", 0.1), ("e1", "led_to", 1.1)):
        with pytest.raises(ValueError):
            memory.update_edges(spark.createDataFrame([bad], "edge_id string, type string, weight double"))
    assert {tuple(r) for r in memory.delete_edges(spark.createDataFrame([("e3",), ("x",)], "edge_id string")).collect()} == {("e3", "deleted"), ("x", "missing")}
    assert memory.edges.where("edge_id = 'e3'").isEmpty() and memory.edges.where("edge_id = 'e1'").count() == 1


def test_figures_and_imports(spark, memory):
    nodes = spark.createDataFrame([(1, 0, "n0", "Zero is here.", '{"domain": "d"}'), (1, 1, "a", "It exists.", None), (1, 2, None, "No id here.", None)], "batch int, index int, node_id string, text string, metadata string")
    edges = spark.createDataFrame([(1, 0, 0, 2, "led_to", None), (1, 1, 0, 1, "led_to", 0.5), (1, 2, 0, 0, "led_to", 0.5)], "batch int, index int, source int, target int, type string, weight double")
    assert {tuple(r) for r in memory.import_batches(nodes, edges).collect()} == {(1, "node", 1, "exists"), (1, "edge", 1, "no target"), (1, "edge", 2, "loop")}
    s = memory.stats().first()
    assert s["total_nodes"] == 9 and s["total_edges"] == 5 and s["avg_degree"] == round(10 / 9, 3) and s["edge_types"]["led_to"] == 1 and s["database_size_bytes"] > 0
    assert {tuple(r) for r in memory.domains().collect()} == {("d", 1), ("unknown", 8)}
    top = memory.most_connected(2).collect()
    assert (top[0]["node_id"], top[0]["degree"], top[0]["text_preview"]) == ("a", 2, "Cats sit on mats. They purr a lot.") and len(top) == 2


def test_conditioned_vectors(spark, tmp_path):
    import numpy as np

    m = Memory(spark, str(tmp_path / "c"), conditioned=True)
    schema = "node_id string, text string, embedding array<float>"
    m.store(spark.createDataFrame([("x", "first text", [1.0, 0.0]), ("y", "second text", [0.0, 1.0])], schema), chunks=False)
    m.store(spark.createDataFrame([("z", "third text", [1.0, 1.0])], schema), chunks=False)
    z = m.nodes.where("node_id = 'z'").first()
    want = 0.7 * np.array([1.0, 1.0]) + 0.3 * np.array([0.5, 0.5])
    assert np.allclose(z["embedding"], want / np.linalg.norm(want), atol=1e-6) and z["raw_embedding"] == [1.0, 1.0]
