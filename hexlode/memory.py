"""One object over a store's tables: storing, recalling, relating and forgetting, all on DataFrames."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .functions.filters import exact_filter, metadata_filter
from .functions.vectors import mock_embed
from .operators import changes, graph, hybrid, ingest, vector
from .schema import DEFAULT_ALPHA, DEFAULT_BETA, EDGE_ALIASES, EDGE_TYPES, EDGES, INGEST_TYPES, NODES, check_bounds
from .sources.store import Store

#: What an archived session's summary is made of.
ARCHIVE_NODES, ARCHIVE_SNIPPETS, SNIPPET = 50, 25, 220
#: Session members that a summary's metadata lists; of larger sessions it has the number alone.
ARCHIVE_LISTED = 1000
PREVIEW = 120
SESSION, KIND, DOMAIN = "sessionId", "kind", "domain"

#: The tools that a language model may be told of, as JSON schemas.
TOOLS = {
    "store": {"text": "string", "metadata": "object", "session_id": "string"},
    "recall": {"query": "string", "top_k": "integer", "mode": "string", "filter_metadata": "object"},
    "trace": {"concept": "string", "depth": "integer"},
    "relate": {"source_id": "string", "target_id": "string", "type": "string", "weight": "number"},
    "forget": {"node_id": "string"},
}


def tool_schemas() -> list[dict]:
    made = lambda fields: {"type": "object", "properties": {k: {"type": t} for k, t in fields.items()}, "required": list(fields)[:1]}
    return [{"name": name, "parameters": made(fields)} for name, fields in TOOLS.items()]


def with_key(metadata: Column, key: str, value: Column) -> Column:
    """metadata, a JSON object's text, with key set to a string; other values keep their types. What is no object is kept as "value"."""
    parsed = F.try_parse_json(metadata)
    plain = F.when(parsed.isNotNull(), F.create_map(F.lit("value"), parsed)).when(metadata.isNotNull(), F.create_map(F.lit("value"), metadata.cast("variant")))
    held = F.coalesce(parsed.try_cast("map<string,variant>"), plain, F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != key), F.create_map(F.lit(key), value.cast("variant"))))


class Memory:
    """Nodes and edges of a store; each change makes new tables, and save() publishes them as the next version."""

    def __init__(self, spark: SparkSession, path: str, embed=mock_embed, conditioned: bool = False) -> None:
        """conditioned: new and changed vectors are averaged with those of their most similar nodes."""
        self.spark, self.store_, self.embed, self.conditioned = spark, Store(spark, path), embed, conditioned
        published = self.store_.initialize()["version"] > 0
        self.nodes = self.store_.load("nodes") if published else spark.createDataFrame([], NODES)
        self.edges = self.store_.load("edges") if published else spark.createDataFrame([], EDGES)

    def save(self) -> int:
        version = self.store_.save(nodes=self.nodes, edges=self.edges)
        self.nodes, self.edges = self.store_.load("nodes"), self.store_.load("edges")
        return version

    # Storing

    def _made(self, rows: DataFrame) -> DataFrame:
        """rows(text, and any of node_id, metadata, embedding, session) as nodes; ids default to a digest of text and metadata."""
        now = F.localtimestamp()
        metadata = F.coalesce(F.col("metadata"), F.lit("{}")) if "metadata" in rows.columns else F.lit("{}")
        if "session_id" in rows.columns:
            metadata = F.when(F.col("session_id").isNotNull(), with_key(metadata, SESSION, F.col("session_id").cast("string"))).otherwise(metadata)
        rows = rows.withColumn("metadata", metadata)
        made = F.sha2(F.concat_ws("\x1f", "text", "metadata"), 256)
        columns = {
            "node_id": F.coalesce(F.col("node_id"), made) if "node_id" in rows.columns else made,
            "embedding": F.coalesce("embedding", self.embed(F.col("text"))) if "embedding" in rows.columns else self.embed(F.col("text")),
        }
        rows = rows.withColumns(columns)
        defaults = {"raw_embedding": F.col("embedding"), "parent_id": F.lit(None), "is_chunk": F.lit(False), "created_at": now, "updated_at": now, "deleted_at": F.lit(None)}
        return rows.select(*((F.col(f.name) if f.name in rows.columns else defaults[f.name]).cast(f.dataType).alias(f.name) for f in NODES.fields))

    def _averaged(self, new: DataFrame) -> DataFrame:
        """new nodes with their vectors averaged with those of the nodes there are, where the memory is conditioned."""
        if not self.conditioned:
            return new
        found = vector.neighbourhood_average(new.where("embedding IS NOT NULL"), known=ingest.active(self.nodes)).select("node_id", F.col("embedding").cast("array<float>").alias("_averaged"))
        return new.join(found, "node_id", "left").withColumn("embedding", F.coalesce("_averaged", "embedding")).select(*new.columns)

    def _in_session(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("session_id", F.try_variant_get(F.try_parse_json("metadata"), f"$.{SESSION}", "string")).where("session_id IS NOT NULL")

    def store(self, rows: DataFrame, chunks: bool = True) -> DataFrame:
        """Adds rows and their sentence chunks; the new nodes. Rows of a session follow its latest node, in the order of `turn` if they have it and of their ids."""
        good = rows.where(ingest.valid_text(F.col("text")))
        new = graph.settled(self._averaged(graph.settled(self._made(good).dropDuplicates(["node_id"]))))
        talks = self._in_session(new).select("node_id", "session_id")
        if not talks.isEmpty():
            turn = F.col("turn").cast("long") if "turn" in rows.columns and "node_id" in rows.columns else F.lit(0).cast("long")
            order = good.select("node_id", turn.alias("_turn")).groupBy("node_id").agg(F.min("_turn").alias("_turn")) if "node_id" in rows.columns else None
            ordered = talks.join(order, "node_id", "left") if order is not None else talks.withColumn("_turn", turn)
            before = self._in_session(ingest.active(self.nodes)).join(talks.select("session_id").distinct(), "session_id", "left_semi")
            latest = ingest.latest_in_session(before.join(new.select("node_id"), "node_id", "left_anti"), "session_id", "created_at")
            line = latest.select("node_id", "session_id", F.lit(0).alias("_new"), F.lit(0).cast("long").alias("_turn")).union(ordered.select("node_id", "session_id", F.lit(1), F.coalesce("_turn", F.lit(0).cast("long"))))
            self._add(graph.settled(ingest.session_edges(line.withColumn("_order", F.struct("_new", "_turn")), "session_id", "_order")))
        self.nodes = ingest.bulk_nodes(self.nodes, new, None)
        if chunks:
            parts = ingest.sentence_chunks(new)
            self.nodes = ingest.bulk_nodes(self.nodes, self._made(parts), None)
            self._add(ingest.chunk_edges(parts))
        return new

    def _add(self, edges: DataFrame) -> None:
        known = {f.name: F.lit(None).cast(f.dataType) for f in EDGES.fields}
        known["edge_id"] = F.sha2(F.concat_ws("\x1f", "source_id", "target_id", "type"), 256)
        known["weight"] = F.lit(1.0)
        new = edges.select(*(F.col(c).cast(EDGES[c].dataType).alias(c) if c in edges.columns else known[c].alias(c) for c in EDGES.names))
        self.edges = self.edges.unionByName(new)

    def store_with_auto_edges(self, rows: DataFrame, threshold: float = 0.7, most: int = 5) -> DataFrame:
        new = self.store(rows)
        found = vector.auto_edges(ingest.active(self.nodes), threshold, most, parent="parent_id", sources=new)
        self._add(found.withColumnsRenamed({"source_node_id": "source_id", "target_node_id": "target_id"}))
        return new

    def store_batch(self, rows: DataFrame) -> DataFrame:
        """rows with edges array<struct<target_id, type, weight>> as well."""
        new = self.store(rows.drop("edges"))
        if "edges" in rows.columns:
            self._add(rows.select(F.col("node_id").alias("source_id"), F.inline("edges")))
        return new

    def relate(self, edges: DataFrame, strict: bool = True) -> None:
        kind = F.col("type")
        for alias, name in EDGE_ALIASES.items():
            kind = F.when(kind == alias, name).otherwise(kind)
        self._add(ingest.valid_edges(edges.withColumn("type", kind), self.nodes, strict))

    def update(self, batch: DataFrame, regenerate_embedding: bool = True, order: str | None = None) -> DataFrame:
        """Puts changes (node_id, and any of text and metadata) in place, of several to one node the last by order; (node_id, change) of each. New texts get new vectors, unless told otherwise.

        A text of a length out of bounds refuses the batch. Deleted nodes count as missing.
        """
        if "text" in batch.columns and (bad := batch.where(F.col("text").isNotNull() & ~ingest.valid_text(F.col("text"))).select("node_id").take(5)):
            raise ValueError(f"texts of a length out of bounds: {[r[0] for r in bad]}")
        columns = ["node_id", *(c for c in ("text", "metadata") if c in batch.columns), *([order] if order else [])]
        rows = batch.select(*columns).withColumn("updated_at", F.localtimestamp())
        if regenerate_embedding and "text" in columns:
            rows = rows.withColumn("raw_embedding", F.when(F.col("text").isNotNull(), self.embed(F.col("text")))).withColumn("embedding", F.col("raw_embedding"))
        merged = changes.merge(ingest.active(self.nodes), rows, "node_id", order)
        told = graph.settled(merged.changes)
        after = graph.settled(merged.table)
        if self.conditioned and "embedding" in rows.columns:
            renewed = after.join(rows.where("text IS NOT NULL").select("node_id").distinct(), "node_id", "left_semi").withColumn("embedding", F.col("raw_embedding"))
            after = after.join(renewed.select("node_id"), "node_id", "left_anti").unionByName(self._averaged(graph.settled(renewed)))
        self.nodes = after.unionByName(self.nodes.where("deleted_at IS NOT NULL"))
        return told

    def update_edges(self, batch: DataFrame, strict: bool = True, order: str | None = None) -> DataFrame:
        """Puts changes (edge_id, and any of type, weight and metadata) in place; (edge_id, change) of each. A weight out of bounds or (strict) an unknown type refuses the batch."""
        rows = batch.select("edge_id", *(c for c in ("type", "weight", "metadata", order) if c and c in batch.columns))
        if "type" in rows.columns:
            rows = rows.withColumn("type", F.coalesce(*(F.when(F.col("type") == a, F.lit(t)) for a, t in EDGE_ALIASES.items()), F.col("type")))
            if strict and (bad := rows.where(~F.col("type").isin(*EDGE_TYPES, *INGEST_TYPES)).select("edge_id", "type").take(5)):
                raise ValueError(f"types that aren't known: {list(map(tuple, bad))}")
        if "weight" in rows.columns and (bad := rows.where(~F.col("weight").between(0, 1)).select("edge_id").take(5)):
            raise ValueError(f"weights out of bounds: {[r[0] for r in bad]}")
        merged = changes.merge(self.edges, rows, "edge_id", order)
        self.edges, told = graph.settled(merged.table), graph.settled(merged.changes)
        return told

    def delete_edges(self, ids: DataFrame) -> DataFrame:
        """(edge_id, change) of each, deleted or missing."""
        merged = changes.merge(self.edges, ids.select("edge_id", F.lit("delete").alias("op")), "edge_id")
        self.edges, told = graph.settled(merged.table), graph.settled(merged.changes)
        return told

    def get(self, ids: DataFrame) -> DataFrame:
        """Nodes with their edges; see ingest.with_edges."""
        return ingest.with_edges(self.nodes, self.edges, ids)

    def import_batches(self, nodes: DataFrame, edges: DataFrame, strict: bool = True, whole: bool = False) -> DataFrame:
        """Stores batches of nodes and of edges between their indexes; the rejects. See changes.import_batches."""
        done = changes.import_batches(self.nodes, nodes, edges, strict, whole)
        added, linked, rejects = graph.settled(done.nodes), graph.settled(done.edges), graph.settled(done.rejects)
        self.store(added.drop("batch", "index"), chunks=False)
        self._add(linked.select(*(c for c in linked.columns if c in EDGES.names)))
        return rejects

    def forget(self, ids: DataFrame, cascade_chunks: bool = False) -> None:
        self.nodes, self.edges = ingest.soft_delete(self.nodes, self.edges, ids, cascade_chunks=cascade_chunks)

    def compact(self) -> int:
        self.nodes = ingest.compact(self.nodes)
        return self.save()

    def clear(self) -> None:
        self.nodes, self.edges = self.nodes.limit(0), self.edges.limit(0)

    # Recalling

    def _queries(self, queries: DataFrame) -> DataFrame:
        return queries if "embedding" in queries.columns else queries.withColumn("embedding", self.embed(F.col("text")))

    def recall(
        self, queries: DataFrame, top_k: int = 10, mode: str = "hybrid", filter_metadata: Mapping[str, Any] | None = None, alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA,
        anchors: DataFrame | None = None, max_depth: int = 2, min_score: float = 0.0,
    ) -> DataFrame:
        """Results for queries(query_id, text); mode is hybrid or vector."""
        where = metadata_filter(filter_metadata) if filter_metadata else None
        nodes, asked = ingest.active(self.nodes), self._queries(queries)
        if mode == "vector":
            check_bounds(top_k=top_k, min_score=min_score)
            return vector.vector_search(nodes, asked, top_k, min_score, where, text="text")
        if mode != "hybrid":
            raise ValueError(f"mode {mode!r}: a graph search starts from a node; use trace")
        return hybrid.hybrid_search(nodes, self.edges, asked, top_k, alpha, beta, anchors, max_depth, min_score, where)

    def recall_batches(self, queries: DataFrame, top_k: int = 100, size: int = 20, **how) -> DataFrame:
        return self.recall(queries, top_k, **how).withColumn("batch", F.floor((F.col("rank") - 1) / size))

    def trace(self, queries: DataFrame, depth: int = 2) -> DataFrame:
        """What lies around each query's most similar node."""
        check_bounds(depth=depth)
        anchors = self.recall(queries, 1, "vector").select("query_id", "node_id")
        return graph.traverse(self.edges, anchors, ingest.active(self.nodes).select("node_id", "text"), depth)

    def listed(self, criteria: Mapping[str, Any] | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
        return ingest.active(self.nodes).where(exact_filter(criteria)).orderBy(F.desc("created_at"), "node_id").offset(skip).limit(limit)

    # Sessions

    def create_session(self, session_id: str, name: str, metadata: str = "{}") -> DataFrame:
        row = self.spark.createDataFrame([(name, session_id, metadata)], "text string, session_id string, metadata string")
        return self.store(row.withColumn("metadata", with_key(F.col("metadata"), KIND, F.lit("session_root"))), chunks=False)

    def _in_sessions(self) -> DataFrame:
        return self._in_session(ingest.active(self.nodes))

    def session_recall(self, queries: DataFrame, session_id: str, top_k: int = 10) -> DataFrame:
        return self.recall(queries, top_k, "vector", {SESSION: session_id})

    def recall_with_others(self, queries: DataFrame, session_id: str, top_k: int = 10, others: int = 3) -> DataFrame:
        """A session's own results, and those of a hybrid search over everything that aren't among them, told apart by `scope`."""
        own = graph.settled(self.session_recall(queries, session_id, top_k).select("query_id", "node_id", "score", "rank"))
        cross = self.recall(queries, others).select("query_id", "node_id", F.col("combined_score").alias("score"), "rank").join(own.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        return own.withColumn("scope", F.lit("session")).union(cross.withColumn("scope", F.lit("others")))

    def _inside(self, home: DataFrame) -> DataFrame:
        """(session_id, edge_count): edges between nodes (node_id, session_id) of one session."""
        inside = self.edges.join(home.withColumnsRenamed({"node_id": "source_id", "session_id": "a"}), "source_id").join(home.withColumnsRenamed({"node_id": "target_id", "session_id": "b"}), "target_id").where("a = b")
        return inside.groupBy(F.col("a").alias("session_id")).agg(F.count("*").alias("edge_count"))

    def sessions(self) -> DataFrame:
        """Each session's nodes, edges within, and first time; archived ones have none."""
        kind = F.try_variant_get(F.try_parse_json("metadata"), f"$.{KIND}", "string")
        rows = self._in_sessions().where(kind.isNull() | (kind != "session_summary"))
        counts = self._inside(rows.select("node_id", "session_id"))
        return rows.groupBy("session_id").agg(F.count("*").alias("node_count"), F.min("created_at").alias("created_at")).join(counts, "session_id", "left").fillna(0, ["edge_count"]).orderBy(F.desc("created_at"), "session_id")

    def archive_session(self, session_id: str) -> DataFrame:
        """A summary node of the session's first snippets in place of its nodes, with its counts and members; no row for a session that there isn't."""
        rows = graph.settled(self._in_sessions().where(F.col("session_id") == session_id).select("node_id", "session_id", "text", "created_at"))
        counts = rows.agg(F.count("*").alias("n")).first()["n"]
        if not counts:
            return self.nodes.limit(0)
        edges = (self._inside(rows.select("node_id", "session_id")).first() or {"edge_count": 0})["edge_count"]
        first = rows.orderBy("created_at", "node_id").limit(ARCHIVE_NODES).select(F.regexp_replace("text", r"^\s+|\s+$", "").alias("t")).where("t <> ''").collect()
        lines = "\n".join(f"- {r['t'][:SNIPPET]}" for r in first[:ARCHIVE_SNIPPETS]) or "- Session archived with no textual content."
        members = [r[0] for r in rows.select("node_id").orderBy("node_id").limit(ARCHIVE_LISTED).collect()] if counts <= ARCHIVE_LISTED else None
        told = {SESSION: session_id, KIND: "session_summary", "session_status": "archived", "archived_at": datetime.now(timezone.utc).isoformat(), "archived_node_count": counts, "archived_edge_count": edges, "session_node_ids": members}
        text = f"Archived session {session_id}\nNode count: {counts}\nEdge count: {edges}\nSummary:\n{lines}"
        self.forget(rows.select("node_id"))
        return self.store(self.spark.createDataFrame([(text, json.dumps(told))], "text string, metadata string"), chunks=False)

    # Figures

    def domains(self) -> DataFrame:
        """(domain, n): nodes by the domain in their metadata."""
        return ingest.active(self.nodes).groupBy(F.coalesce(self._domain(), F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))

    def _domain(self) -> Column:
        return F.try_variant_get(F.try_parse_json("metadata"), f"$.{DOMAIN}", "string")

    def most_connected(self, most: int = 10) -> DataFrame:
        """(node_id, degree, text_preview, domain) of the nodes with most edges."""
        return graph.most_connected(ingest.active(self.nodes).select("node_id", F.substring("text", 1, PREVIEW).alias("text_preview"), self._domain().alias("domain")), self.edges, most).select("node_id", "degree", "text_preview", "domain")

    def stats(self) -> DataFrame:
        nodes, edges = ingest.active(self.nodes).agg(F.count("*").alias("total_nodes"), F.count("embedding").alias("vector_index_size")), self.edges.agg(F.count("*").alias("total_edges"))
        deleted = self.nodes.agg(F.count("deleted_at").alias("deleted_nodes"))
        kinds = self.edges.groupBy("type").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("edge_types"))  # a row for each type
        degree = graph.average_degree(ingest.active(self.nodes), self.edges)
        all_ = nodes.crossJoin(edges).crossJoin(deleted).crossJoin(kinds).crossJoin(degree)
        return all_.withColumns({"avg_edges_per_node": F.coalesce(F.round(F.try_divide("total_edges", "total_nodes"), 2), F.lit(0.0)), "database_size_bytes": F.lit(self.store_.folder.size())})
