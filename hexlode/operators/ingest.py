"""Ingest and changes: every function takes tables and returns tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import sentences
from ..schema import BULK_EDGES, BULK_NODES, EDGE_ALIASES, EDGE_TYPES, INGEST_TYPES, TEXT_LENGTH


def active(nodes: DataFrame) -> DataFrame:
    return nodes.where("deleted_at IS NULL")


def by_id(table: DataFrame, ids: DataFrame, id: str = "node_id") -> DataFrame:
    """The rows of a table with these ids; deleted ones don't count."""
    rows = active(table) if "deleted_at" in table.columns else table
    return rows.join(ids.select(id).distinct(), id, "left_semi").select(*table.columns)


def list_edges(edges: DataFrame, source_id=None, target_id=None, type: str | None = None, skip: int = 0, limit: int = 100) -> DataFrame:
    """Edges that meet all given predicates, in the order of their ids."""
    for name, value in (("source_id", source_id), ("target_id", target_id), ("type", type)):
        edges = edges if value is None else edges.where(F.col(name) == value)
    return edges.orderBy("edge_id").offset(skip).limit(limit)


def with_edges(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each edge at each of these nodes, out and in, with the node's columns and neighbour_id, direction, edge_id, edge_type, weight; one without them for a node that has none."""
    asked = by_id(nodes, ids)
    end = lambda at, other, way: edges.select(F.col(at).alias("_at"), F.col(other).alias("neighbour_id"), F.lit(way).alias("direction"), "edge_id", F.col("type").alias("edge_type"), "weight")
    back = end("target_id", "source_id", "incoming").where("_at <> neighbour_id")
    return asked.join(end("source_id", "target_id", "outgoing").union(back), asked["node_id"] == F.col("_at"), "left").drop("_at")


def valid_text(text: Column) -> Column:
    return F.length(text).between(*TEXT_LENGTH)


def sentence_chunks(nodes: DataFrame, id: str = "node_id", text: str = "text") -> DataFrame:
    """(node_id, text, parent_id, is_chunk) for each sentence; ids are the parent's and a number."""
    rows = nodes.select(F.col(id).cast("string").alias("parent_id"), F.posexplode(sentences(F.col(text))).alias("_i", "text"))
    return rows.select(F.concat_ws("_", "parent_id", "_i").alias("node_id"), "text", "parent_id", F.lit(True).alias("is_chunk"))


def chunk_edges(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat(F.lit("belongs_to:"), "node_id").alias("edge_id"), F.col("node_id").alias("source_id"), F.col("parent_id").alias("target_id"), F.lit("belongs_to").alias("type"), F.lit(INGEST_TYPES["belongs_to"]).alias("weight"))


def session_edges(nodes: DataFrame, session: str, order: str, id: str = "node_id") -> DataFrame:
    """next_turn and same_session edges from each session's previous node to the next."""
    before = F.lag(id).over(W.partitionBy(session).orderBy(order, id))
    pairs = nodes.where(F.col(session).isNotNull()).select(before.alias("source_id"), F.col(id).alias("target_id")).where("source_id IS NOT NULL")
    kinds = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(INGEST_TYPES[t]).alias("weight")) for t in ("next_turn", "same_session"))))
    return pairs.select("source_id", "target_id", kinds.alias("k")).select("source_id", "target_id", "k.*").withColumn("edge_id", F.concat_ws(":", "type", "source_id", "target_id"))


def ingest(nodes: DataFrame, session: str | None = None, order: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Nodes with their chunks, and the edges of both; texts of a length out of bounds are left out."""
    good = nodes.where(valid_text(F.col("text")))
    chunks = sentence_chunks(good)
    edges = chunk_edges(chunks)
    if session:
        edges = edges.unionByName(session_edges(good, session, order))
    return good.unionByName(chunks, allowMissingColumns=True), edges


def valid_edges(edges: DataFrame, nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Edges without loops, between nodes that exist, with a weight from 0 to 1 and (strict) a known type."""
    kind = F.col("type")
    for alias, name in EDGE_ALIASES.items():
        kind = F.when(F.col("type") == alias, name).otherwise(kind)
    good = edges.withColumn("type", kind).where("source_id <> target_id AND weight BETWEEN 0 AND 1")
    good = good.where(F.col("type").isin(*EDGE_TYPES)) if strict else good
    ids = active(nodes).select("node_id") if "deleted_at" in nodes.columns else nodes.select("node_id")
    return good.join(ids.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")


def missing_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ids at edges' ends that are no node."""
    ends = edges.select(F.col("source_id").alias("node_id")).union(edges.select("target_id")).distinct()
    return ends.join(nodes.select("node_id"), "node_id", "left_anti")


def bulk_nodes(nodes: DataFrame, new: DataFrame, most: int | None = BULK_NODES) -> DataFrame:
    """nodes with the new ones that have another id; a batch is most rows at most."""
    if most is not None and new.limit(most + 1).count() > most:
        raise ValueError(f"a batch is {most} nodes at most")
    return nodes.unionByName(new.dropDuplicates(["node_id"]).join(nodes.select("node_id"), "node_id", "left_anti"), allowMissingColumns=True)


def bulk_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, validate: bool = True, most: int | None = BULK_EDGES) -> DataFrame:
    """edges with the new ones; one that has no node at an end rejects them all."""
    if most is not None and new.limit(most + 1).count() > most:
        raise ValueError(f"a batch is {most} edges at most")
    if validate and (bad := missing_ends(new, nodes).take(5)):
        raise ValueError(f"no such nodes: {[r[0] for r in bad]}")
    return edges.unionByName(new, allowMissingColumns=True)


def soft_delete(nodes: DataFrame, edges: DataFrame, ids: DataFrame, at: Column | None = None, cascade_chunks: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes marked as deleted, and the edges that are left; chunks of a node stay unless cascade_chunks."""
    gone = ids.select("node_id").distinct()
    if cascade_chunks:
        gone = gone.union(nodes.join(gone.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi").select("node_id")).distinct()
    marked = nodes.join(gone.withColumn("_gone", F.lit(True)), "node_id", "left").withColumn("deleted_at", F.when(F.col("_gone"), F.coalesce("deleted_at", at if at is not None else F.localtimestamp())).otherwise(F.col("deleted_at"))).drop("_gone")
    kept = edges.join(gone.withColumnRenamed("node_id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("node_id", "target_id"), "target_id", "left_anti")
    return marked.select(*nodes.columns), kept.select(*edges.columns)


def compact(nodes: DataFrame) -> DataFrame:
    """Nodes without deleted ones; write the result as the next snapshot."""
    return active(nodes)


def needs_compaction(nodes: DataFrame, ratio: float = 0.2) -> bool:
    r = nodes.agg(F.count("*").alias("n"), F.count("deleted_at").alias("d")).first()
    return bool(r["n"]) and r["d"] / r["n"] > ratio


def latest_in_session(nodes: DataFrame, session: str, order: str, id: str = "node_id") -> DataFrame:
    return nodes.where(F.col(session).isNotNull()).groupBy(session).agg(F.max_by(id, F.struct(order, id)).alias(id))


def flatten_facts(extracted: DataFrame) -> DataFrame:
    """(session_id, fact, entities, date) from (session_id, key_facts, entities, relationships, date): a fact for each text and each triple.

    A text's entities are those named in it, in any case.
    """
    text = F.regexp_replace("_f", r"^\s+|\s+$", "")
    plain = extracted.select("session_id", "date", "entities", F.explode("key_facts").alias("_f")).withColumn("fact", text).where("fact <> ''")
    named = F.filter("entities", lambda e: (e != "") & F.lower(F.col("fact")).contains(F.lower(e)))
    triples = extracted.select("session_id", "date", F.inline("relationships")).where("trim(source) <> '' AND trim(relationship) <> '' AND trim(target) <> ''")
    joined = triples.selectExpr("session_id", "concat_ws(' ', trim(source), trim(relationship), trim(target)) AS fact", "array(trim(source), trim(target)) AS entities", "date")
    return plain.select("session_id", "fact", named.alias("entities"), "date").unionByName(joined)


def transcript(turns: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """Each session's turns as lines "[date] speaker: text", in order."""
    line = F.concat(F.lit("["), "date", F.lit("] "), "speaker", F.lit(": "), "text")
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return turns.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("transcript"))


#: Lengths of the offline stand-ins for a language model.
SUMMARY, RAW_NODE, LEAST_CHUNK = 200, 1000, 50


def extract_metadata(docs: DataFrame) -> DataFrame:
    """The stand-in for a model's metadata."""
    return docs.withColumns({"summary": F.substring("text", 1, SUMMARY), "entities": F.array().cast("array<string>"), "key_facts": F.array().cast("array<string>"), "sentiment": F.lit("neutral"), "language": F.lit("en")})


def unstructured(docs: DataFrame, least: int = 10) -> DataFrame:
    """The stand-in for a model's nodes: one of each text of least characters."""
    return docs.where(F.length("text") >= least).withColumn("text", F.substring("text", 1, RAW_NODE))


def paragraph_chunks(docs: DataFrame, id: str = "node_id") -> DataFrame:
    """Parts between blank lines, longer than 50 characters."""
    return docs.select(F.col(id), F.posexplode(F.filter(F.split("text", r"\n\s*\n"), lambda p: F.length(F.trim(p)) > LEAST_CHUNK)).alias("i", "text"))


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges (batch, source, target, ...) by index with the ids (batch, index, node_id) of what was stored; weight 0.5 unless given."""
    s, t = ids.select("batch", F.col("index").alias("source"), F.col("node_id").alias("source_id")), ids.select("batch", F.col("index").alias("target"), F.col("node_id").alias("target_id"))
    return edges.join(s, ["batch", "source"]).join(t, ["batch", "target"]).withColumn("weight", F.coalesce("weight", F.lit(0.5)))
