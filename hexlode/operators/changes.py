"""Changes to tables by key: merges of conflicting changes, and batches of imports with their rejects."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import EDGE_ALIASES, EDGE_TYPES
from .ingest import valid_text


class Merged(NamedTuple):
    """table: as it stands afterwards. changes: (key, change) of each key in the batch, change being updated, deleted or missing, for derived tables to follow."""

    table: DataFrame
    changes: DataFrame


def merge(table: DataFrame, batch: DataFrame, key: str, order: str | None = None, op: str = "op") -> Merged:
    """Puts a batch of changes into a table.

    A change has the key and any of the table's columns; null ones stay as they are. Of several changes to one column of a key that of the greatest `order` counts (any
    without an order, or of equal ones). A change whose `op` is "delete" removes the row, whatever else changes it; keys that the table lacks change nothing.
    The batch is reduced to a row for each key before it meets the table, which is shuffled once by key; rows with one key all change.
    """
    named = [c for c in batch.columns if c != key and c in table.columns]
    at = F.col(order) if order else F.lit(0)
    gone = F.max(F.col(op) == "delete") if op in batch.columns and op not in table.columns else F.lit(False)
    last = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.coalesce(gone, F.lit(False)).alias("_gone"), *(F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_new_{c}") for c in named))
    met = table.join(last, table[key] == last["_key"], "left")
    kept = met.where("NOT coalesce(_gone, false)").select(*(F.coalesce(last[f"_new_{c}"], table[c]).alias(c) if c in named else table[c] for c in table.columns))
    known = table.select(F.col(key).alias("_known")).where("_known IS NOT NULL").distinct()
    kind = F.when(F.col("_known").isNull(), "missing").when(F.col("_gone"), "deleted").otherwise("updated")
    return Merged(kept, last.join(known, last["_key"] == known["_known"], "left").select(F.col("_key").alias(key), kind.alias("change")))


class Imported(NamedTuple):
    """nodes and edges to add, and rejects (batch, kind, index, reason)."""

    nodes: DataFrame
    edges: DataFrame
    rejects: DataFrame


def _reasons(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in cases))


def import_batches(existing: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, strict: bool = True, whole: bool = False) -> Imported:
    """Batches of new_nodes(batch, index, node_id, text, ...) and new_edges(batch, index, source, target, type, weight, ...), whose ends are indexes within their batch.

    A node is rejected that exists already, repeats the id of an earlier row (by batch and index), or has a text of a length out of bounds; an edge that has an end which
    is no accepted node of its batch, or is a loop, or has a weight out of bounds (null: 0.5) or (strict) a type that isn't known. A null node_id becomes a digest
    of batch, index and text. whole: a batch with any reject is rejected as a whole.
    """
    made = F.concat(F.lit("node_"), F.substring(F.sha2(F.concat_ws("\x1f", F.col("batch").cast("string"), F.col("index").cast("string"), "text"), 256), 1, 24))
    nodes = new_nodes.withColumn("node_id", F.coalesce(F.col("node_id").cast("string"), made))
    first = nodes.groupBy("node_id").agg(F.min(F.struct("batch", "index")).alias("_first"))
    there = existing.select(F.col("node_id").cast("string").alias("node_id"), F.lit(True).alias("_there")).distinct()
    reason = _reasons((F.col("_there"), "exists"), (F.struct("batch", "index") != F.col("_first"), "repeated"), (~F.coalesce(valid_text(F.col("text")), F.lit(False)), "text"))
    nodes = nodes.join(first, "node_id", "left").join(there, "node_id", "left").withColumn("reason", reason).drop("_first", "_there")

    fine = nodes.where("reason IS NULL").select("batch", "index", "node_id")
    end = lambda name: fine.select("batch", F.col("index").alias(name), F.col("node_id").alias(f"{name}_id"))
    kind = F.coalesce(*(F.when(F.col("type") == a, F.lit(t)) for a, t in EDGE_ALIASES.items()), F.col("type"))
    edges = new_edges.withColumns({"type": kind, "weight": F.coalesce(F.col("weight").cast("double"), F.lit(0.5))}).join(end("source"), ["batch", "source"], "left").join(end("target"), ["batch", "target"], "left")
    unknown = ~F.coalesce(F.col("type").isin(*EDGE_TYPES), F.lit(False)) if strict else F.lit(False)
    edges = edges.withColumn("reason", _reasons((F.col("source_id").isNull(), "no source"), (F.col("target_id").isNull(), "no target"), (F.col("source_id") == F.col("target_id"), "loop"), (~F.col("weight").between(0, 1), "weight"), (unknown, "type")))
    if whole:
        bad = nodes.select("batch", "reason").union(edges.select("batch", "reason")).where("reason IS NOT NULL").select("batch").distinct().withColumn("_bad", F.lit(True))
        nodes, edges = (df.join(bad, "batch", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_bad"), "batch"))).drop("_bad") for df in (nodes, edges))
    rejects = [df.where("reason IS NOT NULL").select("batch", F.lit(what).alias("kind"), F.col("index").cast("long").alias("index"), "reason") for df, what in ((nodes, "node"), (edges, "edge"))]
    return Imported(nodes.where("reason IS NULL").drop("reason"), edges.where("reason IS NULL").drop("reason"), rejects[0].union(rejects[1]))
