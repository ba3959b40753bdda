"""Hybrid ranking of a batch of queries: combined = alpha * V + beta * G.

V is a candidate's best cosine over itself and its chunks plus a quarter of its lexical overlap, 1 at most; candidates come from
vectors and from BM25. G is its graph proximity to the query's anchors, or to its three best candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import strip, tokens
from ..schema import DEFAULT_ALPHA, DEFAULT_BETA, check_bounds
from ..shared import settled
from . import bm25, graph, vector

BOOST = 0.25
#: A lexical candidate's base score, at most.
LEXICAL_BASE = 0.65


def pool(top_k: int, filtered: bool = False) -> tuple[int, int]:
    """How many vector and how many fused candidates are kept."""
    wanted = max(40, 2 * top_k * (5 if filtered else 3))
    return wanted, max(100, wanted)


@dataclass(frozen=True)
class Condition:
    """One setting of the ranking. Without vector, candidates come from BM25 alone; without expand, none are added from the graph and the three best are the references, whatever the anchors."""

    name: str = "hybrid"
    alpha: float = DEFAULT_ALPHA
    beta: float = DEFAULT_BETA
    boost: float = BOOST
    expand: bool = True
    vector: bool = True


#: The conditions of the ablation; "averaged" vectors are the caller's.
ABLATION = (
    Condition("vector", 0.6, 0.0, 0.0, False), Condition("bm25", 1.0, 0.0, 1.0, False, False), Condition("vector_bm25", 0.6, 0.0, 0.25, False), Condition("graph_rerank", 0.6, 0.4, 0.25, False),
    Condition("full", 0.6, 0.4, 0.25, True),
)


def _pooled(nodes: DataFrame, queries: DataFrame, top_k: int, where: Column | None, stem: bool, parent: str | None) -> DataFrame:
    """(query_id, node_id, parent, cosine, lexical, share): the candidates of vectors and of BM25, for any condition; texts are tokenised once for it, and shares are counted where groups of queries meet groups of documents."""
    _, kept = pool(top_k, where is not None)
    rows = nodes.where(where) if where is not None else nodes
    near = vector.vector_search(rows, queries, kept, 0.0).select("query_id", "node_id", F.col("score").alias("cosine"))
    index = bm25.build(nodes, stem=stem)
    lexical = bm25.search(index, queries, kept, stem=stem, among=rows if where is not None else None).select("query_id", "node_id", F.lit(True).alias("lexical"))
    up = F.col(parent).alias("_parent") if parent else F.lit(None).alias("_parent")
    both = settled(near.join(lexical, ["query_id", "node_id"], "full_outer").join(rows.select("node_id", F.col("text").isNull().alias("_null"), up), "node_id"))
    words = both.join(bm25.shares(index, queries, both, stem=stem), ["query_id", "node_id"], "left").join(queries.select("query_id", F.size(F.array_distinct(tokens(F.col("text"), stem))).alias("_n")), "query_id")
    share = F.when(~F.coalesce(F.col("_n") > 0, F.lit(False)), 0.0).when(~F.col("_null"), F.coalesce("share", F.lit(0.0)))
    return words.select("query_id", "node_id", "_parent", "cosine", F.coalesce("lexical", F.lit(False)).alias("lexical"), share.alias("share"))


def _conditions(rows: DataFrame, table: Sequence[Condition]) -> DataFrame:
    """rows once for each condition, with its values in columns of their names and its place in `_c`."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), *(F.lit(getattr(c, f.name)).alias(f.name) for f in fields(Condition))) for i, c in enumerate(table))))
    return rows.select("*", each.alias("_x")).select(*rows.columns, "_x.*")


def _scored(pooled: DataFrame, nodes: DataFrame, table: Sequence[Condition], kept: int, parent: str | None) -> DataFrame:
    """(_c, query_id, node_id, v, rank): each condition's candidates with chunks rolled up into their parents."""
    rows = _conditions(pooled, table).where("vector OR lexical").withColumn("cosine", F.when(F.col("vector"), F.col("cosine")))
    base = F.coalesce("cosine", F.when(F.col("boost") > 0, F.least(F.lit(LEXICAL_BASE), "share")).otherwise(0.0))
    scored = rows.select("_c", "query_id", "node_id", "_parent", (base + F.col("boost") * F.col("share")).alias("v"))
    if parent:
        scored = scored.groupBy("_c", "query_id", F.coalesce("_parent", "node_id").alias("node_id")).agg(F.max("v").alias("v")).join(nodes.select("node_id"), "node_id", "left_semi")
    scored = scored.select("_c", "query_id", "node_id", F.round(F.least(F.lit(1.0), "v"), vector.DECIMALS).alias("v"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("_c", "query_id").orderBy(F.desc("v"), "node_id"))).where(F.col("rank") <= kept)


def candidates(nodes: DataFrame, queries: DataFrame, top_k: int, where: Column | None = None, boost: float = BOOST, stem: bool = False, parent: str | None = "parent_id") -> DataFrame:
    """(query_id, node_id, v, rank): the best candidates with chunks rolled up into their parents."""
    return _scored(_pooled(nodes, queries, top_k, where, stem, parent), nodes, [Condition(boost=boost)], pool(top_k, where is not None)[1], parent).drop("_c")


def search_conditions(
    nodes: DataFrame, edges: DataFrame, queries: DataFrame, table: Sequence[Condition] = ABLATION, top_k: int = 10, anchors: DataFrame | None = None, max_depth: int = 2,
    min_score: float = 0.0, where: Column | None = None, deduplicate: bool = True, stem: bool = False, parent: str | None = "parent_id",
) -> DataFrame:
    """(condition, query_id, node_id, vector_score, graph_score, combined_score, rank) of each condition for queries(query_id, text, embedding): candidates are searched for once, and all graph searches are one batch."""
    for c in table:
        check_bounds(top_k=top_k, vector_weight=c.alpha, graph_weight=c.beta, max_depth=max_depth, min_score=min_score)
    kept = pool(top_k, where is not None)[1]
    pooled = _pooled(nodes, queries, top_k, where, stem, parent)
    found = graph.settled(_scored(graph.settled(pooled) if len(table) > 1 else pooled, nodes, table, kept, parent).withColumn("_q", F.struct("_c", "query_id")))
    widened = [i for i, c in enumerate(table) if c.expand]
    rows = nodes.where(where) if where is not None else nodes
    best = found.where("rank <= 3").select("_q", "node_id")
    if anchors is not None and widened:
        asked = _conditions(anchors.select("query_id", "node_id"), table).where("expand").select(F.struct("_c", "query_id").alias("_q"), "node_id")
        best = asked.union(best.join(asked.select("_q").distinct(), "_q", "left_anti"))
    references = graph.settled(best.distinct().withColumnRenamed("_q", "query_id"))
    fused = found.select(F.col("_q").alias("query_id"), "node_id", "v")
    if widened:
        from_ = references.where(F.col("query_id._c").isin(widened))
        reached = graph.bfs(edges, from_, max_depth).select("query_id", "node_id").union(from_).distinct().join(rows.select("node_id"), "node_id", "left_semi")
        fused = fused.unionByName(reached.select("query_id", "node_id").join(fused.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").withColumn("v", F.lit(0.0)))
    fused = fused.join(graph.proximity(edges, fused, references, max_depth), ["query_id", "node_id"])
    weight = lambda name: F.element_at(F.array(*(F.lit(getattr(c, name)) for c in table)), F.col("query_id._c") + 1)
    scored = fused.withColumn("combined", F.round(weight("alpha") * F.col("v") + weight("beta") * F.col("proximity"), vector.DECIMALS))
    if deduplicate:
        # equal texts by their digests, which are written, as a join would make them anew for each candidate
        scored = scored.join(settled(nodes.select("node_id", F.md5(strip(F.col("text"))).alias("_text"))), "node_id")
        scored = scored.withColumn("_p", F.row_number().over(W.partitionBy("query_id", "_text").orderBy(F.desc("combined"), "node_id"))).where("_p = 1")
    scored = scored.where(F.col("combined") >= min_score).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("combined"), "node_id"))).where(F.col("rank") <= top_k)
    return scored.select(weight("name").alias("condition"), "query_id.query_id", "node_id", F.round("v", 4).alias("vector_score"), F.round("proximity", 4).alias("graph_score"), F.round("combined", 4).alias("combined_score"), "rank")


def hybrid_search(
    nodes: DataFrame, edges: DataFrame, queries: DataFrame, top_k: int = 10, alpha: float = DEFAULT_ALPHA, beta: float = DEFAULT_BETA, anchors: DataFrame | None = None, max_depth: int = 2,
    min_score: float = 0.0, where: Column | None = None, deduplicate: bool = True, expand: bool = True, boost: float = BOOST, stem: bool = False, parent: str | None = "parent_id",
) -> DataFrame:
    """(query_id, node_id, vector_score, graph_score, combined_score, rank) for queries(query_id, text, embedding)."""
    return search_conditions(nodes, edges, queries, [Condition("hybrid", alpha, beta, boost, expand)], top_k, anchors, max_depth, min_score, where, deduplicate, stem, parent).drop("condition")


def with_reasons(results: DataFrame) -> DataFrame:
    text = "vector %.4f, graph %.4f, combined %.4f"
    return results.withColumn("reasoning", F.format_string(text, "vector_score", "graph_score", "combined_score"))


def compare_modes(nodes: DataFrame, edges: DataFrame, queries: DataFrame, anchors: DataFrame, top_k: int = 10, **how) -> DataFrame:
    """(query_id, mode, node_id, score, rank) of vector, graph (depth 2 from the anchors) and hybrid search."""
    v = vector.vector_search(nodes, queries, top_k, text="text").select("query_id", F.lit("vector").alias("mode"), "node_id", "score", "rank")
    reached = graph.traverse(edges, anchors).join(nodes.select("node_id"), "node_id", "left_semi")
    g = reached.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("depth", "node_id"))).where(F.col("rank") <= top_k)
    g = g.select("query_id", F.lit("graph").alias("mode"), "node_id", F.col("graph_score").alias("score"), "rank")
    h = hybrid_search(nodes, edges, queries, top_k, anchors=anchors, **how).select("query_id", F.lit("hybrid").alias("mode"), "node_id", F.col("combined_score").alias("score"), "rank")
    return v.union(g).union(h)


def mode_overlap(results: DataFrame) -> DataFrame:
    """For each query how many of the modes' results are in which of the others."""
    held = results.groupBy("query_id", "node_id").agg(*(F.max(F.col("mode") == m).alias(m[0]) for m in ("vector", "graph", "hybrid")))
    count = lambda e, name: F.count(F.when(F.expr(e), 1)).alias(name)
    return held.groupBy("query_id").agg(count("v AND NOT h", "vector_only"), count("g AND NOT h", "graph_only"), count("h AND NOT v AND NOT g", "hybrid_unique"), count("v AND g AND h", "all_three"), count("h AND (v OR g)", "hybrid_shared"))
