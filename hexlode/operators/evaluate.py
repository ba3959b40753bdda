"""Retrieval quality over ranked(query_id, node_id, rank, ...) and qrels(query_id, node_id), or a Relevance; all measures for all queries in one plan."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import settled

#: Bits that a passage's anchor is hashed to.
ANCHOR_BITS = 20
#: The weights of an ablation.
WEIGHTS = ((0.1, 0.9), (0.2, 0.8), (0.3, 0.7), (0.4, 0.6), (0.5, 0.5), (0.6, 0.4), (0.7, 0.3), (0.8, 0.2), (0.9, 0.1), (1.0, 0.0))
RELEVANT = 0.3


def _words4(x: np.ndarray) -> np.ndarray:
    """The four bytes from each place on, as one number."""
    two = x[:-1].astype(np.uint16) | (x[1:].astype(np.uint16) << np.uint16(8))
    return two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))


def _holds(passages: list[tuple[int, bytes]]):
    """Rows (node_id, text as bytes) to (node_id, place) of each passage that a text holds. Passages are looked for by eight bytes from their middle, all at once, and then compared whole."""
    short, anchored = [(i, p) for i, p in passages if len(p) < 8], defaultdict(list)
    for i, p in passages:
        if len(p) >= 8:
            m = len(p) // 2 - 4
            anchored[p[m : m + 8]].append((i, m, p))
    slot = lambda w: (w * np.uint32(2654435761)) >> np.uint32(32 - ANCHOR_BITS)
    first, last = np.zeros(1 << ANCHOR_BITS, dtype=bool), np.zeros(1 << ANCHOR_BITS, dtype=bool)
    for a in anchored:
        first[slot(np.frombuffer(a[:4], np.uint32))] = True
        last[slot(np.frombuffer(a[4:], np.uint32))] = True

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, places, texts = [], [], b.column(1).to_pylist()
            for r, t in enumerate(texts):
                found = {i for i, p in short if p in t}
                if anchored and len(t) >= 8:
                    w = _words4(np.frombuffer(t, np.uint8))
                    at = np.flatnonzero(first[slot(w[:-4])])
                    for q in at[last[slot(w[at + 4])]].tolist():
                        found.update(i for i, m, p in anchored.get(t[q : q + 8], ()) if q >= m and t.startswith(p, q - m))
                rows += [r] * len(found)
                places += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(places, pa.int64())], names=["node_id", "place"])

    return held


def holding(nodes: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, node_id) of nodes(node_id, text) whose text holds the text of a row of passages(query_id, text), a benchmark's few hundred, which all tasks know: each text is read once for all of them."""
    known = passages.select("query_id", F.col("text").cast("binary").alias("t")).where("t IS NOT NULL").collect()
    ids = nodes.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(known)], f"place long, query_id {dict(passages.dtypes)['query_id']}")
    texts = nodes.select("node_id", F.col("text").cast("binary").alias("t")).where("t IS NOT NULL")
    found = texts.mapInArrow(_holds([(i, bytes(r["t"])) for i, r in enumerate(known)]), f"node_id {dict(nodes.dtypes)['node_id']}, place long")
    return found.join(F.broadcast(ids), "place").select("query_id", "node_id")


@dataclass(frozen=True)
class Relevance:
    """Which nodes are relevant to which queries, without the pairs where these are too many: the number of each query's, and rel, 1 or 0, for the rows of ranked(query_id, node_id, ...)."""

    totals: DataFrame  # query_id, relevant
    marked: Callable[[DataFrame], DataFrame]


def by_pairs(qrels: DataFrame) -> Relevance:
    wanted = qrels.select("query_id", "node_id").distinct()
    totals = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    return Relevance(totals, lambda ranked: ranked.join(wanted.withColumn("rel", F.lit(1)), ["query_id", "node_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))))


def by_label(nodes: DataFrame, queries: DataFrame, label: str = "label") -> Relevance:
    """Relevant to a row of queries(query_id, label) are the rows of nodes(node_id, label) with an equal label; null labels equal nothing, and rows of one id have all their labels.

    Pairs grow with the square of the table, so none is made: nodes are counted by their labels, and a ranked row's two labels are compared.
    """
    sets = lambda df, id, name: df.where(F.col(label).isNotNull()).groupBy(id).agg(F.sort_array(F.collect_set(label)).alias(name))
    held, asked = sets(nodes, "node_id", "_held"), sets(queries, "query_id", "_asked")
    counts = held.groupBy("_held").agg(F.count("*").alias("n")).withColumn("_label", F.explode("_held"))
    met = asked.select("_asked").distinct().withColumn("_label", F.explode("_asked")).join(counts, "_label").select("_asked", "_held", "n").distinct()
    totals = asked.join(met.groupBy("_asked").agg(F.sum("n").alias("relevant")), "_asked").select("query_id", "relevant")

    def marked(ranked: DataFrame) -> DataFrame:
        known = ranked.join(asked, "query_id", "left").join(held, "node_id", "left")
        return known.withColumn("rel", F.coalesce(F.arrays_overlap("_asked", "_held").cast("int"), F.lit(0))).drop("_asked", "_held")

    return Relevance(totals, marked)


def metrics(ranked: DataFrame, qrels: DataFrame | Relevance, k: int = 10, by: tuple[str, ...] = (), divisor: str = "retrieved") -> DataFrame:
    """(by..., query_id, precision, recall, hit, mrr, ndcg) for every query with a relevant node; divisor "k" divides by k always."""
    keys = [*by, "query_id"]
    judged = qrels if isinstance(qrels, Relevance) else by_pairs(qrels)
    totals, marked = judged.totals, judged.marked(ranked)
    within = (F.col("rank") <= k) & (F.col("rel") == 1)
    sums = marked.groupBy(*keys).agg(
        F.count(F.when(F.col("rank") <= k, 1)).alias("got"), F.count(F.when(within, 1)).alias("hits"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg")
    )
    systems = ranked.select(*by).distinct() if by else None
    base = totals.crossJoin(F.broadcast(systems)) if by else totals  # a few systems
    joined = base.join(sums, keys, "left").na.fill(0, ["got", "hits"]).na.fill(0.0, ["dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    bottom = F.lit(k) if divisor == "k" else F.col("got")
    return joined.select(
        *keys, F.round(F.when(bottom > 0, F.col("hits") / bottom).otherwise(0.0), 6).alias("precision"), F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"), (F.col("hits") > 0).cast("int").alias("hit"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"),
    )


def summary(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return per_query.groupBy(*by).agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "mrr", "ndcg")), F.count("*").alias("queries"))


def pooled_relevance(results: DataFrame, threshold: float = RELEVANT) -> DataFrame:
    """(query_id, node_id) found by two systems or more, or with a score of threshold or more."""
    votes = results.groupBy("query_id", "node_id").agg(F.countDistinct("mode").alias("n"), F.max("score").alias("best"))
    return votes.where((F.col("n") >= 2) | (F.col("best") >= threshold)).select("query_id", "node_id")


def compare_systems(results: DataFrame, k: int = 10) -> DataFrame:
    """Each mode's mean measures against pooled relevance, the improvement of its nDCG on vector search in per cent, and the best mode."""
    per_query = metrics(results, pooled_relevance(results), k, by=("mode",), divisor="k")
    means = summary(per_query, ("mode",)).withColumn("value", F.col("ndcg") + F.col("precision"))
    best = means.agg(F.max_by("mode", "value").alias("winner"), F.max(F.when(F.col("mode") == "vector", F.col("ndcg"))).alias("base"))
    gain = (F.col("ndcg") - F.col("base")) / F.greatest(F.col("base"), F.lit(0.001)) * 100
    return means.crossJoin(F.broadcast(best)).select("mode", "precision", "recall", "mrr", "ndcg", F.round(gain, 4).alias("ndcg_gain"), "winner")


def weight_ablation(scored: DataFrame, qrels: DataFrame | Relevance, k: int = 10, weights=WEIGHTS) -> DataFrame:
    """Mean measures for each pair of weights over scored(query_id, node_id, v, g): one plan for all pairs."""
    from pyspark.sql import Window as W

    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in weights)))
    rows = scored.select("query_id", "node_id", "v", "g", grid.alias("w")).select("query_id", "node_id", "w.*", F.round(F.col("w.alpha") * F.col("v") + F.col("w.beta") * F.col("g"), 6).alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("alpha", "beta", "query_id").orderBy(F.desc("score"), "node_id"))).where(F.col("rank") <= k)
    return summary(metrics(settled(ranked), qrels, k, by=("alpha", "beta")), ("alpha", "beta"))  # read twice


def effectiveness(results: DataFrame, qrels: DataFrame | Relevance, k: int = 10) -> DataFrame:
    """(mode, precision, recall, mrr, ndcg, coverage, relevant_finds, avg_score, score_variance, queries): each mode's means over the queries with a relevant node, for results(mode, query_id, node_id, score, rank).

    Coverage is the share of a query's relevant nodes that are found; scores' variance is that of the population; means have four decimals.
    """
    top = results.where(F.col("rank") <= k)
    judged = qrels if isinstance(qrels, Relevance) else by_pairs(qrels)
    measured = metrics(top, judged, k, by=("mode",), divisor="k")
    found = judged.marked(top).where("rel = 1").groupBy("mode", "query_id").agg(F.count("*").alias("finds"))
    scores = top.groupBy("mode", "query_id").agg(F.avg("score").alias("avg_score"), F.var_pop("score").alias("variance"))
    joined = measured.join(found, ["mode", "query_id"], "left").join(scores, ["mode", "query_id"], "left").join(judged.totals, "query_id")
    zero = lambda c: F.coalesce(c, F.lit(0))
    means = {"coverage": zero(F.col("finds")) / F.col("relevant"), "relevant_finds": zero(F.col("finds")), "avg_score": zero(F.col("avg_score")), "score_variance": zero(F.col("variance"))}
    return joined.groupBy("mode").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "mrr", "ndcg")), *(F.round(F.avg(c), 4).alias(n) for n, c in means.items()), F.count("*").alias("queries"))


def domain_correct(results: DataFrame, domains: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(mode, query_id, correct): the share of k results that are of the query's domain; domains(node_id, domain), wanted(query_id, domain)."""
    right = results.where(F.col("rank") <= k).join(domains.select("node_id", F.col("domain").alias("_own")), "node_id").join(wanted.select("query_id", "domain"), "query_id")
    return right.groupBy("mode", "query_id").agg(F.round(F.count(F.when(F.col("_own") == F.col("domain"), 1)) / k, 4).alias("correct"))


def hidden_gems(results: DataFrame, pairs: DataFrame, k: int = 10) -> DataFrame:
    """pairs(query_id, node_id) with vector_rank and hybrid_rank, and whether hybrid search alone has found the node."""
    rank = lambda mode: F.min(F.when((F.col("mode") == mode) & (F.col("rank") <= k), F.col("rank"))).alias(f"{mode}_rank")
    held = results.groupBy("query_id", "node_id").agg(rank("vector"), rank("hybrid"))
    joined = pairs.join(held, ["query_id", "node_id"], "left")
    return joined.withColumn("hidden_gem", F.col("hybrid_rank").isNotNull() & F.col("vector_rank").isNull())


def divergence(results: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """(query_id, set_diff, top1_changed, promoted, demoted) between two modes' results."""
    one = results.where((F.col("mode") == a) & (F.col("rank") <= k)).select("query_id", "node_id", F.col("rank").alias("r"))
    two = results.where((F.col("mode") == b) & (F.col("rank") <= k)).select("query_id", "node_id", F.col("rank").alias("s"))
    joined = one.join(two, ["query_id", "node_id"], "full_outer")
    first = F.min_by("node_id", "r"), F.min_by("node_id", "s")
    return joined.groupBy("query_id").agg(
        F.count(F.when(F.col("r").isNull(), 1)).alias("set_diff"), (~F.coalesce(first[0] == first[1], F.lit(False))).cast("int").alias("top1_changed"), F.count(F.when(F.col("s") < F.col("r"), 1)).alias("promoted"), F.count(F.when(F.col("s") > F.col("r"), 1)).alias("demoted")
    )


def latency(values: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, deviations and exact, linearly interpolated percentiles."""
    p = lambda q: F.round(F.percentile(column, F.lit(q)), 6)
    return values.groupBy(*by).agg(F.round(F.avg(column), 6).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.min(column).alias("least"), F.max(column).alias("most"), F.round(F.stddev_pop(column), 6).alias("sd_pop"), F.round(F.var_samp(column), 6).alias("var_samp"))
