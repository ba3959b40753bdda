"""Graph operators over edges(edge_id, source_id, target_id, type, weight), for batches of starting nodes.

Loops keep a frontier and what was reached; each round is written to the shared folder, so plans stay short and lost
executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame, Window as W, functions as F

from ..shared import settled

BOTH = ("outgoing", "incoming", "both")


def graph_edges(edges: DataFrame, latest: str = "created_at") -> DataFrame:
    """One edge for each (source, target): the latest one, then that with the greatest id."""
    order = [F.desc(c) for c in ((latest,) if latest in edges.columns else ())] + [F.desc("edge_id")]
    place = F.row_number().over(W.partitionBy("source_id", "target_id").orderBy(*order))
    return edges.withColumn("_p", place).where("_p = 1").drop("_p")


def directed(edges: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """(src, dst) along the direction, filtered by type first."""
    e = edges.where(F.col("type").isin(list(types))) if types is not None else edges
    out, back = e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst")), e.select(F.col("target_id").alias("src"), F.col("source_id").alias("dst"))
    if direction == "outgoing":
        return out.distinct()
    return (back if direction == "incoming" else out.union(back)).distinct() if direction in BOTH else out.limit(0)


def bfs(edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """(query_id, node_id, depth, path) of nodes reached from starts(query_id, node_id), the start left out; of shortest paths the least."""
    steps = settled(directed(edges, direction, types))
    frontier = starts.select("query_id", "node_id", F.lit(0).alias("depth"), F.array("node_id").alias("path")).dropDuplicates(["query_id", "node_id"])
    reached = frontier
    for d in range(1, depth + 1):
        found = frontier.join(steps, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"), F.concat("path", F.array("dst")).alias("path"))
        found = found.groupBy("query_id", "node_id").agg(F.min("path").alias("path")).join(reached.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
        frontier = settled(found.select("query_id", "node_id", F.lit(d).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        reached = reached.union(frontier)
    return reached.where("depth > 0")


def traverse(edges: DataFrame, starts: DataFrame, nodes: DataFrame | None = None, depth: int = 2, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """bfs with graph_score 1 / (1 + depth), for nodes that exist."""
    found = bfs(edges, starts, depth, direction, types).withColumn("graph_score", F.round(1 / (1 + F.col("depth")), 4))
    return found if nodes is None else found.join(nodes, "node_id")


def incident(edges: DataFrame, starts: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """Edges at starts(node_id), with a direction label and the neighbour."""
    e = edges.where(F.col("type").isin(list(types))) if types is not None else edges
    columns = ["edge_id", "type", "weight"]
    out = e.select(F.col("source_id").alias("node_id"), F.col("target_id").alias("neighbour_id"), F.lit("outgoing").alias("direction"), *columns)
    back = e.select(F.col("target_id").alias("node_id"), F.col("source_id").alias("neighbour_id"), F.lit("incoming").alias("direction"), *columns)
    rows = out if direction == "outgoing" else back if direction == "incoming" else out.union(back)
    return rows.join(starts.select("node_id").distinct(), "node_id", "left_semi")


def neighbours(edges: DataFrame, starts: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """Each neighbour once with its first edge: outgoing ones first, then by edge id."""
    order = W.partitionBy("node_id", "neighbour_id").orderBy(F.desc("direction"), "edge_id")
    return incident(edges, starts, direction, types).withColumn("_p", F.row_number().over(order)).where("_p = 1").drop("_p")


def component(edges: DataFrame, starts: DataFrame, most: int = 100, depth: int = 10) -> DataFrame:
    """(query_id, node_id): nodes of the undirected component, the start first, then by depth and id; most of them."""
    found = bfs(edges, starts, depth).select("query_id", "node_id", "depth").union(starts.select("query_id", "node_id", F.lit(0)))
    return found.withColumn("_p", F.row_number().over(W.partitionBy("query_id").orderBy("depth", "node_id"))).where(F.col("_p") <= most).select("query_id", "node_id", "depth")


def _nearest(edges: DataFrame, anchors: DataFrame, max_depth: int) -> DataFrame:
    """(query_id, node_id, d): the least number of directed steps from or to an anchor, of nodes within max_depth."""
    ways = [bfs(edges, anchors, max_depth, way).select("query_id", "node_id", "depth") for way in ("outgoing", "incoming")]
    seeds = anchors.select("query_id", "node_id", F.lit(0).alias("depth"))
    return seeds.union(ways[0]).union(ways[1]).groupBy("query_id", "node_id").agg(F.min("depth").alias("d"))


def proximity(edges: DataFrame, candidates: DataFrame, anchors: DataFrame, max_depth: int = 3) -> DataFrame:
    """(query_id, node_id, proximity): 1 for an anchor, else 1 / (1 + d) of the shortest directed path from or to an anchor, 0 beyond max_depth."""
    joined = candidates.select("query_id", "node_id").distinct().join(_nearest(edges, anchors, max_depth), ["query_id", "node_id"], "left")
    return joined.select("query_id", "node_id", F.round(F.when(F.col("d").isNull(), 0.0).otherwise(1 / (1 + F.col("d"))), 4).alias("proximity"))


def proximity_of_all(edges: DataFrame, nodes: DataFrame, anchors: DataFrame, max_depth: int = 3) -> DataFrame:
    """proximity() of every one of nodes(node_id) for every query of anchors: each node holds its few near queries, and all pairs are made last, without a shuffle of theirs."""
    near = _nearest(edges, anchors, max_depth).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("query_id", F.round(1 / (1 + F.col("d")), 4).alias("p")))).alias("near"))
    rows = nodes.select("node_id").distinct().join(near, "node_id", "left").repartition(4 * nodes.sparkSession.sparkContext.defaultParallelism, "node_id")
    pairs = rows.crossJoin(F.broadcast(anchors.select("query_id").distinct()))  # the queries' ids alone
    return pairs.select("query_id", "node_id", F.coalesce(F.try_element_at("near", F.col("query_id")), F.lit(0.0)).alias("proximity"))


def _whole(one: DataFrame, other: DataFrame) -> DataFrame:
    """(query_id, _t, b): paths through the nodes that states of the first side in one and of the second in other share."""
    f = one.where("side = 0").select("query_id", "_t", "node_id", F.col("b").alias("f"))
    g = other.where("side = 1").select("query_id", "_t", "node_id", F.col("b").alias("g"))
    add = lambda c: F.round(F.col(f"f.{c}") + F.col(f"g.{c}"), 9).alias(c)
    path = F.concat("f.path", F.slice("g.path", 2, F.size("g.path"))).alias("path")
    return f.join(g, ["query_id", "_t", "node_id"]).select("query_id", "_t", F.struct(add("cost"), (F.col("f.hops") + F.col("g.hops")).alias("hops"), path, add("total")).alias("b"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, weighted: bool = True, rounds: int | None = None) -> DataFrame:
    """(query_id, path, length, cost, total_weight) for pairs(query_id, source_id, target_id), along edges, at a cost of 1 / max(weight, 0.01) each.

    Of paths of one cost that with fewer hops, then the least, is taken; costs are rounded so that sums in another order tie.
    A pair is searched from both ends, a hop a round, the end with far more nodes waiting. After i and j hops the best path of up to i + j is known; a longer one goes through nodes that
    were reached or improved in the last hop of either end, so that a pair is done when either has none, and a node goes no further whose cost and the other
    end's least are beyond the best path. More rounds than given, if so, raise an error.
    """
    cost = F.round(1 / F.greatest(F.col("weight"), F.lit(0.01)), 9) if weighted else F.lit(1.0)
    steps = settled(edges.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), cost.alias("step"), F.col("weight").cast("double").alias("w")))
    least = steps.agg(F.min("step")).first()[0] or 0.0
    both = steps.select(F.lit(0).alias("side"), F.col("src").alias("node_id"), F.col("dst").alias("to"), "step", "w").union(steps.select(F.lit(1), "dst", "src", "step", "w"))
    key, state = ["query_id", "_t"], ["query_id", "_t", "side", "node_id"]
    asked = pairs.select("query_id", F.col("target_id").alias("_t"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("source_id").alias("node_id")), F.struct(F.lit(1).alias("side"), F.col("target_id").alias("node_id")))).alias("x"))
    zero = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("node_id").alias("path"), F.lit(0.0).alias("total"))
    best = settled(asked.select(*key, "x.*").distinct().select(*state, zero.alias("b")))
    frontier, result = best, settled(_whole(best, best))
    for done in count():
        here = lambda side, x: F.when(F.col("side") == side, x)
        waiting = frontier.groupBy(*key).agg(F.count(here(0, 1)).alias("nf"), F.count(here(1, 1)).alias("ng"), F.min(here(0, F.col("b.cost"))).alias("cf"), F.min(here(1, F.col("b.cost"))).alias("cg")).where("nf > 0 AND ng > 0")
        known = waiting.join(result.select(*key, F.col("b.cost").alias("bound")), key, "left")
        ahead = F.col("b.cost") + here(0, F.col("cg")).otherwise(F.col("cf")) + least
        live = frontier.join(known, key).where(F.col("bound").isNull() | (ahead <= F.col("bound") + 1e-6))
        live = settled(live.select(*state, "b", here(0, F.col("nf") <= 2 * F.col("ng")).otherwise(F.col("ng") <= 2 * F.col("nf")).alias("goes")))
        if live.isEmpty():
            break
        grown = live.where("goes").join(both, ["side", "node_id"]).where(~F.array_contains("b.path", F.col("to")))
        path = here(0, F.concat("b.path", F.array("to"))).otherwise(F.concat(F.array("to"), F.col("b.path")))
        new = F.struct(F.round(F.col("b.cost") + F.col("step"), 9).alias("cost"), (F.col("b.hops") + 1).alias("hops"), path.alias("path"), F.round(F.col("b.total") + F.col("w"), 9).alias("total"))
        found = grown.select(*key, "side", F.col("to").alias("node_id"), new.alias("b")).groupBy(*state).agg(F.min("b").alias("n"))
        better = settled(found.join(best, state, "left").where("b IS NULL OR n < b").select(*state, F.col("n").alias("b")))
        if rounds is not None and done >= rounds and not better.isEmpty():
            raise RuntimeError(f"paths are still improved after {rounds} rounds")
        best = settled(best.join(live.select(*key).distinct(), key, "left_semi").join(better, state, "left_anti").union(better))
        result = settled(result.union(_whole(better, best)).union(_whole(best, better)).groupBy(*key).agg(F.min("b").alias("b")))
        frontier = better.union(live.where("NOT goes").select(*state, "b"))
    ends = pairs.select("query_id", F.col("target_id").alias("_t"))
    return result.join(ends, key).select("query_id", "b.path", F.col("b.hops").alias("length"), F.round("b.cost", 4).alias("cost"), F.round("b.total", 4).alias("total_weight"))


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges along each path(query_id, path), in order."""
    steps = paths.select("query_id", F.posexplode("path").alias("position", "source_id"), "path").withColumn("target_id", F.get("path", F.col("position") + 1)).where("target_id IS NOT NULL").drop("path")
    return steps.join(edges.select("source_id", "target_id", "edge_id", "type", "weight"), ["source_id", "target_id"])


def weighted_proximity(edges: DataFrame, candidates: DataFrame, anchors: DataFrame, type_weights: dict[str, float], max_depth: int = 3) -> DataFrame:
    """proximity plus 0.1 of each edge's type weight along the cheapest path from an anchor, 1 at most; the best over anchors."""
    base = proximity(edges, candidates, anchors, max_depth)
    c, a = candidates.select("query_id", F.col("node_id").alias("target_id")).distinct(), anchors.select("query_id", F.col("node_id").alias("source_id")).distinct()
    pairs = a.join(c, "query_id").withColumn("_q", F.col("query_id")).withColumn("query_id", F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("source_id").cast("string"), F.col("target_id").cast("string")))
    along = path_edges(shortest_paths(edges, pairs), edges)
    weights = F.coalesce(*[F.when(F.col("type") == k, F.lit(float(v))) for k, v in type_weights.items()], F.lit(0.0))
    extra = along.groupBy("query_id").agg(F.sum(0.1 * weights).alias("extra")).join(pairs, "query_id").groupBy(F.col("_q").alias("query_id"), F.col("target_id").alias("node_id")).agg(F.max("extra").alias("extra"))
    joined = base.join(extra, ["query_id", "node_id"], "left")
    return joined.select("query_id", "node_id", F.round(F.when(F.col("proximity") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("proximity") + F.coalesce("extra", F.lit(0.0)))), 4).alias("proximity"))


def kinds(edges: DataFrame) -> DataFrame:
    """(type, n) after parallel edges are one."""
    return graph_edges(edges).groupBy("type").agg(F.count("*").alias("n"))


def most_connected(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """nodes(node_id, ...) with degree, the most connected first, those without edges included."""
    known = nodes.join(degrees(edges).select("node_id", "degree"), "node_id", "left")
    return known.withColumn("degree", F.coalesce("degree", F.lit(0))).orderBy(F.desc("degree"), "node_id").limit(most)


def average_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(avg_degree): edges' ends at nodes by the number of nodes, to three decimals."""
    known = nodes.select("node_id").join(degrees(edges), "node_id", "left")
    return known.agg(F.coalesce(F.round(F.try_divide(F.coalesce(F.sum("degree"), F.lit(0)), F.count("*")), 3), F.lit(0.0)).alias("avg_degree"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree, degree) of nodes with an edge."""
    ends = edges.select(F.col("source_id").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(edges.select("target_id", F.lit(1), F.lit(0)))
    return ends.groupBy("node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))
