"""Mixing sources to target weights by Pfair scheduling.

The rows of each source, in the order of a hash of their doc_id, are cut into blocks. Each slot takes one block; a source's
fluid share of the slots so far follows the exact weights of the sources that haven't run out yet. A block is released when its
source's share reaches it and due when it has passed it; earliest-deadline-first then keeps every source within less than
one block of its share at every slot, in integer arithmetic. Where a source runs out, the others go on with their weights in
proportion, so all rows are kept. Any number of sources will do.

Counts by source meet at the driver, and 8 bytes for each block (16 rows) there and in a broadcast. With slots given, weights are
rounded to parts of so many slots instead (a source has one part at least), so the schedule repeats and only counts by source are
held; shares are then off by the rounding. Ranks within a source come from counts of hash ranges, so no task holds a source.

Sources without a weight (a null source, too) get the mean weight of those that have one. Null and empty texts are rows like others; repeated
rows follow each other. An empty table gives no rows. All columns of the input are kept, but for those named as mix() names its own.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Mapping
from fractions import Fraction
from math import fsum, lcm

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut

BLOCK = 16
SLOTS = 4096
#: Blocks of a source whose slots are sent as one row.
CHUNK = 1024
#: Rows of a hash range that are ranked together, about; and hash ranges up to which their list is broadcast.
RANGE, BROADCAST_ROWS = 4000, 1_000_000


def parts(weights: Mapping[str | None, float], slots: int = SLOTS) -> dict[str | None, int]:
    """Whole parts of slots, one at least, by largest remainder."""
    if len(weights) > slots:
        raise ValueError(f"{len(weights)} sources; {slots} slots hold one of each at most")
    total, spare = sum(weights.values()), slots - len(weights)
    exact = {k: spare * v / total for k, v in weights.items()}
    out = {k: 1 + int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k is None, k))[: slots - sum(out.values())]:
        out[k] += 1
    return out


def earliest_deadlines(share: Mapping[str | None, int]) -> list[str | None]:
    """The source of each of sum(share) slots: released blocks, earliest deadline first."""
    slots = sum(share.values())
    names = sorted(share, key=lambda k: (k is None, k))
    waiting = [(0, i, 0) for i in range(len(names))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * slots // share[names[i]]), i, j))
        deadline, i, j = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        out.append(names[i])
        heapq.heappush(waiting, ((j + 1) * slots // share[names[i]], i, j + 1))
    return out


def phases(blocks: Mapping[str | None, int], weights: Mapping[str | None, float], slots: int = SLOTS) -> list[tuple]:
    """Rows (source, phase's first slot, its first block of the source, its blocks, parts, cycle).

    In a phase block b of a source, counted from its first, has the slot start + slots * (b // parts) + cycle[b % parts].
    """
    left, start, out = {k: n for k, n in blocks.items() if n}, 0, []
    done = dict.fromkeys(left, 0)
    while left:
        share = parts({k: weights[k] for k in left}, slots)
        cycle: dict[str | None, list[int]] = {k: [] for k in left}
        for t, k in enumerate(earliest_deadlines(share)):
            cycle[k].append(t)
        slot = lambda k, b: slots * (b // share[k]) + cycle[k][b % share[k]]  # noqa: B023, E731
        length = min(slot(k, left[k] - 1) for k in left) + 1
        for k in left:
            full, rest = divmod(length, slots)
            taken = full * share[k] + sum(t < rest for t in cycle[k])
            out.append((k, start, done[k], taken, share[k], cycle[k]))
            done[k] += taken
            left[k] -= taken
        left = {k: n for k, n in left.items() if n}
        start += length
    return out


def exact_slots(blocks: Mapping[str | None, int], weights: Mapping[str | None, float]) -> dict[str | None, array]:
    """The slot of each block of each source, by exact weights.

    At virtual time v a source of weight w has had the share min(w * v, its blocks); slots are the sum of the shares. Between two
    times at which sources run out, that sum is linear in v.
    """
    names = sorted((k for k, n in blocks.items() if n), key=lambda k: (k is None, k))
    exact = [Fraction(w) if isinstance(w := weights[k], (int, Fraction)) else Fraction(float(w)) for k in names]
    scale = lcm(*(x.denominator for x in exact))
    weight, size = [int(x * scale) for x in exact], [blocks[k] for k in names]
    ended, active = [0], [sum(weight)]  # by the number of sources that have run out: their blocks, the others' weight
    ends = sorted((Fraction(n, w), i) for i, (n, w) in enumerate(zip(size, weight, strict=True)))
    for _, i in ends:
        ended.append(ended[-1] + size[i])
        active.append(active[-1] - weight[i])
    near = [float(v * scale) for v, _ in ends]

    def shared(i: int, j: int, up: int) -> int:
        """The slots at the virtual time j / weight[i], rounded down, or up."""
        e, w = bisect_left(near, j * scale / weight[i]), weight[i]
        while e and (v := ends[e - 1][0]).numerator * w >= j * v.denominator:
            e -= 1
        while e < len(ends) and (v := ends[e][0]).numerator * w < j * v.denominator:
            e += 1
        x = j * active[e]
        return ended[e] + (-(-x // w) if up else x // w)

    out = [array("q") for _ in names]
    waiting = [(0, i) for i in range(len(names))]  # release, source
    ready: list[tuple[int, int]] = []  # deadline, source
    for t in range(sum(size)):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (shared(i, len(out[i]) + 1, 1), i))
        deadline, i = heapq.heappop(ready)
        if deadline <= t:
            raise AssertionError("a deadline was missed")
        out[i].append(t)
        if len(out[i]) < size[i]:
            heapq.heappush(waiting, (shared(i, len(out[i]), 0), i))
    return dict(zip(names, out, strict=True))


#: Columns that mix() adds, in place of any of these names.
ADDED = ("_slot", "_block", "_at")


class _Schedule:
    """A mixture of the rows of docs: how many each source has, and the slot of each of its blocks."""

    def __init__(self, docs: DataFrame, weights: Mapping[str | None, float] | None, source: str, block: int, slots: int | None) -> None:
        self.spark, self.block, self.slots, self.kind = docs.sparkSession, block, slots, docs.schema[source].dataType.simpleString()
        counts = docs.groupBy(docs[source].alias("s")).agg(F.count("*").alias("n")).collect()  # a row for each source
        self.sizes = {r["s"]: r["n"] for r in counts}
        if not self.sizes:
            return
        given = {k: w for k, w in (weights or {k: n**0.5 for k, n in self.sizes.items()}).items() if w > 0}
        mean = fsum(given.values()) / len(given)
        self.blocks, self.weight = {k: -(-n // block) for k, n in self.sizes.items()}, {k: given.get(k, mean) for k in self.sizes}
        self.number = {k: i for i, k in enumerate(self.sizes)}

    def spread(self, rows: DataFrame) -> DataFrame:
        """rows(__source, __key, ...) with __hash, __k (the source's number) and __range, a range of hashes of about RANGE rows of a source."""
        ranges = F.broadcast(self.spark.createDataFrame([(k, self.number[k], 1 + n // RANGE) for k, n in self.sizes.items()], f"__s {self.kind}, __k int, __ranges long"))
        out = rows.withColumn("__hash", F.xxhash64("__key")).join(ranges, F.col("__source").eqNullSafe(F.col("__s")))
        return out.withColumn("__range", F.floor(F.shiftrightunsigned("__hash", 31) * F.col("__ranges") / F.lit(2.0**33))).drop("__s", "__ranges")

    def ranked(self, spread: DataFrame, ties: bool = False) -> DataFrame:
        """spread with __rank within its source; with ties, rows of one hash share the least rank."""
        held = spread.groupBy("__k", "__range").agg(F.count("*").alias("__n"))
        before = F.sum("__n").over(W.partitionBy("__k").orderBy("__range").rowsBetween(W.unboundedPreceding, -1))
        held = held.select("__k", "__range", F.coalesce(before, F.lit(0)).alias("__before"))
        inside = W.partitionBy("__k", "__range")
        place = F.rank().over(inside.orderBy("__hash")) if ties else F.row_number().over(inside.orderBy("__hash", "__key"))
        return spread.withColumn("__in", place - 1).join(held, ["__k", "__range"]).withColumn("__rank", F.col("__in") + F.col("__before"))

    def slotted(self, ranked: DataFrame) -> DataFrame:
        """ranked with __slot, __block and __at."""
        ranked = ranked.withColumn("__block", F.floor(F.col("__rank") / self.block)).withColumn("__at", F.col("__rank") % self.block)
        place = F.col("__block") - F.col("__first")
        if self.slots is None:
            rows = [(self.number[k], c // CHUNK, c, at[c : c + CHUNK].tolist()) for k, at in exact_slots(self.blocks, self.weight).items() for c in range(0, len(at), CHUNK)]
            table = F.broadcast(self.spark.createDataFrame(rows, "__p int, __chunk long, __first long, __slots array<long>", verifySchema=False))
            out = ranked.join(table, (F.col("__k") == F.col("__p")) & (F.floor(F.col("__block") / CHUNK) == F.col("__chunk")))
            return out.withColumn("__slot", F.get("__slots", place.cast("int")))
        rows = [(self.number[k], *rest) for k, *rest in phases(self.blocks, self.weight, self.slots)]
        cycles = F.broadcast(self.spark.createDataFrame(rows, "__p int, __start long, __first long, __taken long, __parts long, __cycle array<int>"))
        out = ranked.join(cycles, (F.col("__k") == F.col("__p")) & (place >= 0) & (place < F.col("__taken")))
        return out.withColumn("__slot", F.col("__start") + self.slots * F.floor(place / F.col("__parts")) + F.get("__cycle", (place % F.col("__parts")).cast("int")))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, slots: int | None = None) -> DataFrame:
    """docs with _slot, _block (of its source) and _at (in its block), in place of columns of these names; ordering by _slot and _at gives the mixture.

    weights default to the square roots of the sources' sizes; with slots, they are rounded to parts of so many.
    """
    plan, kept = _Schedule(docs, weights, source, block, slots), [docs[c] for c in docs.columns if c not in ADDED]
    if not plan.sizes:
        return docs.select(*kept, *(F.lit(0).cast("long").alias(c) for c in ADDED))
    out = plan.slotted(plan.ranked(plan.spread(docs.withColumns({"__source": docs[source], "__key": docs[key]}))))
    return out.select(*kept, *(F.col("_" + c).alias(c) for c in ADDED))


def mixed_order(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, slots: int | None = None) -> DataFrame:
    """docs in the order of their mixture, from partition to partition and within each.

    Sources and keys alone are ranked first; of that the least hash and rank of each source in each output partition are kept
    (a list for each hash range), by which whole rows find their partition, so they are shuffled once.
    """
    plan = _Schedule(docs, weights, source, block, slots)
    if not plan.sizes:
        return docs
    total = sum(plan.blocks.values())
    n = max(1, min(int(plan.spark.conf.get("spark.sql.shuffle.partitions")), total))
    narrow = plan.slotted(plan.ranked(plan.spread(docs.select(docs[source].alias("__source"), docs[key].alias("__key"))), ties=True))
    bounds = narrow.groupBy("__k", "__range", F.floor(F.col("__slot") * n / total).cast("int").alias("to")).agg(F.min("__hash").alias("from"), F.min("__rank").alias("rank"))
    bounds = cut(bounds.groupBy("__k", "__range").agg(F.sort_array(F.collect_list(F.struct("from", "to", "rank"))).alias("__bounds")))
    rows = plan.spread(docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs[source].alias("__source"), docs[key].alias("__key")))
    rows = rows.join(F.broadcast(bounds) if bounds.count() <= BROADCAST_ROWS else bounds, ["__k", "__range"])
    rows = rows.withColumn("__bound", F.element_at(F.filter("__bounds", lambda b: b["from"] <= F.col("__hash")), -1)).drop("__bounds", "__source")
    rows = rows.select("*", "__bound.to", "__bound.rank").drop("__bound").repartitionById(n, F.col("to"))
    inside = F.row_number().over(W.partitionBy("to", "__k", "__range").orderBy("__hash", "__key")) - 1
    out = plan.slotted(rows.withColumn("__rank", inside + F.col("rank")))
    return out.sortWithinPartitions("__slot", "__at").select("__row.*")
