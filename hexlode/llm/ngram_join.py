"""Jaccard self-join of documents' word n-grams: a size-aware, heavy-light join, and the components of its links.

Small (light) sets list all their subsets of the sizes that a partner must share; two light sets link only if they list a
common one. Large (heavy) sets are found through inverted lists: elements are ordered with frequent ones last, a set enters the
lists of its first n - ceil(J n) + l elements (J the least Jaccard index, 0.85 by default; l = 1 + n / 50, rounded down), and two sets that link meet in as many lists as
the l of the smaller one says. A set that is in fewer lists of others than the l of its smallest partner links with nothing and leaves all lists. Light sets near the boundary enter
lists too. The boundary is the size at which listing subsets begins to cost more than scanning lists, by the counts of sizes
and the lengths of lists measured in the corpus.

Sets meet first at two members of each list, those with the least and the greatest hash; verified links give components, and this
is done again with eight other pivots while that leaves a tenth fewer pairs of members in different components. At the end
all pairs of members of one list that are still in different components are checked, so no link between components is lost. A pair is checked by parity bitmaps first (the bits in which two bitmaps differ are a lower bound of
the sets' symmetric difference, so no link is lost), those that are left by bitmaps of eight times as many bits, then by the sets themselves. Equal sets are one node throughout.

Frequent elements are those seen often enough that a million of them at most can exist; any order gives the same links, so
their counts need not be exact. Words and sets are compared by 64-bit hashes.

Null, empty and blank texts have no set and link with nothing; so do rows with a null doc_id, whose component_id is null.
Texts of fewer words than an n-gram have one element. Repeated rows get equal results. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WordHasher, cut, discard, keep, mixed, rolled, scratch
from .components import components

WORDS = 4
PERCENT = 85
#: At most so many frequent elements exist, since each holds a share of 1 / HOT of all elements; their list is broadcast (8 bytes each).
HOT = 1_000_000
#: Elements that a task counts at once, and the least local count that it reports.
COUNTED, REPORTED = 1 << 22, 4
#: A set meets its partners in one list more for each so many of its elements.
MORE = 50
#: Pivots of each kind in a list after the first round, and the percentage of pairs in different components that a round must leave at most for another one.
PIVOTS, LEFT = 4, 90
#: A member's last lists that are compared so that a pair is made in one list rather than in all that its members share.
SEEN = 4
#: Members of a list that are compared with each other in one task.
SPLIT = 1024
#: Rows of 16 bytes up to which a table of nodes is broadcast.
BROADCAST_ROWS = 1_000_000
#: The bits of the second bitmaps, of those of the first.
FINER = 8
#: The columns of a set's bitmap folded to 256 bits.
SKETCH = [f"s{i}" for i in range(4)]
_SHORT, _SUBSET = np.uint64(0x8CB92BA72F3D8DD7), 0xC2B2AE3D27D4EB4F


def shingles(hasher: WordHasher, text: str | None, k: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of k words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hasher(words)
    return rolled(h, len(h)) ^ _SHORT if len(h) < k else np.unique(rolled(h, k))


def fits(percent: int = PERCENT) -> str:
    """Sizes, and parities of 256 bits (s and t), that allow a link, as SQL."""
    apart = " + ".join(f"bit_count(s{i} ^ t{i})" for i in range(4))
    return f"{percent} * greatest(n, m) <= 100 * least(n, m) AND {apart} <= n + m - 2 * (({percent} * (n + m) + {99 + percent}) div {100 + percent})"


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap at which sets of a and b elements link."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_sizes(n: int, percent: int = PERCENT) -> list[int]:
    return sorted({c for b in partners(n, percent) if (c := needed(n, b, percent)) <= min(n, b)})


def meetings(n: int) -> int:
    """In how many lists a set of n elements meets each of its partners that are no smaller."""
    return 1 + n // MORE


def prefix(n: int, percent: int = PERCENT) -> int:
    """How many lists a set enters: of the elements it shares with a partner, the first meetings() ones are among its first so many."""
    return min(n, n - -(-percent * n // 100) + meetings(n))


def subsets(n: int, percent: int = PERCENT) -> int:
    """How many subsets a light set of n elements lists."""
    return sum(comb(n, c) for c in subset_sizes(n, percent))


def dearest(scanned: float, percent: int = PERCENT) -> int:
    """The size from which on a single set's subsets cost more than scanning all lists; no larger set can be light. It grows with the logarithm of scanned."""
    x = 1
    while subsets(x, percent) <= scanned:
        x += 1
    return x


def boundary(sizes: dict[int, int], scan: float, percent: int = PERCENT) -> int:
    """The size up to which sets are light: the least sum of subsets listed below it and list entries scanned above it."""
    cost = total = sum(n * prefix(s, percent) * scan for s, n in sizes.items())
    best = 0
    for x in range(1, dearest(cost, percent)):
        total += sizes.get(x, 0) * (subsets(x, percent) - prefix(x, percent) * scan)
        if total <= cost:
            best, cost = x, total
    return best


def parity(elements: np.ndarray, finer: int = 1) -> bytes:
    """A bitmap of the parities of the elements' counts, of half a bit to one bit an element, or finer times that; one of a larger set folds onto a smaller one's by xor.

    Sets that have nothing in common differ in about a quarter of n bits at least, where a link allows 0.16 n at 85 per cent.
    """
    bits = finer * max(256, 1 << max(0, len(elements) // 2 - 1).bit_length())
    at = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by their bitmaps."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def sketch(bitmap: bytes) -> list[int]:
    """A bitmap folded to 256 bits, as four signed numbers."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, dtype=np.int64).reshape(-1, 4), axis=0).tolist()


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _marked(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """df with __maybe, which is false only where column isn't in ids(__id); 64 bits in each of BROADCAST_ROWS rows at most are broadcast, however many ids there are."""
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(64 * BROADCAST_ROWS))
    bits = ids.select(at(F.col("__id")).alias("h")).groupBy(F.expr("h div 64").alias("__word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("__bits"))
    both = df.withColumn("__at", at(df[column])).join(F.broadcast(bits), F.expr("__at div 64 = __word"), "left")
    return both.withColumn("__maybe", F.expr("coalesce(getbit(__bits, cast(__at % 64 as int)) = 1, false)")).drop("__at", "__word", "__bits")


def among(df: DataFrame, column: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose column is in ids(__id), or with left_anti all others. Whole rows are shuffled only where column may be in ids and these are too many to be broadcast."""
    if ids.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(ids), df[column] == F.col("__id"), how)
    marked = _marked(df, column, ids)
    found = marked.where("__maybe").join(ids, marked[column] == F.col("__id"), how)
    return (found if how == "left_semi" else found.union(marked.where("not __maybe"))).drop("__maybe")


def _ends(pairs: DataFrame) -> DataFrame:
    return cut(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def _summaries(words: int):
    """(doc_id, n, node, bitmap, its sketch) of each document with a set; rows without doc_id report local counts of elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, size = WordHasher(), set(), [], 0
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.int64()] * 4)
        names = ("doc_id", "n", "node", "bitmap", "elements", "counts", "s0", "s1", "s2", "s3")
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def counted() -> pa.RecordBatch:
            e, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= REPORTED
            out = made([(None, int(c.sum()), int((c * c).sum()), None, _signed(e[often]), c[often], *[None] * 4)])
            held.clear()
            return out

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(hasher, text, words)
                if not len(s) or doc_id is None:
                    continue
                node = _node(s)
                new = node not in seen
                bitmap = parity(s) if new else None
                rows.append((doc_id, len(s), node, bitmap, None, None, *(sketch(bitmap) if new else [None] * 4)))
                if new:
                    seen.add(node)
                    held.append(s)
                    size += len(s)
            if rows:
                yield made(rows)
            if size >= COUNTED:
                yield counted()
                size = 0
        if held:
            yield counted()

    return run


def _keys(limit: int, hot: tuple[np.ndarray, np.ndarray], words: int, percent: int):
    """Each set's subset keys and list entries; those of frequent elements apart."""
    often, counts = hot
    least_listed = -(-percent * (limit + 1) // 100)

    def of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, plain, frequent = len(s), [], np.empty(0, dtype=np.uint64)
        if n <= limit:
            for c in subset_sizes(n, percent):
                for some in combinations(s.tolist(), c):
                    plain.append(xxhash.xxh3_64_intdigest(np.array(some, dtype=np.uint64).tobytes(), seed=_SUBSET))
        listed = np.empty(0, dtype=np.uint64)
        if n > limit or n >= least_listed:
            at = np.searchsorted(often, s)
            at[at == len(often)] = 0
            is_hot = often[at] == s if len(often) else np.zeros(n, dtype=bool)
            h = s[is_hot]
            k = prefix(n, percent)
            listed = mixed(s[~is_hot])
            listed = np.sort(listed)[:k]
            if len(listed) < k:
                frequent = mixed(h[np.lexsort((h, counts[at[is_hot]]))][: k - len(listed)])
        return np.concatenate([np.array(plain, dtype=np.uint64), listed]), frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingles(hasher, text, words)
                if not len(s) or doc_id is None or (node := _node(s)) in seen:
                    continue
                seen.add(node)
                rows.append((node, *map(_signed, of(s))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["node", "keys", "frequent"])

    return run


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in batches:
            rows = []
            for (text,) in zip(batch.column(0).to_pylist(), strict=True):
                s = shingles(hasher, text, words)
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    rows.append((node, len(s), parity(s, FINER), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["node", "n", "bitmap", "elements"])

    return run


def _by_bitmap(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = [int(a + b) - 2 * needed(int(a), int(b), percent) for a, b in zip(n, m, strict=True)]
            keep = [differing(x, y) <= d for x, y, d in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _by_sets(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                keep.append(len(np.intersect1d(a, b, assume_unique=True)) >= needed(len(a), len(b), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


class Join:
    """The join over docs(doc_id, text): nodes are distinct sets of runs of words, linked at percent of their union."""

    def __init__(self, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> None:
        self.words, self.percent = words, percent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.spark = docs.sparkSession
        made = cut(self.docs.mapInArrow(_summaries(words), "doc_id long, n long, node long, bitmap binary, elements array<long>, counts array<long>, s0 long, s1 long, s2 long, s3 long"))
        self.members = made.where("doc_id is not null").select("doc_id", "n", "node")
        self.counts = made.where("doc_id is null")
        self.nodes = cut(made.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bitmap", ignorenulls=True).alias("bitmap"), *(F.first(f"s{i}", ignorenulls=True).alias(f"s{i}") for i in range(4))))

    def hot(self) -> tuple[tuple[np.ndarray, np.ndarray], float]:
        """Frequent elements, sorted, with their counts; and the mean length of the list that an element is in."""
        total = self.counts.agg(F.sum("n").alias("n"), F.sum("node").alias("square")).first()
        if not total["n"]:
            return (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)), 1.0
        pairs = self.counts.select(F.explode(F.arrays_zip("elements", "counts")).alias("x")).select("x.elements", "x.counts")
        found = pairs.groupBy("elements").agg(F.sum("counts").alias("c")).where(F.col("c") > max(REPORTED, total["n"] // HOT)).toPandas()  # HOT rows at most
        found["elements"] = found["elements"].astype("int64").to_numpy().view(np.uint64)
        found = found.sort_values("elements")
        return (found["elements"].to_numpy(np.uint64), found["c"].to_numpy(np.int64)), total["square"] / total["n"]

    def postings(self) -> DataFrame:
        """(key, node, n, sketch, seen) of all lists of two nodes or more, without nodes that are in too few; a key stands for its members."""
        hot, scan = self.hot()
        words, percent = self.words, self.percent
        scanned = (self.nodes.agg(F.sum(F.expr(f"least(n, n - (({percent} * n + 99) div 100) + 1 + n div {MORE})"))).first()[0] or 0) * scan
        sizes = {r["n"]: r["count"] for r in self.nodes.where(F.col("n") < dearest(scanned, percent)).groupBy("n").count().collect()}  # a row for each size below dearest()
        limit = boundary(sizes, scan, percent)
        shared = self.spark.sparkContext.broadcast(hot)

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _keys(limit, shared.value, words, percent)(batches)

        with scratch(self.spark):
            made = cut(self.docs.mapInArrow(keyed, "node long, keys array<long>, frequent array<long>"))
            plain = made.select("node", F.explode("keys").alias("key"))
            member, by_key = F.xxhash64("node"), W.partitionBy("key")
            # Near copies meet in many lists of the same members; these are one list from here on.
            lists = [F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(member).alias("x"), F.count("*").alias("c")]
            plain = plain.select("node", *(f.over(by_key).alias(name) for f, name in zip((F.min("node"), F.max("node"), F.bit_xor(member), F.count("*")), "abxc", strict=True))).where("a <> b")
            often = made.select("node", F.explode("frequent").alias("key"))
            # Frequent elements' lists may hold any share of all sets: aggregated, and joined back with their bounded number of keys.
            heads = often.groupBy("key").agg(*lists).where("a <> b")
            often = often.join(F.broadcast(heads), "key")
            both = plain.select("node", "x", "c", "a", "b").union(often.select("node", "x", "c", "a", "b"))
            entries = both.select(F.xxhash64("x", "c", "a", "b").alias("key"), "node").groupBy("key", "node").agg(F.count("*").alias("times"))
            # Two members who met in one of the lists before this one, in the order of keys, needn't meet again.
            of, along = W.partitionBy("node"), W.partitionBy("node").orderBy("key")
            before_it = F.array_compact(F.array(*(F.lag("key", i).over(along) for i in range(1, SEEN + 1))))
            entries = entries.join(self.nodes.select("node", "n", *SKETCH), "node").withColumns({"times": F.sum("times").over(of), "seen": before_it})
            entries = entries.where(f"n <= {limit} or times >= 1 + (({percent} * n + 99) div 100) div {MORE}")
            return keep(entries.drop("times").hint("rebalance", "key"))  # so that partial aggregates by key are small; large lists are split

    def fitting(self, pairs: DataFrame) -> DataFrame:
        """Pairs (u, n, v, m) whose sizes allow a link, each once, as u < v."""
        return pairs.where(f"u <> v and {fits(self.percent)}").selectExpr("least(u, v) AS u", "greatest(u, v) AS v").distinct()

    def _alike(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        """The pairs (u, v) that the bitmaps in info(node, n, bitmap) leave."""
        both = pairs.join(info.select(F.col("node").alias("u"), "n", F.col("bitmap").alias("x")), "u").join(info.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("bitmap").alias("y")), "v")
        return both.select("u", "v", "n", "m", "x", "y").mapInArrow(_by_bitmap(self.percent), "u long, v long")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) that link. Bitmaps and sets are moved only for nodes that are in a pair."""
        with scratch(self.spark):
            some = self.nodes.join(_small(_ends(pairs)), "node", "left_semi")
            info = cut(some.select("node", "n", "bitmap"))
            left = cut(self._alike(pairs, info))
            wanted = cut(self.nodes.join(_small(_ends(left)), "node", "left_semi").select(F.col("doc_id").alias("__id")))
            texts = among(self.docs, "doc_id", wanted).select("text")
            sets = cut(texts.mapInArrow(_whole_sets(self.words), "node long, n long, bitmap binary, elements binary"))
            if sets.count() > wanted.count():  # rows that repeat a doc_id, in several tasks
                sets = sets.dropDuplicates(["node"])
            left, sets = cut(self._alike(left, sets)), sets.select("node", "elements")
            both = left.join(sets.withColumnsRenamed({"node": "v", "elements": "y"}), "v").join(sets.withColumnsRenamed({"node": "u", "elements": "x"}), "u")
            return keep(both.select("u", "v", "x", "y").mapInArrow(_by_sets(self.percent), "u long, v long"))

    def links(self) -> DataFrame:
        """Links (u, v) between nodes that have the components of all links."""
        held = self.postings()
        entries, rounds, before = held.count(), 0, float("inf")
        placed, links, checked = held.withColumn("root", F.col("node")), None, None
        twin = [F.col("node").alias("v"), F.col("n").alias("m"), F.col("root").alias("other"), *(F.col(f"s{i}").alias(f"t{i}") for i in range(4))]
        while True:
            member = lambda i: F.struct(F.xxhash64("node", F.lit(i + 100 * rounds)).alias("h"), *twin)
            some = range(PIVOTS if rounds else 1)
            picked = [f(member(i)).alias(f"{name}{i}") for i in some for name, f in (("least", F.min), ("most", F.max))]
            pivots = placed.groupBy("key").agg(*picked).select("key", F.array_distinct(F.array(*(f"{name}{i}" for i in some for name in ("least", "most")))).alias("pivots"))
            met = placed.join(pivots, "key").select("node", "n", "root", *SKETCH, F.explode("pivots").alias("p")).selectExpr("node AS u", "n", "root", *SKETCH, "p.*")
            pairs = self.fitting(met.where("root <> other"))
            pairs = cut(pairs if checked is None else pairs.join(checked, ["u", "v"], "left_anti"))
            new = self.verified(pairs)
            links, checked = (new, pairs) if links is None else (links.union(new), checked.union(pairs))
            roots = components(links)
            rooted = cut(placed.drop("root", "k").join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node")))
            discard(held, roots)
            # A list of three has met in whole: its two pivots of the first round are different.
            shares = rooted.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("k"), F.sum(F.col("c") * F.col("c")).alias("s")).where("k * k > s AND k > 3")
            open_lists = cut(shares)
            apart = open_lists.agg(F.sum((F.col("k") * F.col("k") - F.col("s")) / 2)).first()[0] or 0
            placed = held = cut(rooted.join(_small(open_lists.select("key", "k")), "key"))
            discard(rooted, open_lists)
            rounds += 1
            if apart <= entries or 100 * apart > LEFT * before:
                break
            before = apart
        # Lists are dealt once, and each meets itself; those of more than SPLIT members are cut into parts, and every two parts meet in a group of their own.
        other, apart_and_fit = [F.col("seen").alias("met"), *twin], f"root < other AND {fits(self.percent)} AND NOT arrays_overlap(seen, met)"
        short = placed.where(F.col("k") <= SPLIT).select("key", "node", "n", "root", *SKETCH, "seen").repartition("key")
        joined = short.join(short.select("key", *other), "key").where(apart_and_fit)
        parts = placed.where(F.col("k") > SPLIT).withColumn("parts", F.ceil(F.col("k") / SPLIT).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        parts = parts.withColumn("far", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        one = parts.select("key", F.col("own").alias("one"), F.col("far").alias("two"), "node", "n", "root", *SKETCH, "seen")
        two = parts.select("key", F.col("far").alias("one"), F.col("own").alias("two"), *other)
        joined = joined.drop("key").union(one.join(two, ["key", "one", "two"]).where(apart_and_fit).drop("key", "one", "two"))
        pairs = self.fitting(joined.selectExpr("node AS u", "n", "v", "m", *SKETCH, "t0", "t1", "t2", "t3"))
        return links.union(self.verified(cut(pairs.join(checked, ["u", "v"], "left_anti"))))


def classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    with scratch(docs.sparkSession):
        join = Join(docs, words, percent)
        roots = components(join.links())
        placed = join.nodes.join(roots, "node", "left").select("node", "n", "doc_id", F.coalesce("root", "node").alias("root"))
        least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        found = placed.join(least, "root").select("node", "component_id")
        sized = join.members.distinct().join(found, "node").groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component_id").alias("component_id"))
        ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        return keep(ids.join(sized, "doc_id", "left").select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that aren't their component's smallest doc_id; documents without a set stay."""
    gone = classes(docs, words, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return among(docs, "doc_id", gone, "left_anti")
