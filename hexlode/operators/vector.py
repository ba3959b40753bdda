"""Vector search and joins. Similarities are computed as matrix products, a task for each pair of groups of vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import strip
from ..functions.vectors import cosine, normalized
from ..shared import settled

#: Vectors of each side that meet in one task, at most and (to keep all tasks busy) at least, and bytes of theirs.
GROUP, LEAST_GROUP, GROUP_BYTES = 16384, 256, 64 << 20
#: Decimals that similarities are rounded to before they are ranked, so that sums in another order rank alike.
DECIMALS = 6
#: Left vectors that are multiplied at once; right ones whose k-th best score bounds what the others must reach; pairs that are scored in doubles at once.
TILE, SAMPLE, PAIRS = 512, 1024, 1 << 17


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors, as doubles; all of one length."""
    x = column.combine_chunks()
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) if len(x) else np.empty((0, 1))
    lengths = np.linalg.norm(m, axis=1)
    return m / np.where(lengths > 0, lengths, 1)[:, None]


def _best(rows: np.ndarray, columns: np.ndarray, scores: np.ndarray, ids: np.ndarray, keys: np.ndarray | None, k: int) -> np.ndarray:
    """Places of the k best columns of each row, by score and id; of columns with one key the best alone."""
    order = np.lexsort((ids[columns], -scores, rows))
    if keys is not None:
        at = order[np.lexsort((np.arange(len(order)), keys[columns[order]], rows[order]))]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (rows[at][1:] != rows[at][:-1]) | (keys[columns[at]][1:] != keys[columns[at]][:-1])
        wanted = np.zeros(len(order), dtype=bool)
        wanted[at[new]] = True
        order = order[wanted[order]]
    r = rows[order]
    return order[np.arange(len(r)) - np.searchsorted(r, r, side="left") < k]


def _exact(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The pairs' rounded scores, of doubles."""
    parts = [np.einsum("ij,ij->i", a[rows[i : i + PAIRS]], b[columns[i : i + PAIRS]]) for i in range(0, len(rows), PAIRS)]
    return np.round(np.concatenate(parts), DECIMALS) if parts else np.empty(0)


@dataclass(frozen=True)
class Meeting:
    """What is kept of the pairs of two groups; see similar()."""

    k: int | None = None
    min_score: float | None = None
    strict: bool = False
    exclude_self: bool = False
    half: bool = False
    same_group: bool | None = None
    distinct: bool = False
    best_pairs: int | None = None

    def found(self, x: pa.Table, y: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in x and y, and scores, of the kept pairs. Single-precision products find what may count, by a margin above their error; it is scored again in doubles."""
        least = -np.inf if self.min_score is None else self.min_score
        ids_a, ids_b = x.column("id").to_numpy(zero_copy_only=False), y.column("id").to_numpy(zero_copy_only=False)
        if self.same_group is not None:
            codes = pa.chunked_array([*x.column("g").chunks, *y.column("g").chunks], pa.string()).combine_chunks().dictionary_encode()
            codes = (pa.concat_arrays([c.indices for c in codes.chunks]) if isinstance(codes, pa.ChunkedArray) else codes.indices).to_numpy(zero_copy_only=False)
            groups = codes[: x.num_rows], codes[x.num_rows :]
        ma, mb, keys = _matrix(x.column("v")), _matrix(y.column("v")), y.column("t").to_numpy() if self.distinct else None
        if not len(ma) or not len(mb):
            return (np.empty(0, dtype=int),) * 2 + (np.empty(0),)
        fa, fb = ma.astype(np.float32), mb.astype(np.float32)
        margin = 1.2e-7 * (ma.shape[1] + 8) + 2 * 10.0**-DECIMALS

        def allowed(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            keep = np.ones(np.broadcast_shapes(rows.shape, columns.shape), dtype=bool)
            if self.exclude_self:
                keep &= ids_a[rows] != ids_b[columns]
            if self.half:
                keep &= ids_a[rows] < ids_b[columns]
            if self.same_group is not None:
                equal = groups[0][rows] == groups[1][columns]
                keep &= equal if self.same_group else ~equal
            return keep

        some = np.sort(np.unique(keys, return_index=True)[1])[: max(SAMPLE, 8 * (self.k or 0))] if keys is not None else np.arange(min(len(mb), max(SAMPLE, 8 * (self.k or 0))))
        out: list[tuple] = []
        for at in range(0, len(ma), TILE):
            here = np.arange(at, min(at + TILE, len(ma)))
            s = fa[here] @ fb.T
            bar = np.full(len(here), least - margin, dtype=np.float64)
            if self.k is not None and len(some) >= self.k:
                shown = np.where(allowed(here[:, None], some[None, :]), s[:, some], np.float32(-np.inf))
                np.maximum(bar, np.partition(shown, len(some) - self.k, axis=1)[:, len(some) - self.k] - margin, out=bar)
            rows, columns = np.divmod(np.flatnonzero((s >= bar.astype(np.float32)[:, None] - np.float32(margin / 8)).ravel()), len(mb))
            rows = rows + at
            keep = allowed(rows, columns)
            rows, columns = rows[keep], columns[keep]
            scores = _exact(ma, mb, rows, columns)
            keep = scores > least if self.strict else scores >= least
            rows, columns, scores = rows[keep], columns[keep], scores[keep]
            if self.k is not None and len(rows):
                best = _best(rows, columns, scores, ids_b, keys, self.k)
                rows, columns, scores = rows[best], columns[best], scores[best]
            out.append((rows, columns, scores))
        rows, columns, scores = (np.concatenate(z) for z in zip(*out, strict=True))
        return rows, columns, scores

    def pairs(self, a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str], kinds: tuple[str, str]) -> DataFrame:
        """(names..., score, _group) of the rows (id, g, v, t) of a and b that have the same keys; v of one key are of one length."""

        def compared(x: pa.Table, y: pa.Table) -> pa.Table:
            rows, columns, scores = self.found(x, y)
            if self.best_pairs is not None and len(rows):
                ids_a, ids_b, of = x.column("id").to_numpy(zero_copy_only=False), y.column("id").to_numpy(zero_copy_only=False), x.column("g").to_pylist()
                place = {g: i for i, g in enumerate(dict.fromkeys(of))}
                group_of = np.array([place[g] for g in of])
                order = np.lexsort((ids_b[columns], ids_a[rows], -scores, group_of[rows]))
                g = group_of[rows][order]
                some = order[np.arange(len(g)) - np.searchsorted(g, g, side="left") < self.best_pairs]
                rows, columns, scores = rows[some], columns[some], scores[some]
            out = [x.column("id").take(pa.array(rows)), y.column("id").take(pa.array(columns)), pa.array(scores, pa.float64()), x.column("g").take(pa.array(rows))]
            return pa.table(out, names=[*names, "score", "_group"])

        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(lambda x, y: compared(x, y), f"`{names[0]}` {kinds[0]}, `{names[1]}` {kinds[1]}, score double, _group string")


def pair_names(left_id: str, right_id: str) -> tuple[str, str]:
    return left_id if left_id != right_id else f"source_{left_id}", right_id if left_id != right_id else f"target_{right_id}"


#: Columns whose values are equal where rows of two sides meet.
MEET = ["of", "one", "two", "dim"]


def dealt(
    left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str = "embedding", left_group: str | None = None, right_group: str | None = None, same_group: bool | None = None, distinct: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows (id, g, v, t), once for each group of the other side, with the columns MEET."""

    def side(df: DataFrame, id: str, group: str | None, key: str | None) -> tuple[DataFrame, int, int]:
        columns = [F.col(id).alias("id"), (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"), F.col(vector).alias("v")]
        rows = df.where(F.col(vector).isNotNull()).select(*columns, (F.xxhash64(key) if key else F.lit(0).cast("long")).alias("t"), F.size(vector).alias("dim"))
        if same_group is not None:
            rows = rows.where("g IS NOT NULL")
        n, size = rows.agg(F.count("*"), F.max("dim")).first()
        return rows, n, max(1, -(-n // max(1, min(GROUP, GROUP_BYTES // (8 * max(1, size or 1))))))

    (a, _, na), (b, n, nb) = side(left, left_id, left_group, None), side(right, right_id, right_group, distinct)
    busy = left.sparkSession.sparkContext.defaultParallelism
    nb = max(nb, min(-(-busy // na), n // LEAST_GROUP))  # a small table keeps all tasks busy too
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    label = [F.col("g").alias("of") if same_group else F.lit(None).cast("string").alias("of")]  # groups that can't pair don't meet
    return a.select("*", *label, own(na).alias("one"), every(nb).alias("two")), b.select("*", *label, own(nb).alias("two"), every(na).alias("one"))


def similar(
    left: DataFrame, right: DataFrame, k: int | None, left_id: str, right_id: str, vector: str = "embedding", min_score: float | None = None, strict: bool = False,
    exclude_self: bool = False, half: bool = False, left_group: str | None = None, right_group: str | None = None, same_group: bool | None = None, distinct: str | None = None, best_pairs: int | None = None,
) -> DataFrame:
    """(left_id, right_id, score, rank): the k most similar rows of right for each row of left, by cosine, ties by id; all with k None.

    min_score is kept from (strict: above). half keeps each unordered pair once; same_group keeps pairs of one group (False: of two). With distinct, of right rows
    with one value of that column the best counts alone. best_pairs keeps that many pairs of each left group, ranked within it. Vectors of different lengths,
    and with same_group null groups, pair with nothing.

    Both sides are dealt into groups by hash, and each pair of groups meets in one task, so that a vector is sent once for each group of the other side;
    a task keeps its own best k of each left row (its best pairs), so what is ranked in the end is bounded by them and not by all pairs.
    """
    kinds, names = (dict(left.dtypes)[left_id], dict(right.dtypes)[right_id]), pair_names(left_id, right_id)
    a, b = dealt(left, right, left_id, right_id, vector, left_group, right_group, same_group, distinct)
    meeting = Meeting(k, min_score, strict, exclude_self, half, same_group, distinct is not None, best_pairs)
    pairs = meeting.pairs(a, b, MEET, names, kinds)
    if best_pairs is not None:
        ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("_group").orderBy(F.desc("score"), *names)))
        return ranked.where(F.col("rank") <= best_pairs).withColumnRenamed("_group", "group")
    return ranked_pairs(pairs, names, k if distinct is None else None)


def ranked_pairs(pairs: DataFrame, names: tuple[str, str], k: int | None) -> DataFrame:
    ranked = pairs.drop("_group").withColumn("rank", F.row_number().over(W.partitionBy(names[0]).orderBy(F.desc("score"), names[1])))
    return ranked.where(F.col("rank") <= k) if k is not None else ranked


def vector_search(
    vectors: DataFrame, queries: DataFrame, top_k: int = 10, min_score: float = 0.0, where: Column | None = None, id: str = "node_id", text: str | None = None
) -> DataFrame:
    """(query_id, id, score, rank) for queries(query_id, embedding) over vectors(id, embedding, ...).

    Filters come before the ranking. With text, rows whose stripped text equals that of a better row go first, by keeping of each text the
    row with the smallest id: equal texts may differ in their vectors, so all rows are scored and each task keeps the best of its top_k texts.
    """
    rows = vectors.where(where) if where is not None else vectors
    if text is None:
        return similar(queries, rows, top_k, "query_id", id, min_score=min_score).select("query_id", id, "score", "rank")
    rows = settled(rows.select(id, "embedding", F.md5(strip(F.col(text))).alias("_text")))  # the text itself isn't sent along with each pair, and its digest is made once
    found = similar(queries, rows, top_k, "query_id", id, min_score=min_score, distinct="_text").join(rows.select(id, "_text"), id)
    best = F.row_number().over(W.partitionBy("query_id", "_text").orderBy(F.desc("score"), id))
    found = found.withColumn("_best", best).where("_best = 1").drop("rank")
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), id))).where(F.col("rank") <= top_k).select("query_id", id, "score", "rank")


def neighbourhood_average(vectors: DataFrame, k: int = 5, alpha: float = 0.7, id: str = "node_id", known: DataFrame | None = None) -> DataFrame:
    """(id, embedding, raw_embedding): each vector blended with the mean of its k nearest others (of known's, if given), and normalised.

    Of known, raw_embedding is averaged where there is one, and embedding else.
    """
    pool = vectors if known is None else known
    raw = F.coalesce("raw_embedding", "embedding") if known is not None and "raw_embedding" in known.columns else F.col("embedding")
    near = similar(vectors, pool, k, id, id, exclude_self=True).select(F.col(f"source_{id}").alias(id), F.col(f"target_{id}").alias("_other"))
    # k vectors for each row at most, averaged by place.
    held = near.join(pool.select(F.col(id).alias("_other"), raw.cast("array<double>").alias("_x")), "_other").groupBy(id).agg(F.collect_list("_x").alias("_all"))
    total = F.aggregate(F.slice("_all", 2, k), F.get("_all", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))
    mean = held.select(id, F.transform(total, lambda x: x / F.size("_all")).alias("_mean"))
    blended = F.when(F.col("_mean").isNull(), normalized(F.col("embedding"))).otherwise(normalized(F.zip_with("embedding", "_mean", lambda x, m: alpha * x.cast("double") + (1 - alpha) * m)))
    return vectors.join(mean, id, "left").select(id, blended.alias("embedding"), F.col("embedding").alias("raw_embedding"))


def drift(averaged: DataFrame) -> DataFrame:
    """How far averaging has moved vectors: mean, least, most, and how many by over 0.01."""
    d = averaged.select(F.round(1 - cosine(F.col("embedding"), F.col("raw_embedding")), DECIMALS).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_drift"), F.min("d").alias("min_drift"), F.max("d").alias("max_drift"), F.count(F.when(F.col("d") > 0.01, 1)).alias("n_moved"))


def auto_edges(
    vectors: DataFrame, threshold: float = 0.7, most: int = 5, id: str = "node_id", allowed: tuple[str, ...] = ("derived_from", "analogous_to"), parent: str | None = None, sources: DataFrame | None = None
) -> DataFrame:
    """Edges from each row (of sources, if given) to its most similar others; chunks of a row are never its targets."""
    pool = max(most + 6, 10)
    near = similar(vectors if sources is None else sources, vectors, pool, id, id, min_score=threshold, exclude_self=True)
    source, target = f"source_{id}", f"target_{id}"
    if parent is not None:
        own = vectors.where(F.col(parent).isNotNull()).select(F.col(parent).alias(source), F.col(id).alias(target))
        near = near.join(own, [source, target], "left_anti")
    kind = F.when((F.col("score") >= 0.85) & F.lit("derived_from" in allowed), F.lit("derived_from")).otherwise(F.lit(next((t for t in allowed if t != "derived_from"), allowed[0])))
    place = F.row_number().over(W.partitionBy(source).orderBy(F.desc("score"), target))
    return near.withColumn("_p", place).where(F.col("_p") <= most).select(source, target, kind.alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("weight"))


def upsert(table: DataFrame, rows: DataFrame, id: str = "node_id") -> DataFrame:
    """table with rows put in or put in place of those with their ids; of rows with one id any is kept."""
    return table.join(rows.select(id), id, "left_anti").unionByName(rows.dropDuplicates([id]), allowMissingColumns=True)
