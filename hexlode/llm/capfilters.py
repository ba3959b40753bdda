"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A vector is turned by a seeded random rotation, so that recall doesn't depend on how its energy is spread, and cut into BLOCKS
parts, each with a code of CODE random directions at most (fewer in parts of one to four dimensions); a filter is one direction
of each part. A vector is list-decoded to all filters whose summed product with it, in units of its standard deviation, reaches
a cap: block by block, with partial sums pruned by the best that later blocks can add. The cap is set for each dimension so that
of random pairs just at the cosine a share of RECALL has a filter in common. Vectors of
one label that share a filter are compared in double precision; a pair counts at its first common filter alone.

Equal vectors are gathered first. Filters with one vector are dropped before vectors are sent; filters with more than
CHUNK vectors are split into pairs of chunks, so no task holds a filter's whole group. Found links are summed by vector
and handed on as a spanning star of each block, never as rows for pairs.

Of 400 random pairs each at cosine 0.93 and 0.98 these shares have a filter in common: in 8 dimensions 0.983 and 0.988, 16 0.995 and
0.995, 64 0.985 and 0.995, 256 0.978 and 0.995; in 64 with scales 1/i 0.995 and 0.995, 0.95**i 0.993 and 1.000, the first half alone
0.993 and 0.995. A vector of 16 dimensions or more exceeds 60 to 140 filters, one of 8 or 12 150 and 340.
Vectors that are null, zero, or hold null or non-finite parts, null labels and null ids link with nothing. Vectors of
different lengths never link. Repeated rows count as vectors each. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, keep, scratch
from .components import components

COSINE = 0.93
BLOCKS, CODE = 2, 512
#: The share of random pairs just at the cosine that have a filter in common, and the pairs that set the cap for it.
RECALL, CALIBRATED = 0.99, 1000
CHUNK = 2048
SEED = 20
#: Pairs of vectors that one task compares at once.
TILE = 512


@lru_cache(maxsize=4)
def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim, 1, 1]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@lru_cache(maxsize=4)
def codes(dim: int, blocks: int = BLOCKS, size: int = CODE, seed: int = SEED) -> tuple[tuple[int, int, np.ndarray], ...]:
    """For each part of a vector its bounds and its directions (with their opposites), scaled so that a random unit vector's summed product has variance 1."""
    bounds = np.linspace(0, dim, min(blocks, dim) + 1).astype(int)
    out = []
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        c = np.random.default_rng([seed, dim, k, 2]).standard_normal((min(size, 4 ** min(int(b - a), 16) // 2) // 2, b - a))
        c = np.vstack([c, -c])
        out.append((int(a), int(b), c / np.linalg.norm(c, axis=1)[:, None] * np.sqrt(b - a)))
    return tuple(out)


@lru_cache(maxsize=4096)
def cap_of(dim: int, cosine: float = COSINE, recall: float = RECALL) -> float:
    """The greatest cap at which of random pairs at the cosine a share of recall exceeds a common filter."""
    rng = np.random.default_rng([SEED, dim, 1, 3])
    u, v = rng.standard_normal((2, CALIBRATED, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (u * v).sum(1)[:, None] * u
    v = u if dim == 1 else cosine * u + np.sqrt(max(0.0, 1 - cosine * cosine)) * v / np.linalg.norm(v, axis=1)[:, None]
    best = np.empty(CALIBRATED)
    parts = [[(x[:, a:b] @ c.T).astype(np.float32) for a, b, c in codes(dim)] for x in (u, v)]
    for r in range(CALIBRATED):
        sums = [np.zeros(1, dtype=np.float32)] * 2
        for k in range(len(parts[0])):
            sums = [np.add.outer(s, p[k][r]).ravel() for s, p in zip(sums, parts, strict=True)]
        best[r] = np.minimum(*sums).max()
    return float(np.sort(best)[int((1 - recall) * CALIBRATED)]) - 1e-4


def decoded(unit: np.ndarray, cap: float | None = None) -> list[np.ndarray]:
    """For each row of unit vectors the sorted numbers of all filters that it exceeds; rows that exceed none take their best filter."""
    parts = codes(unit.shape[1])
    cap = cap_of(unit.shape[1]) if cap is None else cap
    unit = unit @ rotation(unit.shape[1])
    scores = [unit[:, a:b] @ c.T for a, b, c in parts]
    orders = [np.argsort(-s, axis=1) for s in scores]
    out = []
    for r in range(len(unit)):
        ranked = [s[r][o[r]] for s, o in zip(scores, orders, strict=True)]
        best = np.cumsum([x[0] for x in ranked[::-1]])[::-1]
        least = min(cap, best[0])
        sums, ids = np.zeros(1), np.zeros(1, dtype=np.int64)
        for k, (x, o) in enumerate(zip(ranked, orders, strict=True)):
            rest = best[k + 1] if k + 1 < len(ranked) else 0.0
            n = np.searchsorted(-x, sums + rest - least + 1e-12, side="right")
            at = np.repeat(np.arange(len(sums)), n)
            place = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            sums, ids = sums[at] + x[place], ids[at] * len(x) + o[r][place]
        out.append(np.sort(ids))
    return out


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    off = off - off[0]
    return [flat[a:b] for a, b in zip(off, off[1:], strict=False)]


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]  # so that no square over- or underflows
    return x / np.linalg.norm(x, axis=1)[:, None]


def _decode(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = batch.column(0).to_pylist(), _rows(batch.column(1))
            for dim in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == dim]
                for i in range(0, len(at), 1024):
                    some = at[i : i + 1024]
                    filters = decoded(_unit([vectors[k] for k in some]), cap_of(dim, cosine))
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in some], pa.int64()), pa.array(filters, pa.list_(pa.int32()))], names=["node", "filters"])

    return run


def _links(unit: np.ndarray, filters: list[np.ndarray], here: int, cosine: float, left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, from left and right, at the cosine or above, of which here is the first common filter."""
    for i in range(0, len(left), TILE):
        for j in range(i if same else 0, len(right), TILE):
            a, b = left[i : i + TILE], right[j : j + TILE]
            near = unit[a] @ unit[b].T >= cosine
            if same and i == j:
                near = np.triu(near, 1)
            if not near.any():
                continue
            before = sorted({int(f) for k in np.unique(np.concatenate([a[near.any(1)], b[near.any(0)]])) for f in filters[k] if f < here})
            if before:
                place = {f: n for n, f in enumerate(before)}
                held = []
                for side in (a, b):
                    m = np.zeros((len(side), len(before)), dtype=np.float32)
                    for n, k in enumerate(side):
                        m[n, [place[int(f)] for f in filters[k] if int(f) in place]] = 1
                    held.append(m)
                near &= held[0] @ held[1].T == 0
            x, y = np.nonzero(near)
            yield a[x], b[y]


def _star(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    root = list(range(n))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in pairs:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = top(i), top(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    return [top(i) for i in range(n)]


def _compare(cosine: float):
    def group(here: int, nodes: list[int], counts: np.ndarray, sides: np.ndarray, one: int, two: int, unit: np.ndarray, filters: list[np.ndarray]) -> tuple[list, list, list]:
        left = np.flatnonzero(sides == one)
        pairs = list(_links(unit, filters, here, cosine, left, left if one == two else np.flatnonzero(sides == two), one == two))
        if not pairs:
            return [], [], []
        links = np.zeros(len(nodes), dtype=np.int64)
        for a, b in pairs:
            np.add.at(links, a, counts[b])
            np.add.at(links, b, counts[a])
        root, hit = _star(len(nodes), pairs), np.flatnonzero(links)
        return [nodes[k] for k in hit], links[hit].tolist(), [nodes[root[k]] for k in hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        rows: list[tuple] = []
        found: tuple[list, list, list] = [], [], []

        def close() -> None:
            if len(rows) > 1:
                got = group(held[2], [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), held[3], held[4], _unit([r[3] for r in rows]), [r[4] for r in rows])
                for have, more in zip(found, got, strict=True):
                    have.extend(more)
            rows.clear()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["node", "links", "root"])
            for x in found:
                x.clear()
            return b

        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True)
            values = zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), batch.column(7).to_pylist(), _rows(batch.column(8)), _rows(batch.column(9)), strict=True)
            for key, value in zip(keys, values, strict=True):
                if key != held:
                    close()
                    held = key
                rows.append(value)
            if len(found[0]) > 50_000:
                yield out()
        close()
        yield out()

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors(vec_id, label, embedding)."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False)), x).alias("vector"))
    with scratch(vectors.sparkSession):
        classes = cut(rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
        filters = cut(classes.select("node", "vector").mapInArrow(_decode(cosine), "node long, filters array<int>"))
        label = classes.select("node", "label", F.size("vector").alias("dim"), "copies", "vector").join(filters, "node")
        held = cut(label)
        places = held.select("label", "dim", "node", F.explode("filters").alias("filter"))
        shared = places.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
        met = places.join(shared, ["label", "dim", "filter"]).withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        met = met.select("label", "dim", "filter", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "node", "chunk")
        met = met.join(held.select("node", "copies", "vector", "filters"), "node").select("label", "dim", "filter", "one", "two", "node", "copies", "chunk", "vector", "filters")
        key = ["label", "dim", "filter", "one", "two"]
        links = cut(met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_compare(cosine), "node long, links long, root long"))
        sums = links.groupBy("node").agg(F.sum("links").alias("links"))
        roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u <> v"))
        least = roots.groupBy("root").agg(F.min("node").alias("component"))
        found = classes.join(sums, "node", "left").join(roots.join(least, "root").select("node", "component"), "node", "left")
        found = found.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
        out = rows.join(found, ["label", "vector"], "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        return keep(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
