"""Vector code compression: product codes by integer Lloyd rounds with Hamerly's bounds.

Each component x becomes floor(256 * x), and a vector is cut into 16 parts, each with a codebook of its own. A row of the written state
holds for each part its code, an upper bound of the distance to that entry and one lower bound of the distance to any other. When entries
move, bounds move with them; a part is scanned in full, in integers, only if its upper bound isn't strictly below its lower one (nor
below half of the way to the next entry), first with the bound as it is, then made exact. Equal distances never pass the strict
test, so they are scanned, and go to the lower index. Bounds are floats rounded to the safe side. Sums of parts are taken in
each task and added by Spark, so that the driver sees the codebooks alone: 16 parts of 64 entries.

Rows whose vector is null, or holds null or non-finite components, are dropped. The vectors' length is that of the smallest vec_id whose
length is a positive multiple of 16; rows of other lengths stay, with a null code and error. Null ids come last, repeated ids are ordered by
components, and each repeated row may start an entry of its own; with fewer than 64 vectors there are fewer entries. Components beyond a
long count as the largest long, and errors beyond one are null, and left out of their label's sum. Null labels belong together. Only vec_id, label and
the vector are read, so extra columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, discard, keep, scratch

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Largest component that is computed with in 64 bits.
WIDE = 1 << 28
#: Float bounds are widened by this share.
SAFE = 1e-9
#: Labels up to which their errors are broadcast.
BROADCAST_LABELS = 100_000
#: Rows of distances that are computed at once.
CHUNK = 4096

#: Codebooks: part, entry, component.
Books = np.ndarray


def whole(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label and v, the integer components, of the rows whose components are all finite."""
    v = vectors[vector]
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(x.cast("double") - x.cast("double") == 0, F.lit(False)))
    return vectors.where(fine).select("vec_id", "label", F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"))


def _dtype(*arrays: np.ndarray) -> type:
    """Integers of 64 bits where they are safe, else of any size."""
    return np.int64 if all(a.size == 0 or -WIDE < min(a.min(), 0) and max(a.max(), 0) < WIDE for a in arrays) else object


def _scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each row (the lower index of several), its squared distance, and the second one's."""
    code, first, second = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=x.dtype), np.empty(len(x), dtype=np.float64)
    for a in range(0, len(x), CHUNK):
        d = ((x[a : a + CHUNK, None, :] - entries[None]) ** 2).sum(-1)
        at = d.argmin(1)
        code[a : a + CHUNK], first[a : a + CHUNK] = at, d[np.arange(len(d)), at]
        rest = d.astype(np.float64)
        rest[np.arange(len(d)), at] = np.inf
        second[a : a + CHUNK] = rest.min(1)
    return code, first, second


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def assign(x: np.ndarray, books: Books, old: Books | None = None, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes, upper and lower bounds of x (rows, parts, components), and how many parts were scanned. old and state: codebooks and results of the round before."""
    n = len(x)
    if state is None:
        codes, upper, lower = np.zeros((n, PARTS), dtype=np.int64), np.full((n, PARTS), np.inf), np.zeros((n, PARTS))
    else:
        codes, upper, lower = (a.copy() for a in state)
    scanned = 0
    for p in range(PARTS):
        kind = _dtype(x[:, p], books[p], *([] if old is None else [old[p]]))
        part, entries = x[:, p].astype(kind), books[p].astype(kind)
        if state is None:
            todo = np.arange(n)
        else:
            moved = _root(((entries - old[p].astype(kind)) ** 2).sum(-1)) * (1 + SAFE)
            order = np.argsort(-moved, kind="stable")
            # the largest move of any other entry
            others = np.where(np.arange(len(moved)) == order[0], moved[order[1]] if len(order) > 1 else 0.0, moved[order[0]])
            apart = ((entries[:, None] - entries[None]) ** 2).sum(-1).astype(np.float64)
            np.fill_diagonal(apart, np.inf)
            half = np.sqrt(apart.min(1)) / 2 * (1 - SAFE)
            at = codes[:, p]
            upper[:, p] += moved[at]
            lower[:, p] -= others[at]
            limit = np.maximum(lower[:, p], half[at])
            todo = np.flatnonzero(~(upper[:, p] < limit))
            if len(todo):
                upper[todo, p] = _root(((part[todo] - entries[at[todo]]) ** 2).sum(-1)) * (1 + SAFE)
                todo = todo[~(upper[todo, p] < limit[todo])]
        if len(todo):
            codes[todo, p], first, second = _scan(part[todo], entries)
            upper[todo, p], lower[todo, p] = _root(first) * (1 + SAFE), np.sqrt(second) * (1 - SAFE)
            scanned += len(todo)
    return codes, upper, lower, scanned


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind, copy=False)


def _lists(a: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(a.ravel()), a.shape[1]).cast(pa.list_(pa.from_numpy_dtype(a.dtype)))


def _state(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), dtype=np.uint8).reshape(b.num_rows, PARTS).astype(np.int64)
    return codes, _rows(b.column("upper"), np.float64), _rows(b.column("lower"), np.float64)


def _cut_up(b: pa.RecordBatch) -> np.ndarray:
    return _rows(b.column("v"), np.int64).reshape(b.num_rows, PARTS, -1)


def _assigner(books: Books, old: Books | None) -> Callable:
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes, upper, lower, scanned = assign(_cut_up(b), books, old, None if old is None else _state(b))
                packed = pa.array([r.tobytes() for r in codes.astype(np.uint8)], pa.binary())
                counted = pa.array(np.r_[scanned, np.zeros(b.num_rows - 1, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("v"), packed, _lists(upper), _lists(lower), counted], names=["vec_id", "label", "v", "codes", "upper", "lower", "scanned"])

    return assigned


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each entry got in this task: part, entry, component, sum and count. Sums are text, since they may be longer than a long."""
    sums, counts = None, None
    for b in batches:
        if not b.num_rows:
            continue
        x, codes = _cut_up(b), _state(b)[0]
        if sums is None:
            sums, counts = np.zeros((PARTS, ENTRIES, x.shape[2]), dtype=object), np.zeros((PARTS, ENTRIES), dtype=np.int64)
        for p in range(PARTS):
            kind = _dtype(x[:, p])
            got = np.zeros(sums[p].shape, dtype=kind)
            np.add.at(got, codes[:, p], x[:, p].astype(kind))
            sums[p] += got.astype(object)
            counts[p] += np.bincount(codes[:, p], minlength=ENTRIES)
    if sums is not None:
        p, e, i = (a.ravel() for a in np.indices(sums.shape))
        used = counts[p, e] > 0
        p, e, i = p[used], e[used], i[used]
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in (p, e, i)), pa.array([str(s) for s in sums[p, e, i]]), pa.array(counts[p, e])], names=["p", "e", "i", "total", "n"])


def _moved(state: DataFrame, books: Books) -> Books:
    """Each entry replaced by the floor of its parts' mean; unused ones stay."""
    parts = state.select("vec_id", "label", "v", "codes", "upper", "lower").mapInArrow(_summed, "p int, e int, i int, total string, n long")
    books = books.copy()
    for r in parts.groupBy("p", "e", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():  # one row for each component of each entry
        books[r["p"], r["e"], r["i"]] = int(r["total"]) // r["n"]
    return books


def _finisher(books: Books) -> Callable:
    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, codes = _cut_up(b), _state(b)[0]
                kind = _dtype(x, books)
                error = ((x.astype(kind) - books.astype(kind)[np.arange(PARTS)[None], codes]) ** 2).sum((1, 2))
                errors = pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes().hex() for r in codes.astype(np.uint8)]), errors], names=["vec_id", "label", "code", "error"])

    return finished


def _with_label_errors(coded: DataFrame) -> DataFrame:
    sums = cut(coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")))
    small = sums.count() <= BROADCAST_LABELS
    return coded.join(F.broadcast(sums) if small else sums, coded["label"].eqNullSafe(sums["_label"]))


def compress(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row for each kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    spark = vectors.sparkSession
    with scratch(spark):
        kept = cut(whole(vectors, vector))
        ordered = (F.col("vec_id").asc_nulls_last(), F.col("v").asc())
        first = kept.where(f"size(v) > 0 AND size(v) % {PARTS} = 0").orderBy(*ordered).select(F.size("v")).first()
        dim = first[0] if first else 0
        even, odd = kept.where(F.size("v") == dim), kept.where(F.size("v") != dim)
        start = np.array([r["v"] for r in even.orderBy(*ordered).select("v").limit(ENTRIES).collect()], dtype=object).reshape(-1, PARTS, max(dim // PARTS, 1))
        books, old, state = np.ascontiguousarray(start.transpose(1, 0, 2)), None, even
        fields = {f.name: f.dataType for f in kept.schema.fields}
        bounds = T.ArrayType(T.DoubleType())
        schema = T.StructType([T.StructField(*x) for x in (("vec_id", fields["vec_id"]), ("label", fields["label"]), ("v", fields["v"]), ("codes", T.BinaryType()), ("upper", bounds), ("lower", bounds), ("scanned", T.LongType()))])
        if dim:
            for turn in range(ROUNDS + 1):
                before, state = state, cut(state.mapInArrow(_assigner(books, old), schema))
                if turn:
                    discard(before)
                if turn < ROUNDS:
                    books, old = _moved(state, books), books
        digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
        coded = T.StructType([T.StructField(*x) for x in (("vec_id", fields["vec_id"]), ("label", fields["label"]), ("code", T.StringType()), ("error", T.LongType()))])
        out = odd.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        if dim:
            out = state.select("vec_id", "label", "v", "codes", "upper", "lower").mapInArrow(_finisher(books), coded).union(out)
        return keep(_with_label_errors(cut(out)).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")))


def _sql_round(k: int) -> str:
    """Assignment to the codebook c{k}, and the codebook after it."""
    return f"""
a{k} AS (
  SELECT id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT x.id, x.p, c.e, list_sum(list_transform(list_zip(x.x, c.c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS d FROM part x JOIN c{k} c USING (p)) GROUP BY id, p
),
s{k} AS (
  SELECT p, e, i, CAST((sum(v) - (sum(v) % count(*) + count(*)) % count(*)) AS BIGINT) // count(*) AS m
  FROM (SELECT a.p, a.e, unnest(x.x) AS v, generate_subscripts(x.x, 1) AS i FROM a{k} a JOIN part x USING (id, p)) GROUP BY p, e, i
),
c{k + 1} AS (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM s{k} GROUP BY p, e) m USING (p, e)),"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, v) AS id, vec_id, label, v
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
),
part AS (SELECT id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)),
c0 AS (SELECT p, id - 1 AS e, x AS c FROM part WHERE id <= {ENTRIES}),
{"".join(map(_sql_round, range(ROUNDS + 1)))}
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS}),
coded AS (SELECT id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id)
SELECT k.vec_id, coded.code, coded.error, CAST(sum(coded.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept k JOIN coded USING (id), digest
"""
