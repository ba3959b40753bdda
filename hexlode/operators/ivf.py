"""Approximate nearest neighbours by an inverted file, kept on disk and changed by deltas.

Unit vectors are dealt into cells, each around a centroid that spherical k-means finds on a bounded sample. A search ranks the centroids for each query, reads
the cells of the first `probes`, and scores their vectors exactly; with all cells it is the exact search. The table of vectors is sorted by cell, so that
a filter on the probed cells skips files and row groups. Cells of many vectors, and cells that many queries probe, meet piece by piece: no cell is a task of its own.

Adding, replacing and deleting write a delta (id, cell, vector or tombstone) and a manifest that names it; a search merges deltas as it reads, later ones before
earlier ones. compact() folds them into a new version. Both are commits of `sources.store`: of two at a time one raises Conflict.

Null vectors, and those of another length than the index's, are left out. Of rows with one id in a batch that with the greatest `order` counts, else any.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources.store import Store
from .vector import GROUP, Meeting, pair_names, ranked_pairs, similar

#: Cells at most, bytes of the vectors that centroids are fitted on at most, rounds, and probes unless told otherwise.
MOST_CELLS, SAMPLE_BYTES, ROUNDS, PROBES = 65_536, 64 << 20, 8, 16
#: Changed ids up to which a search broadcasts them.
BROADCAST_CHANGES = 1_000_000
#: Probed cells up to which they are named in the scan's filter.
NAMED_CELLS = 2_000


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def centroids(vectors: DataFrame, cells: int, id: str = "node_id", vector: str = "embedding", sample_bytes: int = SAMPLE_BYTES) -> np.ndarray:
    """Unit centroids of the sample with the smallest hashes of its ids, fewer than cells if it has fewer vectors."""
    dim = vectors.where(F.size(vector) > 0).agg(F.mode(F.size(vector), True)).first()[0] or 1
    rows = vectors.where(F.size(vector) == dim).orderBy(F.xxhash64(id), id).limit(max(cells, min(64 * cells, sample_bytes // (4 * dim))))
    x = _unit(np.array([r[0] for r in rows.select(F.col(vector).cast("array<float>")).collect()], dtype=np.float64).reshape(-1, dim))
    found = x[: min(cells, len(x))]
    for _ in range(ROUNDS if len(x) > len(found) else 0):
        near = (x @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        used = np.bincount(near, minlength=len(found)) > 0
        found = np.where(used[:, None], _unit(sums), found)
    return found.astype(np.float32)


def _ranked_cells(middle: np.ndarray, most: int):
    """Rows (key, v) to (key, v, cells): the most nearest cells, in order."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
                order = np.argsort(-(x @ middle.T.astype(np.float64)), axis=1, kind="stable")[:, :most].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("v"), cells], names=["key", "v", "cells"])

    return ranked


def with_cells(rows: DataFrame, key: str, vector: str, middle: np.ndarray, most: int = 1) -> DataFrame:
    """(key, v, cells) of the rows whose vectors have the centroids' length."""
    fit = rows.where(F.size(vector) == middle.shape[1]).select(F.col(key).alias("key"), F.col(vector).cast("array<float>").alias("v"))
    fit = fit.where(F.forall("v", lambda x: x.isNotNull()))
    schema = T.StructType([*fit.schema.fields, T.StructField("cells", T.ArrayType(T.IntegerType()))])
    return fit.mapInArrow(_ranked_cells(middle, min(most, len(middle))), schema)


class VectorIndex:
    """An inverted file in a folder of versions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.store = spark, Store(spark, path)

    # Changes

    @classmethod
    def create(cls, spark: SparkSession, path: str, vectors: DataFrame, cells: int | None = None, id: str = "node_id", vector: str = "embedding") -> VectorIndex:
        """An index of all vectors; by default of as many cells as the root of their number."""
        index = cls(spark, path)
        index.store.initialize({"id": id})
        count = cells or max(1, min(MOST_CELLS, round(vectors.count() ** 0.5)))
        index._write(centroids(vectors, count, id, vector), vectors, id, vector, None)
        return index

    def _write(self, middle: np.ndarray, vectors: DataFrame, id: str, vector: str, base: int | None) -> None:
        placed = with_cells(vectors, id, vector, middle).select(F.col("key").alias("id"), F.col("v"), F.col("cells")[0].alias("cell"))
        sorted_ = placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
        table = self.spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middle)], "cell int, v array<float>")
        self.store.save(base, {"deltas": []}, vectors=sorted_, centroids=table)

    def _changed(self, rows: DataFrame) -> None:
        m = self.store.manifest()
        name = f"delta-{uuid.uuid4().hex[:12]}"
        rows.withColumn("seq", F.lit(m["revision"] + 1).cast("long")).write.parquet(self.store.folder.of(name))
        try:
            self.store.update_manifest({"deltas": [*m["deltas"], name]}, m["revision"])
        except BaseException:
            self.store.folder.delete(name)
            raise

    def upsert(self, rows: DataFrame, id: str = "node_id", vector: str = "embedding", order: str | None = None) -> None:
        """Adds rows, or puts their vectors in place of those with their ids."""
        last = rows.groupBy(F.col(id).alias("id")).agg(F.max_by(vector, order if order else F.lit(0)).alias("v"))
        placed = with_cells(last, "id", "v", self.middle()).select(F.col("key").alias("id"), "v", F.col("cells")[0].alias("cell"))
        self._changed(placed.withColumn("gone", F.lit(False)))

    def delete(self, ids: DataFrame, id: str = "node_id") -> None:
        none = [F.lit(None).cast("array<float>").alias("v"), F.lit(None).cast("int").alias("cell"), F.lit(True).alias("gone")]
        self._changed(ids.select(F.col(id).alias("id")).distinct().select("id", *none))

    def compact(self, refit: bool = False) -> None:
        """Folds all deltas into a new version; refit: with new centroids."""
        m, rows, middle = self.store.manifest(), self.vectors(), self.middle()
        self._write(centroids(rows, len(middle), "id", "v") if refit else middle, rows, "id", "v", m["revision"])
        named = {d for r in self.store.revisions() for d in self.store.manifest(r).get("deltas", [])}
        for d in set(m["deltas"]) - named:
            self.store.folder.delete(d)

    # Reads

    def middle(self) -> np.ndarray:
        rows = self.store.load("centroids").orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r["v"] for r in rows], dtype=np.float32)

    def _deltas(self) -> DataFrame | None:
        """The last change of each changed id."""
        names = self.store.manifest()["deltas"]
        if not names:
            return None
        all_ = self.spark.read.parquet(*map(self.store.folder.of, names))
        return all_.groupBy("id").agg(F.max_by(F.struct("v", "cell", "gone"), "seq").alias("x")).select("id", "x.*")

    def vectors(self, where: Column | None = None) -> DataFrame:
        """(id, v, cell) as they stand, with the deltas merged; where: on the cell."""
        base, changes = self.store.load("vectors"), self._deltas()
        kept = base if where is None else base.where(where)
        if changes is None:
            return kept.select("id", "v", "cell")
        ids = changes.select("id")
        kept = kept.join(F.broadcast(ids) if changes.count() <= BROADCAST_CHANGES else ids, "id", "left_anti")
        new = changes.where("NOT gone")
        return kept.select("id", "v", "cell").union((new if where is None else new.where(where)).select("id", "v", "cell"))

    def has(self, ids: DataFrame, id: str = "node_id") -> DataFrame:
        """ids with `present`."""
        known = self.vectors().select(F.col("id").alias("_known"))
        return ids.join(known, ids[id] == known["_known"], "left").select(*ids.columns, F.col("_known").isNotNull().alias("present"))

    def get(self, ids: DataFrame, id: str = "node_id") -> DataFrame:
        known = self.vectors().select(F.col("id").alias("_known"), F.col("v").alias("embedding"))
        return ids.select(id).distinct().join(known, F.col(id) == F.col("_known")).select(id, "embedding")

    def stats(self) -> DataFrame:
        """(vectors, cells, largest_cell, deltas, changed, tombstones)"""
        changes, rows = self._deltas(), self.vectors()
        changed = changes.agg(F.count("*").alias("changed"), F.count(F.when(F.col("gone"), 1)).alias("tombstones")) if changes is not None else self.spark.sql("SELECT 0L AS changed, 0L AS tombstones")
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vectors"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_cell"))
        return sizes.crossJoin(changed).withColumns({"cells": F.lit(len(self.middle())), "deltas": F.lit(len(self.store.manifest()["deltas"]))})

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = PROBES, min_score: float = 0.0, id: str = "node_id", query_id: str = "query_id", vector: str = "embedding", group: int = GROUP) -> DataFrame:
        """(query_id, id, score, rank) of the k best vectors in the probed cells of each query; probes None: in all."""
        middle = self.middle()
        asked = with_cells(queries, query_id, vector, middle, len(middle) if probes is None else probes)
        probed = asked.select(F.col("key").alias("id"), "v", F.explode("cells").alias("cell"))
        where = None
        if probes is not None and probes < len(middle):
            named = [r[0] for r in probed.select("cell").distinct().limit(NAMED_CELLS + 1).collect()]
            where = F.col("cell").isin(named) if len(named) <= NAMED_CELLS else None
        rows = self.vectors(where)
        # a row for each cell, MOST_CELLS at most: pieces of its queries and of its vectors
        pieces = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / group).cast("int").alias(name))
        sizes = F.broadcast(pieces(probed, "na").join(pieces(rows, "nb"), "cell"))
        own, every = (lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        plain = [F.lit(None).cast("string").alias("g"), F.lit(0).cast("long").alias("t")]
        a = probed.join(sizes, "cell").select("id", "v", *plain, "cell", own("na").alias("one"), every("nb").alias("two"))
        b = rows.join(sizes, "cell").select("id", "v", *plain, "cell", own("nb").alias("two"), every("na").alias("one"))
        names = pair_names(query_id, id)
        found = Meeting(k, min_score).pairs(a, b, ["cell", "one", "two"], names, (dict(queries.dtypes)[query_id], dict(rows.dtypes)["id"]))
        return ranked_pairs(found, names, k).select(*names, "score", "rank")

    def probes_for(self, recall: float = 0.9, k: int = 10, sample: int = 200) -> int:
        """The least number of probes that finds this share of the k nearest of a bounded sample of the index's own vectors, by exact search."""
        rows, middle = self.vectors(), self.middle()
        some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("id").alias("query_id"), F.col("v").alias("embedding"))
        exact = similar(some, rows.select(F.col("id").alias("node_id"), F.col("v").alias("embedding"), "cell"), k, "query_id", "node_id").join(rows.select(F.col("id").alias("node_id"), "cell"), "node_id")
        order = with_cells(some, "query_id", "embedding", middle, len(middle)).select(F.col("key").alias("query_id"), "cells")
        places = sorted(r[0] for r in exact.join(order, "query_id").select(F.array_position("cells", F.col("cell"))).collect())  # sample times k
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))))]) if places else len(middle)
