"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and pairs of words with one word between, hashed to 2**20 places. Per-coordinate
rates and an L1 penalty leave few weights, which are broadcast to score every document in whole.

Null and empty texts score as the intercept does. Labels that are null are left out, several for one doc_id are averaged;
with no labelled rows the intercept is -4. Repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import WordHasher, cut, scratch

BITS = 20
#: Labelled rows that a model is fitted on at most, those with the smallest hashes of their doc_id; a bound on the driver's memory.
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1.5, 1.0

_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_SALTS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased, and of other characters beyond ASCII."""
    return (text or "").encode("utf-8", "replace").translate(_SPACE).split()


def features(hasher: WordHasher, text: str | None) -> np.ndarray:
    """Places of the features of a text; with repeats."""
    h = hasher(words(text))
    parts = [h]
    for gap, salt in zip((1, 2), _SALTS, strict=True):
        if len(h) > gap:
            pair = h[:-gap] * salt + h[gap:]
            parts.append(pair * salt)
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    at: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float64)
        out[self.at] = self.weight
        return out


def score(table: np.ndarray, bias: float, at: np.ndarray) -> float:
    hit = np.unique(at[table[at] != 0])
    return float(1 / (1 + np.exp(-np.clip(bias + table[hit].sum(), -35, 35))))


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over rows of (distinct places, label), in the given order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    positive = sum(y for _, y in rows)
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 0.5))) if rows else -4.0
    bias_n = 0.0

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            bias_n += g * g
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = weights(z, n)
    at = np.flatnonzero(w)
    return Model(at.astype(np.int32), w[at].astype(np.float32), bias)


def held_out(doc_id: F.Column) -> F.Column:
    """Whether labels of this document are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for b in batches:
        at = [np.unique(features(hasher, t)).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.binary()), b.column(2)], names=["id", "at", "toxic"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the labelled documents that are not held out, max_rows of them at most."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.avg("toxic").alias("_toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # max_rows bounds what is broadcast
    with scratch(docs.sparkSession):
        found = cut(found.select("_id", "text", "_toxic").mapInArrow(_distinct, "id long, at binary, toxic double"))
        rows = {r["id"]: (np.frombuffer(r["at"], dtype=np.int32), int(r["toxic"] >= 0.5)) for r in found.toLocalIterator()}  # max_rows of them at most
    order = np.random.default_rng(7).permutation(len(rows))
    ordered = [rows[k] for k in sorted(rows)]
    return fit([ordered[i] for i in order])


def scorer(spark, model: Model):
    """A column function from texts to scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, bias, hasher = shared.value.table(), shared.value.bias, WordHasher()
        for texts in batches:
            yield pd.Series([score(table, bias, features(hasher, t)) for t in texts], dtype="float64")

    return scored


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs' doc_id, held_out, score and predicted."""
    scored = scorer(docs.sparkSession, train(docs, labels))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def rejected_dropped(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the model predicts to be toxic, with their own columns."""
    scored = scorer(docs.sparkSession, train(docs, labels))
    return docs.where(scored("text") < 0.5)
