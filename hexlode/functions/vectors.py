"""Vector functions over array columns; all sums are of doubles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).otherwise(0.0)


def mock_vector(text: str, dim: int) -> np.ndarray:
    """The deterministic stand-in for an embedding model: normal numbers seeded by the text's digest, of length 1."""
    seed = int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
    v = np.random.RandomState(seed).standard_normal(dim).astype(np.float32)
    return v / np.linalg.norm(v)


def mock_embed(text: Column, dim: int = 64) -> Column:
    """An embedding column without a model; swap in any pandas UDF from text to array<float>."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embedded(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else mock_vector(t, dim), na_action=None)

    return embedded(text)
