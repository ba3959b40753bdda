"""Readers of nodes and edges, and shapes of public corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.text import cleaned
from ..schema import EDGES, NODES


def json_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).json(path)


def json_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).json(path).fillna({"weight": 1.0})


def corpus(docs: DataFrame, fields: Sequence[str], domain: str, n: int = 400, label: str | None = None, per_label: int | None = 500) -> DataFrame:
    """(text, domain, label): fields joined, cleaned and cut to n characters, empty ones skipped, at most per_label rows of a label."""
    text = cleaned(F.concat_ws(". ", *(F.col(f) for f in fields)), n)
    rows = docs.select(text.alias("text"), F.lit(domain).alias("domain"), (F.col(label).cast("string") if label else F.lit(None).cast("string")).alias("label")).where("text <> ''")
    if label is None or per_label is None:
        return rows
    return rows.withColumn("_p", F.row_number().over(W.partitionBy("label").orderBy("text"))).where(F.col("_p") <= per_label).drop("_p")
