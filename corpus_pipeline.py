"""The corpus pipeline: each stage's output is written as Parquet and read again as the next one's documents.

Stages: documents that the toxicity model rejects go; lines that are boilerplate of their source go; one document of each
group of near duplicates stays; sources are interleaved to their target weights; and the result is packed into sequences in that order.
All stages but the last return the columns of documents, extra ones included, and keep every other document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexlode.llm import line_dedup, mixing, ngram_join, packing, toxicity
from hexlode.llm.common import fresh_dir, remove, table

#: Near duplicates share this part of their runs of so many words.
WORDS, PERCENT = 5, 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.rejected_dropped(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go; n_chars follows where the text has changed."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["source"], docs["text"])
    cleaned = line_dedup.drop_boilerplate(rows)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return cleaned.select(*((new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, WORDS, PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of the mixing stage's files; a table that Spark hasn't numbered is mixed anew, since its files are read by size."""
    if packing.numbered(docs):
        return packing.pack_files(docs)
    return packing.pack(mixing.mixed_order(docs.select("doc_id", "source", "text")))


STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("ngram_join", ngram_join_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: The model, the components and the packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), fresh_dir(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if i:
            remove(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
