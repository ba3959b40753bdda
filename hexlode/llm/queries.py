"""The package's registered queries, each over the whole of its table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import capfilters, hamerly, html_extract, license_scan, line_dedup, mixing, mpeg_audio, ngram_join, packing, quality_rules, spelling, toxicity, warc
from .common import fresh_dir, table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "source", "_slot AS slot", "_block AS block", f"_slot * {mixing.BLOCK} + _at AS position")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", cleaned["_dropped"].alias("n_dropped"))


def op8_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg_audio.media_table(table(spark, sf_dir, "documents"), fresh_dir(spark, "media"))
    probed = media.select("doc_id", mpeg_audio.probe("media").alias("p"))
    return probed.select("doc_id", *(f"p.{c}" for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek_offsets", "frames", "samples", "sample_rate", "duration_s", "bad_crc", "resyncs")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_capfilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def op13_hamerly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extract, op2_mixing, op3_warc, op4_ngram_join, op5_license_scan, op6_toxicity, op7_line_dedup, op8_mpeg_audio, op9_packing, op10_capfilters, op11_spelling, op12_quality_rules, op13_hamerly)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE_SQL, "op7_line_dedup": line_dedup.oracle_sql(), "op11_spelling": spelling.ORACLE_SQL, "op13_hamerly": hamerly.ORACLE_SQL}
