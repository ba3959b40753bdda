"""Line deduplication by site-relative frequency.

Pages are grouped by host. A line is boilerplate where the pages of its host that hold it, divided by the host's pages,
exceed RATIO; it is dropped from every page of that host. Hosts of fewer than MIN_PAGES pages, and lines on fewer than
that many pages, are left alone: a ratio says nothing there. With distinct_pages, the default, exact copies of a page count as one
page of its host, so that a page often copied isn't taken for boilerplate; without it, every row is a page. Lines are parts between \\n, compared without the spaces
around them; empty ones always stay.

A host has fewer boilerplate lines than its mean page has lines, divided by RATIO, so the lists that are joined back to the
pages grow with hosts alone; they are broadcast only when counted to be small, and else joined by host.

Null texts stay null and hold no line, and are the same page as empty ones; a null host is a host of its own. Repeated rows get equal results. A page whose
lines all go keeps an empty text. All columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

RATIO = 0.05
MIN_PAGES = 5
#: Boilerplate lines (16 bytes each) up to which their lists are broadcast.
BROADCAST_LINES = 1_000_000
_SPACES = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACES))


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit("line")).alias("b"))


def boilerplate(pages: DataFrame, host: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_pages: bool = True) -> DataFrame:
    """_host and key of each line over the ratio, with its pages and its host's."""
    whole = F.coalesce(text, F.lit(""))
    page = F.struct(F.xxhash64(whole).alias("a"), F.xxhash64(whole, F.lit("page")).alias("b")).alias("_page")
    once = (lambda df: df.distinct()) if distinct_pages else (lambda df: df)
    per_page = F.filter(F.array_distinct(F.transform(F.split(text, "\n"), _trimmed)), lambda x: x != "")
    held = pages.select(host.alias("_host"), page, F.explode(per_page).alias("_line")).select("_host", "_page", _key(F.col("_line")).alias("_key"))
    held = once(held)
    counts = held.groupBy("_host", "_key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = once(pages.select(host.alias("_host"), page)).groupBy("_host").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    return counts.join(totals, counts["_host"].eqNullSafe(totals["_host"])).drop(totals["_host"]).where(F.col("n") > ratio * F.col("total"))


def drop_boilerplate(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct_pages: bool = True) -> DataFrame:
    """pages with their boilerplate lines dropped; columns stay as they are, and _dropped (in place of one of that name) counts the dropped lines."""
    lists = cut(boilerplate(pages, pages[host], pages[text], ratio, min_pages, distinct_pages).groupBy(F.col("_host").alias("__hexlode_host")).agg(F.collect_set("_key").alias("__hexlode_keys")))
    small = (lists.agg(F.sum(F.size("__hexlode_keys"))).first()[0] or 0) <= BROADCAST_LINES
    joined = pages.join(F.broadcast(lists) if small else lists, pages[host].eqNullSafe(lists["__hexlode_host"]), "left")
    lines = F.split(pages[text], "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__hexlode_keys"), _key(_trimmed(x))), F.lit(False)))
    changed = F.col("__hexlode_keys").isNotNull() & pages[text].isNotNull()
    joined = joined.withColumn("__hexlode_kept", F.when(changed, kept))
    new = F.when(changed, F.array_join("__hexlode_kept", "\n")).otherwise(pages[text])
    count = F.when(changed, F.size(lines) - F.size("__hexlode_kept")).otherwise(0).cast("long")
    return joined.select(*(new.alias(c) if c == text else pages[c] for c in pages.columns if c != "_dropped"), count.alias("_dropped"))


def oracle_sql(distinct_pages: bool = True) -> str:
    """The same on documents, with source as the host, in DuckDB's SQL."""
    page = "DISTINCT coalesce(text, '')" if distinct_pages else "*"
    holding = "DISTINCT text" if distinct_pages else "DISTINCT row_id"
    return f"""
WITH page AS (SELECT row_number() OVER () AS row_id, doc_id, source, text FROM documents),
total AS (SELECT source, count({page}) AS total FROM page GROUP BY source HAVING count({page}) >= {MIN_PAGES}),
line AS (SELECT row_id, doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM page),
clean AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS t FROM line),
bad AS (
  SELECT c.source, c.t FROM (SELECT source, t, count({holding}) AS n FROM clean WHERE t <> '' GROUP BY source, t) c
  JOIN total ON c.source IS NOT DISTINCT FROM total.source WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO} * total.total
),
kept AS (SELECT c.row_id, string_agg(c.line, chr(10) ORDER BY c.at) AS text, count(*) AS n FROM clean c LEFT JOIN bad b ON c.source IS NOT DISTINCT FROM b.source AND c.t = b.t WHERE b.t IS NULL GROUP BY c.row_id)
SELECT p.doc_id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(CASE WHEN p.text IS NULL THEN 0 ELSE len(string_split(p.text, chr(10))) - coalesce(k.n, 0) END AS BIGINT) AS n_dropped
FROM page p LEFT JOIN kept k USING (row_id)
"""
