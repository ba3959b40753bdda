"""License scans by diagonal voting, in DataFrame functions alone.

Every run of two neighbouring words of a text is joined with the templates' runs. A hit at text word p and template
word t lies on the diagonal p - t. Hits are gathered by diagonal, and diagonals at most SLACK apart are merged (words put in
or left out shift them). A merged span is verified by its longest chain of hits: each next one further on in text and template,
at most GAP words on and SLACK diagonals off. Its share is the chain's hits by the runs of its template or, if they are more, the
runs of the text that it spans; a notice stands from SHARE on. A phrase stands where one diagonal holds all of its runs, so that
its words stand consecutively. The join compares words, not only hashes.

Texts without any of the words that each template can't do without (`telling`) are not split into runs: nothing can stand in them.

Null and empty texts have no words and no label. Repeated rows get equal results each, a null doc_id is a value. Only doc_id
and text are read; extra columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The openings of notices, as their licenses print them, and the labels that this method adds.
NOTICES = {
    "this work is licensed under the gnu general public license version": "notice-gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "notice-gpl",
    "licensed under the apache license version 2 0": "notice-apache",
    "you may not use this file except in compliance with the license": "notice-apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "notice-mit",
    "released under the mit license": "notice-mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "notice-bsd",
    "subject to the terms of the mozilla public license v 2 0": "notice-mpl",
    "licensed under cc by nc 4 0": "notice-cc-by-nc",
    "licensed under a creative commons attribution 4 0 international license": "notice-cc",
}
#: Diagonals that neighbouring hits of a span may be apart, and text words from one to the next.
SLACK, GAP = 2, 5
#: The share of a notice's runs that a span must reach.
SHARE = 0.7
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, before A-Z are lower-cased.
_BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def _templates() -> list[tuple[str, str, bool]]:
    """(phrase, label, whether it is a base one)"""
    return [(phrase, label, phrase in PHRASES) for phrase, label in [*PHRASES.items(), *NOTICES.items()]]


def telling() -> list[str]:
    """Words of which every span that can stand holds one: without them each template has too few runs left."""
    chosen: list[str] = []
    for phrase, _, is_base in _templates():
        w = phrase.split()
        runs = list(zip(w, w[1:], strict=False))
        while (left := [r for r in runs if not set(r) & set(chosen)]) and len(left) >= (len(runs) if is_base else SHARE * len(runs)):
            chosen.append(max({x for r in left for x in r}, key=lambda x: (len(x), x)))
    return chosen


def _may_hold(text: Column) -> Column:
    """Whether a text holds one of telling(); lower() changes more than A-Z, but keeps every word of theirs."""
    low, out = F.lower(text), F.lit(False)
    for word in sorted(telling(), key=len, reverse=True):
        out = out | (low.contains(word) if len(word) > 3 else low.rlike(f"(?:^|[{_BETWEEN}]){word}(?:[{_BETWEEN}]|$)"))
    return F.coalesce(out, F.lit(False))


def words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, f"[{_BETWEEN}]+"), ""), lambda w: F.translate(w, _UPPER, _LOWER))


def _n_words(text: Column) -> Column:
    parts = F.split(text, f"[{_BETWEEN}]+")
    n = F.size(parts) - F.when(F.get(parts, F.lit(0)) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.coalesce(F.when(text.isNotNull(), n), F.lit(0)).cast("long")


def _grams(spark) -> DataFrame:
    rows = []
    for name, (phrase, label, is_base) in enumerate(_templates()):
        w = phrase.split()
        rows += [(name, label, is_base, t, len(w) - 1, a, b) for t, (a, b) in enumerate(zip(w, w[1:], strict=False))]
    grams = spark.createDataFrame(rows, "template int, label string, is_base boolean, t int, runs int, a string, b string")
    return F.broadcast(grams.withColumn("gram", F.xxhash64("a", "b")))  # about a hundred rows, whatever the input


def _chain(hits: Column, runs: Column) -> Column:
    """(share, first, last) of the best of the chains that are longest, then shortest in the text, at each hit; hits are sorted (p, t)."""

    def step(s: Column, h: Column) -> Column:
        before = F.filter(s["recent"], lambda r: (r["p"] < h["p"]) & (r["t"] < h["t"]) & (h["p"] - r["p"] <= GAP) & (F.abs(h["p"] - h["t"] - r["p"] + r["t"]) <= SLACK))
        best = F.array_max(F.transform(before, lambda r: F.struct(r["n"].alias("n"), r["start"].alias("start"))))
        here = F.struct(h["p"].alias("p"), h["t"].alias("t"), (F.coalesce(best["n"], F.lit(0)) + 1).alias("n"), F.coalesce(best["start"], h["p"]).alias("start"))

        def added(x: Column) -> Column:
            found = F.struct((x["n"] / F.greatest(runs, x["p"] - x["start"] + 1)).alias("share"), x["start"].alias("first"), (x["p"] + 1).alias("last"))
            recent = F.filter(s["recent"], lambda r: h["p"] - r["p"] < GAP)
            return F.struct(F.concat(recent, F.array(x)).alias("recent"), F.greatest(s["best"], found).alias("best"))

        return F.get(F.transform(F.array(here), added), F.lit(0))

    none = F.struct(F.array().cast("array<struct<p:int,t:int,n:int,start:int>>").alias("recent"), F.struct(F.lit(0.0).alias("share"), F.lit(-1).alias("first"), F.lit(-1).alias("last")).alias("best"))
    return F.aggregate(hits, none, step, lambda s: s["best"])


def _voted(docs: DataFrame) -> DataFrame:
    """Merged diagonals of docs(doc_id, text, n_words): template, its verified span, and the starts of base phrases; a row without a template for each document, too."""
    split = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "n_words", words(F.col("text")).alias("_words"))
    runs = split.select("_row", "doc_id", "n_words", "_words", F.posexplode_outer("_words").alias("p", "_a"))
    runs = runs.select("_row", "doc_id", "n_words", "p", "_a", F.get("_words", F.col("p") + 1).alias("_b"))
    hits = runs.join(_grams(docs.sparkSession), (F.xxhash64("_a", "_b") == F.col("gram")) & (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left").where("template IS NOT NULL OR p IS NULL OR p = 0")
    key = ["_row", "doc_id", "n_words", "template", "label", "is_base", "runs"]
    diagonals = hits.groupBy(*key, (F.col("p") - F.col("t")).alias("d")).agg(F.collect_set("t").alias("ts"))
    along = W.partitionBy("_row", "template").orderBy("d")
    apart = F.when(F.col("d") - F.lag("d").over(along) <= SLACK, 0).otherwise(1)
    merged = diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(along))
    pairs = F.transform("ts", lambda t: F.struct((F.col("d") + t).alias("p"), t.alias("t")))
    whole = F.when(F.col("is_base") & (F.size("ts") == F.col("runs")), F.col("d"))
    merged = merged.groupBy(*key, "group").agg(F.sort_array(F.flatten(F.collect_list(pairs))).alias("hits"), F.sort_array(F.collect_list(whole)).alias("starts"))
    likely = (~F.col("is_base")) & (F.size("hits") >= SHARE * F.col("runs"))
    return merged.withColumn("span", F.when(likely, _chain(F.col("hits"), F.col("runs")))).withColumn("span", F.when(F.col("span.share") >= SHARE, F.col("span")))


def _scanned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents in which nothing can stand, and the voted spans of the others."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sized = lambda df: df.select("doc_id", "text", _n_words(F.col("text")).alias("n_words"))
    may = _may_hold(F.col("text"))
    return sized(rows.where(~may)).drop("text"), _voted(sized(rows.where(may)))


def spans(docs: DataFrame) -> DataFrame:
    """Verified spans: doc_id, label, is_base, first and last word, share of the template's runs."""
    found = _scanned(docs)[1]
    base = found.where("is_base").select("doc_id", "label", "is_base", F.explode("starts").alias("first"), F.col("runs")).select("doc_id", "label", "is_base", "first", F.expr("first + runs AS last"), F.lit(1.0).alias("share"))
    return base.unionByName(found.where("span IS NOT NULL").select("doc_id", "label", "is_base", "span.first", "span.last", "span.share"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: its words, base places, labels and the largest share that a span reached."""
    rest, found = _scanned(docs)
    stands = F.size("starts") > 0
    joined = lambda label: F.array_join(F.sort_array(F.collect_set(label)), ",")
    out = found.groupBy("_row", "doc_id", "n_words").agg(
        F.sum(F.size("starts")).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).cast("long").alias("first_word"),
        F.max(F.array_max("starts")).cast("long").alias("last_word"),
        joined(F.when(stands, F.col("label"))).alias("base_labels"),
        joined(F.when(stands | F.col("span").isNotNull(), F.col("label"))).alias("labels"),
        F.max(F.when(stands, 1.0).otherwise(F.coalesce("span.share", F.lit(0.0)))).alias("score"),
    )
    none = [F.lit(0).cast("long").alias("n_base"), *(F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")]
    return out.drop("_row").unionByName(rest.select("doc_id", "n_words", *none))
