"""Spelling variants by pairless wildcard groups.

Words are runs of letters of all texts; a word's places give one key each, (place, what stands before, what stands after), so the
words that differ by one replaced letter share one key. A key's group keeps its size and its two best words: each member learns
how many words it is near to there, and the best that isn't itself. A word less one letter is joined with the vocabulary: where it
is a word itself, the two are near by an insertion or a deletion. So every word sends as many rows as it has letters, and no
pair within a group is ever made; a group holds no more words than there are letters.

Words are numbered in the order of their rank, more frequent ones first, ties by code points, so that the best of several is the
smallest number. Keys of words of up to LONG letters are text and exact; longer ones are keyed by 124-bit polynomial hashes, so
that a run of a million letters takes as many short keys and not as many megabytes.

A word's form is its best near word if that is DOMINANCE times as frequent; a form is more frequent than its word, so following
forms ends, after fewer steps than the largest count has digits. Roots are found by doubling: each round halves what is left.

Null and empty texts hold no words; a null doc_id counts as the empty text in the hash that picks letters to delete. Repeated rows
count as often as they stand. Only doc_id and text are read, so extra columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import cut, discard, keep, scratch

#: Fewest letters of a word, fewest occurrences, and how many times as frequent as a word its form is.
MIN_LETTERS, MIN_COUNT, DOMINANCE = 7, 2, 10
#: One of so many runs loses a letter, picked by its hash.
DELETE_ONE_OF = 31
#: Letters up to which keys are text.
LONG = 64
#: Keys of a long word made at once.
CHUNK = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Primes and bases of the long words' hashes.
_HASHES = ((2147483647, 911382323), (2147483629, 972663749), (2147483587, 1046527), (2147483579, 741103597))


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all texts with their number of occurrences, n."""
    lowered = F.translate(docs[text], _UPPER, _LOWER)
    runs = docs.select(docs[doc_id].cast("string").alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit("[a-zÀ-ÿ]{%d,}" % MIN_LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    found = runs.select(F.when(F.col("h") % DELETE_ONE_OF == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def ranked(vocabulary: DataFrame) -> DataFrame:
    """The words numbered by rank: the smaller r, the better. To be written before it is used, so that numbers stay."""
    return vocabulary.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("r"), "word", "n")


def _powers(base: int, n: int, p: int) -> np.ndarray:
    """base ** 0 to base ** n, modulo p."""
    out, step = np.ones(1, dtype=np.uint64), np.uint64(base)
    while len(out) <= n:
        out = np.concatenate([out, out * step % np.uint64(p)])
        step = step * step % np.uint64(p)
    return out[: n + 1]


def _long_hashes(word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Four numbers each (as rows) of the word, of it with each place left open, and of it without each letter."""
    x = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    whole, opened, without = [], [], []
    for p, base in _HASHES:
        prime, inverse = np.uint64(p), np.uint64(pow(base, -1, p))
        terms = x * _powers(base, len(x) - 1, p) % prime
        upto = np.cumsum(terms)  # at most 2**31 for each letter
        total = upto[-1] % prime
        whole.append(total)
        opened.append((total + prime - terms) % prime)
        after = (upto[-1] - upto) % prime
        without.append(((upto - terms) % prime + after * inverse) % prime)
    return np.array(whole, dtype=np.uint64), np.array(opened, dtype=np.uint64).T, np.array(without, dtype=np.uint64).T


def _long_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def texts(kind: str, rows: np.ndarray, start: int = 0) -> list[str]:
        return [f"{kind}{start + i if kind[0] == '*' else ''}:" + "%x.%x.%x.%x" % tuple(r) for i, r in enumerate(rows.tolist())]

    for frame in batches:
        for r, word in zip(frame["r"], frame["word"], strict=True):
            whole, opened, without = _long_hashes(word)
            n = len(word)
            yield pd.DataFrame({"key": texts(f"={n}", whole[None]), "own": True, "r": r})
            if n <= LONG:
                continue
            for kind, rows in ((f"*{n}:", opened), (f"={n - 1}", np.unique(without, axis=0))):
                for a in range(0, len(rows), CHUNK):
                    yield pd.DataFrame({"key": texts(kind, rows[a : a + CHUNK], a), "own": False, "r": r})


def _keys(vocabulary: DataFrame) -> DataFrame:
    """(key, own, r): the keys of each word's open places, of it less a letter, and its own. A star marks the open place."""
    n, places = F.length("word"), F.sequence(F.lit(1), F.length("word"))
    without = F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, n)))
    opened = F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.lit("*"), F.substring("word", i + 1, n)))
    other = F.concat(opened, F.when(n > MIN_LETTERS, F.array_distinct(without)).otherwise(F.array().cast("array<string>")))
    short = vocabulary.where(n <= LONG)
    longer = vocabulary.where(n >= LONG).select("r", "word").mapInPandas(_long_keys, "key string, own boolean, r long")
    return short.select(F.col("word").alias("key"), F.lit(True).alias("own"), "r").union(short.select(F.explode(other).alias("key"), F.lit(False).alias("own"), "r")).union(longer)


def near(vocabulary: DataFrame) -> DataFrame:
    """r, n_near and best (the smallest number of a near word) of each word that is near to any."""
    group = W.partitionBy("key")
    ordered = group.orderBy("r").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = _keys(vocabulary).select(
        "key", "own", "r", F.count("*").over(ordered).alias("size"), F.first("r").over(ordered).alias("first"), F.nth_value("r", 2).over(ordered).alias("second"),
        F.max(F.when(F.col("own"), F.col("r"))).over(ordered).alias("whole"), F.min(F.when(~F.col("own"), F.col("r"))).over(ordered).alias("longer"),
    ).where("size > 1")
    other = F.when(F.col("first") == F.col("r"), F.col("second")).otherwise(F.col("first"))
    opened = F.contains(F.col("key"), F.lit("*"))
    count = F.when(opened | F.col("own"), F.col("size") - 1).when(F.col("whole").isNotNull(), 1)
    best = F.when(opened, other).when(F.col("own"), F.col("longer")).otherwise(F.col("whole"))
    return seen.select("r", count.cast("long").alias("count"), best.alias("best")).where("count > 0").groupBy("r").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """links (r, to) followed to their ends."""
    while True:
        ahead = links.select(F.col("r").alias("at"), F.col("to").alias("next"))
        moved = cut(links.join(ahead, links["to"] == ahead["at"], "left").select("r", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        discard(links)
        links = moved
        if moved.where("moved").isEmpty():
            return moved.select("r", "to")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n."""
    with scratch(docs.sparkSession):
        vocabulary = cut(ranked(words(docs, doc_id, text)))
        better = vocabulary.select(F.col("r").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
        found = cut(vocabulary.join(near(vocabulary), "r", "left").join(better, "best", "left").select("r", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(F.when(F.col("form_n") >= DOMINANCE * F.col("n"), F.col(c)).alias(c) for c in ("best", "form", "form_n"))))
        roots = _roots(cut(found.where("best IS NOT NULL").select("r", F.col("best").alias("to"))))
        ends = roots.join(vocabulary.select(F.col("r").alias("to"), F.col("word").alias("root")), "to").select("r", "root")
        return keep(found.join(ends, "r", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


ORACLE_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
),
run AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents
),
bytes AS (
  SELECT w, flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + ord(c) // 64 AS BIGINT), CAST(128 + ord(c) % 64 AS BIGINT)] END)) AS b
  FROM run WHERE length(w) >= {MIN_LETTERS}
),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) AS h FROM bytes, steps),
word AS (
  SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % {DELETE_ONE_OF} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
  WHERE length(word) >= {MIN_LETTERS} GROUP BY word HAVING count(*) >= {MIN_COUNT}
),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
opened AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM place),
pair AS (
  SELECT x.word, y.word AS other, y.n FROM opened x JOIN opened y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM opened x JOIN word y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM opened x JOIN word y ON y.word = x.a || x.b
),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS form, max(n) AS form_n FROM pair GROUP BY word),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {DOMINANCE} * w.n THEN form END AS form, CASE WHEN form_n >= {DOMINANCE} * w.n THEN form_n END AS form_n FROM word w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM word UNION ALL SELECT c.word, f.form FROM chain c JOIN found f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM found f JOIN chain c USING (word) JOIN found e ON e.word = c.at WHERE e.form IS NULL
"""
