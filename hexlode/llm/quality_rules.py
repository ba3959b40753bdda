"""Quality rules: decision lists learned from labelled statistics, in DataFrame functions alone.

Sequential covering: a rule is grown on two thirds of the labelled rows by adding the threshold (statistic at most or above a cut) of the
largest information gain, until it covers no good row or nothing gains; it is pruned on the last third to the prefix of best
(bad - good) / (bad + good); and it joins the list if it is precise enough there. The rows that it covers go, and the next rule is grown. Cuts
are midpoints between quantiles of the bad and of the good rows. Every step is one aggregation of the binned labelled rows, of which the driver
gets a count for each cut. The list is emitted as ordered CASE conditions over the statistics; documents that no rule rejects are kept.

It learns from at most MAX_ROWS labelled documents, those with the smallest hashes of their doc_id. The base rules are not learned, and rows that
fail them are not learned from: n_words under MIN_WORDS, or over MAX_REPEAT % of the words in repeated windows, are never kept.

Windows of three words are compared by 64-bit hashes within a text. A null or empty text has no words and so fails the base rules. Null labels are left
out, several of one doc_id are averaged (bad under a half), and of several rows of a doc_id the largest statistics are learned from; without labels there is no rule. Repeated rows get equal results;
extra columns never clash. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, scratch

#: The base rules.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Labelled documents that the list is learned from at most.
MAX_ROWS = 50_000
#: Quantiles of each class that cuts lie between; conditions of a rule, rules of a list.
QUANTILES, MAX_CONDITIONS, MAX_RULES = 24, 4, 8
#: Precision and bad rows that a rule needs where it is pruned.
MIN_PRECISION, MIN_COVER = 0.9, 3
#: What thresholds stand on: each is a share or a mean, or the number of words.
STATISTICS = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_a_word": "n_symbols / greatest(n_words, 1)",
    "repeated_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "different_words": "n_distinct / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}
_SPACE = " \t\n\x0b\x0c\r"
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where Spark copies the expression into a filter."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """How many words stand in windows of three that are found twice or more."""
    counted = lambda places: F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    same = lambda rows, i, x: F.coalesce(F.get(rows, i)["h"] == x["h"], F.lit(False))
    places = lambda rows: F.sort_array(F.transform(F.filter(rows, lambda x, i: same(rows, i - 1, x) | same(rows, i + 1, x)), lambda x: x["i"]))
    paired = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    # only texts with a window found twice are sorted
    found = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(paired(h), lambda rows: _let(places(rows), counted))).otherwise(F.lit(0))
    windows = lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(words, lambda w: F.when(F.size(w) > 3, _let(windows(w), found)).otherwise(F.lit(0)))


def measured(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    """keep, and the counts of each text that statistics are made of, in columns of these names; keep's must differ."""
    whole = F.coalesce(docs[text], F.lit(""))
    found = docs.select(*keep, whole.alias("_text"), F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("_words"), F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "").alias("_lines"))
    text_length = F.length("_text")
    return found.select(
        *(c for c in found.columns if c not in ("_text", "_words", "_lines")), F.size("_words").cast("long").alias("n_words"), _without(F.col("_text"), _SPACE).cast("long").alias("word_chars"), (text_length - _without(F.col("_text"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), _repeated(F.col("_words")).cast("long").alias("n_repeat_words"), F.size("_lines").alias("n_lines"), F.size(F.array_distinct("_words")).alias("n_distinct"),
        (text_length - _without(F.col("_text"), "0123456789")).alias("n_digits"), (text_length - _without(F.col("_text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{STATISTICS[self.statistic]} {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class Rule:
    """Rejects the documents that meet all conditions."""

    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def emitted(rules: list[Rule]) -> str:
    """The decision list as one ordered SQL condition over measured(): the number of the first rule that rejects, else null."""
    return "CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " END" if rules else "CAST(NULL AS INT)"


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, max_rows: int) -> DataFrame:
    """bad, prune and the statistics of labelled documents that pass the base rules."""
    known = labels.where(labels[label].isNotNull() & labels["doc_id"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("id")).agg((F.avg(labels[label]) < 0.5).cast("int").alias("bad"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(docs[doc_id].alias("_id"), docs[text].alias("text")).join(F.broadcast(known), F.col("_id") == F.col("id")).select("id", "bad", "text")  # max_rows bounds what is broadcast
    # written first: Spark would push the condition below the counts, and count twice
    found = cut(measured(texts, "text", F.col("id"), F.col("bad"))).where(~base_failed())
    one = found.groupBy("id", "bad").agg(F.max(F.struct(*(F.expr(e).cast("double").alias(s) for s, e in STATISTICS.items()))).alias("s"))
    return one.select("bad", (F.pmod(F.xxhash64("id", F.lit("prune")), F.lit(3)) == 0).alias("prune"), "s.*")


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Midpoints between the quantiles of each class."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(s, at, 10_000).alias(s) for s in STATISTICS)).collect()
    values = {s: sorted({v for r in found for v in r[s] or ()}) for s in STATISTICS}
    return {s: [(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for s, v in values.items()}


def _gain(bad: float, good: float, all_bad: float, all_good: float) -> float:
    """FOIL's information gain of narrowing (all_bad, all_good) to (bad, good)."""
    return bad * (math.log2(bad / (bad + good)) - math.log2(all_bad / (all_bad + all_good))) if bad else 0.0


def learn(rows: DataFrame) -> list[Rule]:
    """A decision list from rows of bad (1 or 0), prune and the statistics, written by the caller."""
    cuts = _cuts(rows)
    names = [s for s in STATISTICS if cuts[s]]
    # the number of cuts below a value; equal rows become one with their number
    binned = rows.select("bad", "prune", *(F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[s])}), c -> c < {s}))").alias(s) for s in names))
    left, rules = cut(binned.groupBy("bad", "prune", *names).agg(F.count("*").alias("n"))), []
    bad, good = F.sum(F.col("bad") * F.col("n")), F.sum((1 - F.col("bad")) * F.col("n"))

    def meets(condition: tuple[str, bool, int]) -> Column:
        s, above, at = condition
        return F.col(s) > at if above else F.col(s) <= at

    def meeting(conditions: list[tuple[str, bool, int]]) -> Column:
        return F.forall(F.array(*map(meets, conditions)), lambda x: x) if conditions else F.lit(True)

    while names and len(rules) < MAX_RULES:
        conditions: list[tuple[str, bool, int]] = []
        while len(conditions) < MAX_CONDITIONS:
            each = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(s).alias("at")) for s in names))).alias("x")
            counts = left.where(~F.col("prune") & meeting(conditions)).select("bad", "n", each).groupBy("x.s", "x.at").agg(bad.alias("bad"), good.alias("good")).collect()  # a row for each cut at most
            by = {(r["s"], r["at"]): (r["bad"], r["good"]) for r in counts}
            total = [sum(by[k][c] for k in by if k[0] == names[0]) for c in (0, 1)]
            if not total[0] or not total[1]:
                break
            best, chosen = 0.0, None
            for s in names:
                below = [0, 0]
                for at in range(len(cuts[s])):
                    below = [below[c] + by.get((s, at), (0, 0))[c] for c in (0, 1)]
                    for above, side in ((True, [total[c] - below[c] for c in (0, 1)]), (False, below)):
                        if (gain := _gain(*side, *total)) > best + 1e-9:
                            best, chosen = gain, (s, above, at)
            if chosen is None:
                break
            conditions.append(chosen)
        if not conditions:
            break
        prefixes = [conditions[: i + 1] for i in range(len(conditions))]
        held = left.where("prune").agg(*(F.struct(F.coalesce(F.sum(F.when(meeting(p), F.col("bad") * F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.when(meeting(p), (1 - F.col("bad")) * F.col("n"))), F.lit(0)).alias("good")).alias(str(i)) for i, p in enumerate(prefixes))).first()
        worth = [((h["bad"] - h["good"]) / max(1, h["bad"] + h["good"]), -i) for i, h in enumerate(held)]
        i = -max(worth)[1]
        if held[i]["bad"] < MIN_COVER or held[i]["bad"] < MIN_PRECISION * (held[i]["bad"] + held[i]["good"]):
            break
        rules.append(Rule(tuple(Condition(s, above, cuts[s][at]) for s, above, at in prefixes[i])))
        left = left.where(~meeting(prefixes[i]))
    return rules


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> list[Rule]:
    """The decision list of the labelled documents; label is 1 for good ones."""
    with scratch(docs.sparkSession):
        return learn(cut(_labelled(docs, labels, doc_id, text, label, max_rows)))


def judged(docs: DataFrame, rules: list[Rule], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and rule: the number of the learned rule that rejects the document."""
    found = measured(docs, text, docs[doc_id].alias("doc_id")).withColumn("rule", F.expr(emitted(rules)))
    return found.select("doc_id", *_BASE, base_failed().alias("base_failed"), (~base_failed() & F.col("rule").isNull()).alias("kept"), "rule")
