"""Text functions: tokens, stems, sentences, overlap, previews and query routing."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: A sentence ends before white space that follows one of these.
SENTENCE = r"(?<=[.!?])\s+"
LEAST_SENTENCE = 6


def strip(text: Column) -> Column:
    """Without white space at both ends (trim takes spaces alone)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tokens(text: Column, stem: bool = False) -> Column:
    """Lower-case runs of ASCII letters and digits, of two characters at least."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)
    return stemmed(found) if stem else found


def word_tokens(text: Column) -> Column:
    """Lower-case runs of word characters, as evaluation counts them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\w]+)"), 1)


def sentences(text: Column) -> Column:
    """Stripped sentences longer than five characters; the whole text if there are none."""
    parts = F.filter(F.transform(F.split(text, SENTENCE), strip), lambda s: F.length(s) >= LEAST_SENTENCE)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def overlap(query: Column, text: Column) -> Column:
    """The share of a query's distinct tokens that a text's tokens hold; 0 for an empty query."""
    n = F.size(F.array_distinct(query))
    return F.when(n > 0, F.size(F.array_intersect(query, text)) / n).otherwise(0.0)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def human_size(n: float) -> str:
    """Bytes with one decimal in the largest unit, up to TB, that leaves 1 or more."""
    power = min(4, int(math.log(n, 1024))) if n >= 1 else 0
    return f"{n / 1024**power:.1f} {('B', 'KB', 'MB', 'GB', 'TB')[power]}"


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def cleaned(text: Column, n: int) -> Column:
    """Without tags, with character references decoded and white space collapsed, n characters at most."""
    plain = F.regexp_replace(_unescaped(text), "<[^>]+>", " ")
    return F.substring(strip(F.regexp_replace(plain, r"\s+", " ")), 1, n)


#: Patterns of query kinds, tried in this order.
ROUTES = (
    ("temporal", r"(?i)\b(when|how long|before|after|during|date|year|month|first time|last time|how many (?:days|months|years)|\d{4})\b"),
    ("multihop", r"(?i)\b(relationship between|how.*connected|both|common between|link between)\b"),
    ("entity", r"(?i)\b(who is|what is|where is|who was|what was|tell me about)\b"),
)
#: The filter that goes with a kind of query.
ROUTE_FILTERS = {"entity": {"type": "extracted_fact"}}


def route(query: Column) -> Column:
    """The kind of a query: temporal, multihop, entity or default."""
    out = F.lit("default")
    for name, pattern in reversed(ROUTES):
        out = F.when(query.rlike(pattern), name).otherwise(out)
    return out



def _is_consonant(w: str, i: int) -> bool:
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not _is_consonant(w, i - 1))


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = "".join("c" if _is_consonant(w, i) else "v" for i in range(len(w)))
    return len(re.findall("v+c+", kinds))


def _has_vowel(w: str) -> bool:
    return any(not _is_consonant(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_consonant(w, n - 3) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 1) and w[-1] not in "wxy"


#: The suffixes of steps 2, 3 and 4 of Porter's published algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    """The stem of a lower-case word by Porter's algorithm of 1980."""
    if len(w) <= 2:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    shortened = False
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (s := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(s)]):
        w, shortened = w[: -len(s)], True
    if shortened:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, STEP_4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    memo: dict[str, str] = {}
    for batch in batches:
        if len(memo) > 500_000:
            memo.clear()
        yield batch.map(lambda ws: None if ws is None else [memo[w] if w in memo else memo.setdefault(w, porter(w)) for w in ws])
