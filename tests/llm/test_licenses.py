"""License scans against all chains of hits, and their base columns against SQL."""

import random
import re

from hexlode.llm import license_scan as L
from tests.duck import SMALL, rows, sql_rows

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def notice_share(w, template):
    """The best share over every chain of hits, each enumerated."""
    t = template.split()
    hits = [(p, k) for p in range(len(w) - 1) for k in range(len(t) - 1) if w[p : p + 2] == t[k : k + 2]]
    chains = [[h] for h in hits]
    ends = {}
    while chains:
        c = chains.pop()
        p, k = c[-1]
        ends.setdefault((p, k), []).append((len(c), c[0][0]))
        chains += [[*c, (q, j)] for q, j in hits if q > p and j > k and q - p <= L.GAP and abs(q - j - p + k) <= L.SLACK]
    best = [(max(x), p) for (p, _), x in ends.items()]
    return max((n / max(len(t) - 1, p - start + 1) for (n, start), p in best), default=0.0)


def expected(text):
    w = words(text)
    base = [(i, label) for phrase, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    shares = [(s, label) for phrase, label in L.NOTICES.items() if (s := notice_share(w, phrase)) >= L.SHARE]
    labels = {x for _, x in base}
    starts = [i for i, _ in base]
    score = max([1.0] * bool(base) + [s for s, _ in shares], default=0.0)
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for _, x in shares})), round(score, 9)


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    assert len(got) == len(texts)
    return [(got[i]["n_words"], got[i]["n_base"], got[i]["first_word"], got[i]["last_word"], got[i]["base_labels"], got[i]["labels"], round(got[i]["score"], 9)) for i in range(len(texts))]


def test_against_all_chains(spark):
    r = random.Random(3)
    texts = [None, "", " . ", "CC", "cc by cc by", "accord by", "Cc\u00e9 by", "MIT\x7fLicense", "\u212a license", "apache license apache license"]
    for _ in range(150):
        w = r.choice(list(L.NOTICES)).split()
        for _ in range(r.randint(0, 6)):
            at, kind = r.randrange(len(w)), r.random()
            if kind < 0.3:
                w[at : at + 1] = []
            elif kind < 0.6:
                w[at:at] = [r.choice(("x", "the", "license"))] * r.randint(1, 3)
            elif kind < 0.8:
                w[at] = "y"
            else:
                w = w[at:] + w[:at]
            w = w or ["z"]
        texts.append(r.choice((" ", ", ", "\n")).join(r.choice((str.upper, str, str.title))(x) for x in ["a"] * r.randint(0, 2) + w))
    assert found(spark, texts) == [expected(t) for t in texts]


def test_scattered_and_reversed_words_are_no_notice(spark):
    texts = []
    for phrase in L.NOTICES:
        w = phrase.split()
        texts.append(" x ".join(f"{a} {b}" for a, b in zip(w, w[1:], strict=False)))
        texts.append(" ".join(f"{a} {b}" for a, b in list(zip(w, w[1:], strict=False))[::-1]))
        texts.append(" ".join(w[::-1]))
    got = found(spark, texts)
    assert all(not any(x.startswith("notice") for x in g[5].split(",")) for g in got)
    whole = found(spark, list(L.NOTICES))
    assert all(label in g[5].split(",") and g[6] == 1.0 for g, label in zip(whole, L.NOTICES.values(), strict=True))


SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t(phrase, label) AS (VALUES ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')),
p AS (SELECT doc_id, label, i - 1 AS w_at FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), t WHERE array_to_string(w[i : i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
g AS (SELECT doc_id, count(*) AS n_base, min(w_at) AS first_word, max(w_at) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN g USING (doc_id)
"""


def test_base_columns_against_sql(spark):
    got = L.scan(spark.read.parquet(f"{SMALL}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").toPandas()
    assert rows(got) == sql_rows(SQL, SMALL)
