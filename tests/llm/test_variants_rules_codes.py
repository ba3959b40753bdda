"""Spelling variants, quality rules and vector codes against brute force, and their odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hexlode.llm import hamerly, quality_rules as rules, queries, spelling
from tests.duck import CHECKED

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Q = queries.queries()


def brute_variants(docs):
    counts = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [form, w, n[w], len(others), n[form] if form else None]
    for r in out.values():
        while out[r[1]][0]:
            r[1] = out[r[1]][0]
    return {w: tuple(r) for w, r in out.items()}


def test_variants_by_brute_force(spark):
    rng = np.random.default_rng(11)
    long = "".join(rng.choice(list("abcé"), 90))
    just = "".join(rng.choice(list("xyz"), 64))
    frequent = {"spelling": 400, "speling": 33, "spellling": 2, "spellinh": 3, "spelinb": 3, "aaaaaaa": 50, "aaaaaaaa": 4, "aaaaaaaaa": 3, "ÀÉÎÕÜß×": 25, "àÉÎÕÜß×": 2, "ÉÎÕÜß×ÿa": 4, long: 40, long[:50] + "z" + long[51:]: 3, long[1:]: 3, long + long[-1]: 2, just: 30, just + "q": 2, just[1:]: 3}
    tokens = [w for w, k in frequent.items() for _ in range(k)] + ["Short", "once1only"] + ["".join(rng.choice(list("ab"), 7)) for _ in range(1500)]
    rng.shuffle(tokens)
    docs = [(i, " ".join(tokens[a : a + 37]).replace("spelling", "SPELLing")) for i, a in enumerate(range(0, len(tokens), 37))]
    docs += [(None, "nullidsword nullidsword"), (7, None), (8, ""), (9, "  \n"), docs[3], docs[3]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "r", "key", "id", "run", "h")})
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df).collect()}
    want = brute_variants(docs)
    assert got == want
    forms = {w for w, r in want.items() if r[0]}
    assert any(r[0] and r[1] != r[0] for r in want.values()) and long[1:] in forms and just + "q" in forms and "spellinh" in forms and want["nullidsword"][2] == 2
    assert spelling.variants(df.where(F.lit(False))).count() == 0


def test_variants_of_a_long_run(spark):
    run = "ab" * 100_000
    df = spark.createDataFrame([(1, run), (2, run), (3, run + "c"), (4, run + "c")], "doc_id long, text string")
    got = spelling.variants(df).select("n", "n_near", F.length("word").alias("l")).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 200_000), (2, 1, 200_001)]


def brute_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_base_counts(spark):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet").select("doc_id", "text")
    texts = [None, "", " \n\t", "a b", "a b c", "a b c a b c", "x x x x", "x x x y x x x", "a\na\n a\n\na", "é#|<>日本 %%\x0b$&*", "\x00 \x1f\x85 b", " ".join(f"w{i % 977}" for i in range(60_000)), "<" * 500_000, " " * 500_000, "same line here\n" * 3000]
    extra = [(-1 - i, t) for i, t in enumerate(texts)] + [(None, "a b c"), (-5, "a b c")]
    df = docs.union(spark.createDataFrame(extra, docs.schema)).withColumns({c: F.lit("x") for c in ("n_words", "rule", "kept", "id", "bad", "words", "_text", "_words", "n_lines")})
    got = sorted((tuple(r) for r in rules.judged(df, []).collect()), key=repr)
    want = []
    for i, t in [*(tuple(r) for r in docs.collect()), *extra]:
        b = brute_statistics(t)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        want.append((i, *b, failed, not failed, None))
    assert got == sorted(want, key=repr)
    assert rules.judged(df.where(F.lit(False)), []).count() == 0


def test_rules_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learned = rules.train(docs, labels.where(~held))
    assert 1 <= len(learned) <= rules.MAX_RULES
    got = rules.judged(docs, learned).join(labels.where(held), "doc_id").where("NOT base_failed").toPandas()
    assert got.kept[got.quality == 1].mean() > 0.99 and got.kept[got.quality == 0].mean() < 0.05


def test_rules_find_a_conjunction(spark):
    """Bad rows are those with a over 0.5 and b up to 0.3, or c over 0.9."""
    rng = np.random.default_rng(2)
    x = rng.random((6000, 3))
    bad = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)) | (x[:, 2] > 0.9)
    names = list(rules.STATISTICS)
    frame = spark.createDataFrame([(int(b), bool(i % 3 == 0), *map(float, r), *[0.0] * (len(names) - 3)) for i, (b, r) in enumerate(zip(bad, x, strict=True))], f"bad int, prune boolean, {', '.join(f'{n} double' for n in names)}")
    found = rules.learn(frame)
    holds = lambda r, row: all((row[names.index(c.statistic)] > c.cut) == c.above for c in r.conditions)
    said = np.array([any(holds(r, row) for r in found) for row in x])
    assert 2 <= len(found) <= 4 and (said == bad).mean() > 0.96 and any(len(r.conditions) > 1 for r in found)
    # the list is one ordered condition
    assert rules.emitted(found).startswith("CASE WHEN ") and rules.emitted(found).count("WHEN") == len(found)


def test_rules_without_labels(spark):
    docs = spark.read.parquet(f"{CHECKED}/documents.parquet")
    none = spark.createDataFrame([(1, None), (None, 0)], "doc_id long, quality int")
    assert rules.train(docs, none) == [] and rules.train(docs.where(F.lit(False)), none.where(F.lit(False))) == []
    good = docs.selectExpr("doc_id", "1 AS quality")
    assert rules.train(docs, good) == []
    # labels of one document are averaged, repeated rows count once
    twice = docs.selectExpr("doc_id", "explode(array(0, 1)) AS quality")
    assert rules.train(docs.union(docs), twice) == []


def brute_codes(rows):
    """rows: (vec_id, label, vector), all usable. Plain Lloyd rounds in Python integers."""
    kept = sorted(((i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // 16
    cut = lambda v, p: v[p * w : p * w + w]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, _, v in kept[:64]] for p in range(16)]
    for turn in range(3):
        codes = [[min(range(len(books[p])), key=lambda e: (dist(cut(v, p), books[p][e]), e)) for p in range(16)] for _, _, v in kept]
        if turn < 2:
            for p in range(16):
                for e in range(len(books[p])):
                    own = [cut(v, p) for (_, _, v), c in zip(kept, codes, strict=True) if c[p] == e]
                    if own:
                        books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    errors = [sum(dist(cut(v, p), books[p][c[p]]) for p in range(16)) for (_, _, v), c in zip(kept, codes, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    totals = Counter()
    for (_, lab, _), e in zip(kept, errors, strict=True):
        if e < 1 << 63:
            totals[lab] += e
    return sorted(((i, bytes(c).hex(), e if e < 1 << 63 else None, totals.get(lab), digest) for (i, lab, _), c, e in zip(kept, codes, errors, strict=True)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit("x") for c in ("v", "codes", "upper", "lower", "error", "code", "_label", "p", "n")})


@pytest.mark.parametrize("scale", [0.01, 0.1, 3e7])
def test_codes_by_brute_force(spark, scale):
    """Coarse components give many ties; the largest are beyond 64 bits when squared."""
    rng = np.random.default_rng(4)
    rows = [(int(i) * 3, None if i % 7 == 0 else int(i % 3), (rng.standard_normal(32) * scale).round(2).tolist()) for i in range(300)]
    rows += [rows[5], rows[5], (None, 1, rows[9][2]), (4, 2, [0.0] * 32), (10_000, 2, [-x for x in rows[1][2]])]
    bad = [(1, 0, None), (2, 0, [float("nan")] + [0.0] * 31), (5, 0, [float("-inf")] + [0.0] * 31), (7, 0, [None] + [0.0] * 31)]
    got = sorted((tuple(r) for r in hamerly.compress(frame(spark, rows + bad)).collect()), key=repr)
    assert got == brute_codes(rows)


def test_codes_of_few_and_odd_rows(spark):
    few = [(i, None, [float(i), -0.001] * 8) for i in range(5)]
    got = sorted((tuple(r) for r in hamerly.compress(frame(spark, few)).collect()), key=repr)
    assert got == brute_codes(few)
    odd = hamerly.compress(frame(spark, [*few, (-3, 1, [1.0] * 15), (90, 1, [1.0] * 32), (91, 1, []), (92, 1, [1e300] * 16)])).collect()
    by = {r["vec_id"]: r for r in odd}
    assert len(odd) == 9 and all(by[i]["code"] is None and by[i]["error"] is None for i in (-3, 90, 91)) and by[0]["code"] == "00" * 16 and by[92]["code"] == "05" * 16 and by[92]["error"] == 0
    assert hamerly.compress(frame(spark, [(1, 1, None)])).count() == 0 == hamerly.compress(frame(spark, few).where("false")).count()


def test_bounds_spare_scans():
    rng = np.random.default_rng(6)
    x = rng.integers(-300, 300, (2000, 16, 4))
    books = np.ascontiguousarray(x[:64].transpose(1, 0, 2))
    first = hamerly.assign(x, books)
    new = books.copy()
    for p in range(16):
        for e in range(64):
            own = x[first[0][:, p] == e, p]
            new[p, e] = own.sum(0) // len(own) if len(own) else books[p, e]
    plain = hamerly.assign(x, new)
    spared = hamerly.assign(x, new, books, first[:3])
    assert (plain[0] == spared[0]).all() and spared[3] < plain[3] == x.shape[0] * 16
    still = hamerly.assign(x, new, new, plain[:3])
    assert (still[0] == plain[0]).all() and still[3] < 0.05 * plain[3]


def test_queries_are_registered(spark):
    assert {"op11_spelling", "op12_quality_rules", "op13_hamerly"} < set(Q)
    assert set(Q["op12_quality_rules"](spark, CHECKED).columns) >= {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
