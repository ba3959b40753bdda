"""Relevance by labels: the same measures as from all pairs, of which none is made."""

from hexlode.operators import evaluate
from tests.metrics import most_rows


def _results(spark, n, queries):
    rows = [(mode, q, (q * 7 + i * step) % (n + 3), 1 / (i + 1), i + 1) for q in queries for mode, step in (("a", 1), ("b", 5)) for i in range(12)]
    return spark.createDataFrame(rows, "mode string, query_id long, node_id long, score double, rank int")


def test_labels_judge_as_pairs_do(spark):
    labels = [(i, None if i % 11 == 0 else i % 4) for i in range(200)] + [(i, 3) for i in range(0, 40, 3)] + [(5, 1), (7, 9)]
    nodes, asked = spark.createDataFrame(labels, "node_id long, label int"), spark.createDataFrame([r for r in labels if r[0] % 5 == 0] + [(1000, 77)], "query_id long, label int")
    pairs = asked.join(nodes, "label").select("query_id", "node_id")
    results = _results(spark, 200, range(0, 200, 5))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    by = evaluate.by_label(nodes, asked)
    assert rows(evaluate.metrics(results, by, 10, by=("mode",))) == rows(evaluate.metrics(results, pairs, 10, by=("mode",)))
    assert rows(evaluate.effectiveness(results, by)) == rows(evaluate.effectiveness(results, pairs))
    scored = results.where("mode = 'a'").selectExpr("query_id", "node_id", "score AS v", "1 - score AS g")
    assert rows(evaluate.weight_ablation(scored, by)) == rows(evaluate.weight_ablation(scored, pairs))


def test_no_pair_of_a_label_is_made(spark):
    nodes = spark.range(4000).selectExpr("id AS node_id", "1 AS label")
    asked = nodes.where("node_id % 20 = 0").withColumnRenamed("node_id", "query_id")
    results = _results(spark, 4000, range(0, 4000, 20))
    measured = evaluate.metrics(results, evaluate.by_label(nodes, asked), by=("mode",)).collect()
    assert len(measured) == 400 and most_rows(spark) <= 6000  # 4800 results; there are 800000 pairs
    evaluate.effectiveness(results, evaluate.by_label(nodes, asked)).collect()
    assert most_rows(spark) <= 6000
    evaluate.metrics(results, asked.join(nodes, "label").select("query_id", "node_id"), by=("mode",)).collect()
    assert most_rows(spark) >= 800000


def test_ablation_makes_no_pair_of_a_label(spark, monkeypatch):
    from hexlode.plans import catalog

    got, by_label = [], evaluate.by_label
    monkeypatch.setattr(evaluate, "by_label", lambda *a: got.append(by_label(*a)) or got[-1])
    found = catalog.QUERIES["ablation_conditions"](spark, "/root/testdata/sf0.001").collect()
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert len(got) == 1 and len(found) == 5 and most_rows(spark) <= 6 * n  # five conditions' ten results for each twentieth document, and all documents
