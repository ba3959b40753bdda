"""The registered queries of the retrieval engine over the driver's tables, each with its SQL.

Documents are nodes, embeddings their vectors (vec_id = doc_id), conversations chains of turns. Searches take as queries every
row whose id is divisible by 20, or all of benchmark, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import filters, text as X, vectors as V
from ..operators import bm25, changes, evaluate, forest, graph, hybrid, ingest, ivf, vector
from ..shared import fresh_dir
from ..sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


Read = Callable[[str], DataFrame]
EVERY = 20


# Inputs


def vectors_of(read: Read) -> DataFrame:
    return read("embeddings").withColumnRenamed("vec_id", "node_id")


def searched(df: DataFrame, id: str = "node_id") -> DataFrame:
    return df.where(F.col(id) % EVERY == 0).withColumn("query_id", F.col(id))


def documents_with_vectors(read: Read) -> DataFrame:
    return read("documents").withColumnRenamed("doc_id", "node_id").join(vectors_of(read), "node_id")


def turns(read: Read) -> DataFrame:
    return read("conversations").withColumn("node_id", F.col("conv_id") * 1000 + F.col("turn"))


def turn_edges(read: Read) -> DataFrame:
    return ingest.session_edges(turns(read), "conv_id", "turn")


UNIT = "u AS (SELECT vec_id AS node_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"
COS = "round(list_dot_product(a.e, b.e) / (a.n * b.n), 6)"
TURN = "t AS (SELECT *, conv_id * 1000 + turn AS node_id FROM conversations), l AS (SELECT lag(node_id) OVER (PARTITION BY conv_id ORDER BY turn, node_id) AS source_id, node_id AS target_id, conv_id FROM t), p AS (SELECT * FROM l WHERE source_id IS NOT NULL)"
TOKENS = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: len(x) > 1)"


# Vectors


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS query_id, b.node_id, {COS} AS score FROM u a, u b WHERE a.node_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s WHERE score >= 0) SELECT * FROM r WHERE rank <= 10")
def vector_topk(read: Read) -> DataFrame:
    v = vectors_of(read)
    return vector.vector_search(v, searched(v))


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS query_id, b.node_id, {COS} AS score FROM u a, u b JOIN documents d ON d.doc_id = b.node_id WHERE a.node_id % 20 = 0 AND d.lang = 'en'), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s WHERE score >= 0) SELECT * FROM r WHERE rank <= 10")
def vector_topk_filtered(read: Read) -> DataFrame:
    rows = documents_with_vectors(read).withColumn("metadata", F.to_json(F.struct("lang", "source")))
    return vector.vector_search(rows, searched(vectors_of(read)), where=filters.metadata_filter({"lang": "en"}))


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS query_id, b.node_id, {COS} AS score FROM u a, u b WHERE a.node_id % 20 = 0) SELECT * FROM s WHERE score >= 0.25")
def vector_min_score(read: Read) -> DataFrame:
    v = vectors_of(read)
    return vector.similar(searched(v), v, None, "query_id", "node_id", min_score=0.25).select("query_id", "node_id", "score")


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS query_id, b.node_id, regexp_replace(d.text, '^\\s+|\\s+$', '', 'g') AS t, {COS} AS score FROM u a, u b JOIN documents d ON d.doc_id = b.node_id WHERE a.node_id % 20 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY score DESC, node_id) AS i FROM s WHERE score >= 0), r AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM o WHERE i = 1) SELECT * FROM r WHERE rank <= 10")
def vector_dedup(read: Read) -> DataFrame:
    return vector.vector_search(documents_with_vectors(read), searched(vectors_of(read)), text="text")


@query(f"WITH {UNIT} SELECT node_id, round(n, 6) AS length, round(e[1] / n, 6) AS first, round(e[-1] / n, 6) AS last FROM u")
def l2_normalize(read: Read) -> DataFrame:
    v = vectors_of(read).select("node_id", V.norm(F.col("embedding")).alias("n"), V.normalized(F.col("embedding")).alias("e"))
    return v.select("node_id", F.round("n", 6).alias("length"), F.round(F.element_at("e", 1), 6).alias("first"), F.round(F.element_at("e", -1), 6).alias("last"))


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS source_id, b.node_id AS target_id, {COS} AS score FROM u a, u b WHERE a.label <> b.label), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS rank FROM s WHERE score > 0.2) SELECT * FROM r WHERE rank <= 3")
def knn_graph_edges(read: Read) -> DataFrame:
    v = vectors_of(read)
    found = vector.similar(v, v, 3, "node_id", "node_id", min_score=0.2, strict=True, left_group="label", right_group="label", same_group=False)
    return found.withColumnsRenamed({"source_node_id": "source_id", "target_node_id": "target_id"})


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS source_id, b.node_id AS target_id, {COS} AS score FROM u a, u b WHERE a.node_id <> b.node_id), r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS i FROM s WHERE score >= 0.3) SELECT source_id, target_id, CASE WHEN score >= 0.85 THEN 'derived_from' ELSE 'analogous_to' END AS type, least(1.0, greatest(0.0, score)) AS weight FROM r WHERE i <= 5")
def auto_edges(read: Read) -> DataFrame:
    return vector.auto_edges(vectors_of(read), threshold=0.3).withColumnsRenamed({"source_node_id": "source_id", "target_node_id": "target_id"})


AVERAGED = f"{UNIT}, s AS (SELECT a.node_id, b.node_id AS o, {COS} AS score FROM u a, u b WHERE a.node_id <> b.node_id), r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, o) AS i FROM s), x AS (SELECT r.node_id, generate_subscripts(e, 1) AS k, unnest(e) AS v FROM r JOIN u ON u.node_id = r.o WHERE i <= 5), m AS (SELECT node_id, k, avg(v) AS v FROM x GROUP BY node_id, k), l AS (SELECT node_id, list(v ORDER BY k) AS mean FROM m GROUP BY node_id), w AS (SELECT u.node_id, u.e, u.n, [0.7 * z[1] + 0.3 * z[2] for z in list_zip(u.e, l.mean)] AS c FROM u JOIN l USING (node_id)), y AS (SELECT node_id, c, e, n, sqrt(list_dot_product(c, c)) AS cn FROM w)"


@query(f"WITH {AVERAGED} SELECT node_id, round(c[1] / cn, 5) AS first, round(list_dot_product(c, e) / (cn * n), 5) AS similarity FROM y")
def neighborhood_average(read: Read) -> DataFrame:
    a = vector.neighbourhood_average(vectors_of(read))
    return a.select("node_id", F.round(F.element_at("embedding", 1), 5).alias("first"), F.round(V.cosine(F.col("embedding"), F.col("raw_embedding")), 5).alias("similarity"))


@query(f"WITH {AVERAGED}, d AS (SELECT round(1 - list_dot_product(c, e) / (cn * n), 6) AS d FROM y) SELECT round(avg(d), 6) AS mean_drift, min(d) AS min_drift, max(d) AS max_drift, count(*) FILTER (d > 0.01) AS n_moved FROM d")
def embedding_drift(read: Read) -> DataFrame:
    return vector.drift(vector.neighbourhood_average(vectors_of(read)))


@query(f"WITH {UNIT}, s AS (SELECT a.label AS label_a, b.label AS label_b, list_dot_product(a.e, b.e) / (a.n * b.n) AS c FROM u a, u b WHERE a.node_id <> b.node_id AND a.label <= b.label) SELECT label_a, label_b, round(avg(c), 4) + 0.0 AS mean_cosine FROM s GROUP BY ALL")
def pairwise_cosine_by_label(read: Read) -> DataFrame:
    """Mean cosine of all pairs within and between labels, from the labels' summed unit vectors: no pair is made."""
    unit = vectors_of(read).select("label", F.posexplode(V.normalized(F.col("embedding"))).alias("k", "x"))
    sums = unit.groupBy("label", "k").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    n = vectors_of(read).groupBy("label").agg(F.count("*").alias("n"))
    one, two = sums.withColumnRenamed("label", "label_a"), sums.select(F.col("label").alias("label_b"), "k", F.col("s").alias("s2"))
    dots = one.join(two, "k").where("label_a <= label_b").groupBy("label_a", "label_b").agg(F.sum(F.col("s") * F.col("s2")).alias("d"), F.sum("q").alias("own"))
    sized = dots.join(n.withColumnsRenamed({"label": "label_a", "n": "na"}), "label_a").join(n.withColumnsRenamed({"label": "label_b", "n": "nb"}), "label_b")
    same = F.col("label_a") == F.col("label_b")
    mean = F.when(same, F.try_divide(F.col("d") - F.col("own"), F.col("na") * (F.col("na") - 1))).otherwise(F.col("d") / (F.col("na") * F.col("nb")))
    return sized.select("label_a", "label_b", (F.round(mean, 4) + 0.0).alias("mean_cosine")).where("mean_cosine IS NOT NULL")


@query(f"WITH {UNIT}, s AS (SELECT a.label, a.node_id AS source_id, b.node_id AS target_id, {COS} AS score FROM u a, u b WHERE a.label = b.label AND a.node_id < b.node_id), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, source_id, target_id) AS rank FROM s WHERE score >= 0.2) SELECT * FROM r WHERE rank <= 5")
def label_top_pairs(read: Read) -> DataFrame:
    v = vectors_of(read)
    found = vector.similar(v, v, None, "node_id", "node_id", min_score=0.2, half=True, left_group="label", right_group="label", same_group=True, best_pairs=5)
    kind = v.schema["label"].dataType
    return found.select(F.col("group").cast(kind).alias("label"), F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id"), "score", "rank")


TOP10 = "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM s WHERE score >= 0)"


@query(f"WITH {UNIT}, s AS (SELECT a.node_id AS query_id, b.node_id, {COS} AS score FROM u a, u b WHERE a.node_id % 20 = 0), {TOP10} SELECT * FROM r WHERE rank <= 10")
def ivf_all_cells(read: Read) -> DataFrame:
    """The inverted file with every cell probed is the exact search."""
    v = vectors_of(read)
    return ivf.VectorIndex.create(v.sparkSession, fresh_dir(v.sparkSession, "index"), v).search(searched(v), 10, probes=None)


_CHANGED = "SELECT node_id, label, CASE WHEN node_id % 5 = 0 THEN list_reverse(e) ELSE e END AS e, n FROM u WHERE node_id % 7 <> 0"


@query(f"WITH {UNIT}, w AS ({_CHANGED}), s AS (SELECT a.node_id AS query_id, b.node_id, {COS} AS score FROM u a, w b WHERE a.node_id % 20 = 0), {TOP10} SELECT r.*, phase FROM r, (VALUES ('deltas'), ('compacted')) p(phase) WHERE rank <= 10")
def ivf_maintained(read: Read) -> DataFrame:
    """A third of the vectors added later, a fifth replaced, a seventh deleted: searched with the deltas merged as they are read, and after they are folded in."""
    v = vectors_of(read)
    index = ivf.VectorIndex.create(v.sparkSession, fresh_dir(v.sparkSession, "index"), v.where("node_id % 3 <> 0"))
    index.upsert(v.where("node_id % 3 = 0"))
    twice = v.where("node_id % 5 = 0").select("node_id", F.explode(F.array(*(F.struct(F.lit(i).alias("turn"), e.alias("embedding")) for i, e in enumerate((F.slice("embedding", 2, 64), F.reverse("embedding")))))).alias("x"))
    index.upsert(twice.select("node_id", "x.*"), order="turn")
    index.delete(v.where("node_id % 7 = 0"))
    before = graph.settled(index.search(searched(v), 10, probes=None).withColumn("phase", F.lit("deltas")))
    index.compact()
    return before.union(index.search(searched(v), 10, probes=None).withColumn("phase", F.lit("compacted")))


# Texts

BM25 = f"tok AS (SELECT doc_id AS node_id, unnest({TOKENS.format('text')}) AS term FROM documents), tf AS (SELECT node_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT node_id, sum(tf) AS dl FROM tf GROUP BY ALL), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, c)"
BM25_TOP = f"{BM25}, q AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark), sc AS (SELECT query_id, node_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (node_id), c GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM sc WHERE score > 0), top AS (SELECT * FROM rk WHERE rank <= 10)"
QRELS = "qrels AS (SELECT item_id AS query_id, doc_id AS node_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
JUDGED = "tot AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY ALL), mk AS (SELECT top.*, CASE WHEN qrels.node_id IS NULL THEN 0 ELSE 1 END AS rel FROM top LEFT JOIN qrels USING (query_id, node_id)), ag AS (SELECT query_id, count(*) AS got, sum(rel) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg FROM mk GROUP BY ALL), ms AS (SELECT query_id, round(coalesce(hits / got, 0), 6) AS precision, round(coalesce(hits, 0) / relevant, 6) AS recall, CAST(coalesce(hits, 0) > 0 AS INT) AS hit, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least(10, relevant) + 1)]), 6) AS ndcg FROM tot LEFT JOIN ag USING (query_id))"


def _index(read: Read) -> bm25.Index:
    return bm25.build(read("documents").withColumnRenamed("doc_id", "node_id"))


def _benchmark(read: Read) -> DataFrame:
    return read("benchmark").withColumnRenamed("item_id", "query_id")


def _qrels(read: Read) -> DataFrame:
    return evaluate.holding(read("documents").withColumnRenamed("doc_id", "node_id"), _benchmark(read))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_terms(read: Read) -> DataFrame:
    return _index(read).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS terms, (SELECT sum(tf)::BIGINT FROM tf) AS tokens FROM c")
def bm25_stats(read: Read) -> DataFrame:
    i = _index(read)
    return i.corpus.select("n", F.round("avgdl", 6).alias("avgdl")).crossJoin(i.terms.agg(F.count("*").alias("terms"))).crossJoin(i.documents.agg(F.sum("dl").alias("tokens")))


@query(f"WITH {BM25_TOP} SELECT * FROM top")
def bm25_topk(read: Read) -> DataFrame:
    return bm25.search(_index(read), _benchmark(read))


@query(f"WITH {BM25_TOP} SELECT * FROM top")
def bm25_stored(read: Read) -> DataFrame:
    """From an index that is written once, with terms pruned by their largest impacts."""
    index = _index(read)
    spark = index.postings.sparkSession
    return bm25.StoredIndex.publish(index, Store(spark, fresh_dir(spark, "bm25"))).search(_benchmark(read))


@query(f"WITH {TURN}, q AS (SELECT p.target_id AS node_id, list_distinct({TOKENS.format('a.text')}) AS q, list_distinct({TOKENS.format('b.text')}) AS t FROM p JOIN t a ON a.node_id = p.source_id JOIN t b ON b.node_id = p.target_id) SELECT node_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, t)) / len(q) END, 6) AS overlap FROM q")
def lexical_overlap(read: Read) -> DataFrame:
    """Of each turn with the one before it."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn", "node_id"))
    rows = turns(read).withColumn("_before", before).where("_before IS NOT NULL")
    return rows.select("node_id", F.round(X.overlap(X.tokens(F.col("_before")), X.tokens(F.col("text"))), 6).alias("overlap"))


@query("SELECT doc_id AS node_id, len(list_filter([regexp_replace(s, '^\\s+|\\s+$', '', 'g') for s in string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))], lambda x: len(x) > 5)) AS n_sentences FROM documents")
def sentence_counts(read: Read) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", X.SENTENCE), X.strip), lambda s: F.length(s) >= X.LEAST_SENTENCE)
    return read("documents").select(F.col("doc_id").alias("node_id"), F.size(parts).alias("n_sentences"))


CHUNKS = "s0 AS (SELECT doc_id, text, list_filter([regexp_replace(s, '^\\s+|\\s+$', '', 'g') for s in string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))], lambda x: len(x) > 5) AS s FROM documents), s1 AS (SELECT doc_id, CASE WHEN len(s) > 0 THEN s ELSE [text] END AS s FROM s0), ch AS (SELECT doc_id, unnest(s) AS text, generate_subscripts(s, 1) - 1 AS i FROM s1)"


@query(f"WITH {CHUNKS} SELECT doc_id || '_' || i AS node_id, text, CAST(doc_id AS VARCHAR) AS parent_id FROM ch")
def sentence_chunks(read: Read) -> DataFrame:
    return ingest.sentence_chunks(read("documents"), "doc_id").drop("is_chunk")


@query(f"WITH {CHUNKS} SELECT CAST(doc_id AS VARCHAR) AS parent_id, max(len({TOKENS.format('text')})) AS best, count(*) AS chunks FROM ch GROUP BY doc_id")
def chunk_rollup(read: Read) -> DataFrame:
    chunks = ingest.sentence_chunks(read("documents"), "doc_id")
    return chunks.groupBy("parent_id").agg(F.max(F.size(X.tokens(F.col("text")))).alias("best"), F.count("*").alias("chunks"))


_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in X.ROUTES) + " ELSE 'default' END"


@query(f"SELECT {_ROUTE} AS kind, count(*) AS n FROM (SELECT text FROM conversations UNION ALL SELECT text FROM benchmark) GROUP BY ALL")
def query_router(read: Read) -> DataFrame:
    rows = read("conversations").select("text").union(read("benchmark").select("text"))
    return rows.groupBy(X.route(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS node_id, CASE WHEN len(text) > 100 THEN text[:100] || '...' ELSE text END AS preview FROM documents")
def text_preview(read: Read) -> DataFrame:
    return read("documents").select(F.col("doc_id").alias("node_id"), X.preview(F.col("text"), 100).alias("preview"))


@query("SELECT conv_id, md5(string_agg('[' || turn || '] ' || role || ': ' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def session_transcripts(read: Read) -> DataFrame:
    t = read("conversations").select("conv_id", "turn", F.col("turn").cast("string").alias("date"), F.col("role").alias("speaker"), "text")
    return ingest.transcript(t, "conv_id").select("conv_id", F.md5("transcript").alias("digest"))


# Filters and reads

_CASES = (
    ("exact", {"k": 7}, "k = 7"), ("gt", {"k": {"$gt": 50}}, "k > 50"), ("between", {"k": {"$gte": 10, "$lt": 20}}, "k >= 10 AND k < 20"), ("lte", {"k": {"$lte": 3}}, "k <= 3"), ("ne", {"k": {"$ne": 7}}, "k <> 7"),
    ("in", {"k": {"$in": [1, 2, 3]}}, "k IN (1, 2, 3)"), ("nin", {"k": {"$nin": [1, 2, 3]}}, "k NOT IN (1, 2, 3)"), ("unknown", {"k": {"$near": 1}}, "k IS NOT NULL"), ("missing", {"z": 1}, "false"), ("text", {"k": "7"}, "false"),
)


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER ({c}) AS n FROM e" for n, _, c in _CASES).join(["WITH e AS (SELECT CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) ", ""]))
def metadata_filter_ops(read: Read) -> DataFrame:
    counts = read("events").agg(*(F.count(F.when(filters.metadata_filter(c, "props"), 1)).alias(n) for n, c, _ in _CASES))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("n")) for n, _, _ in _CASES))).alias("x")).select("x.*")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_per_session(read: Read) -> DataFrame:
    return ingest.latest_in_session(read("events"), "user_id", "ts", "event_id")


@query("SELECT coalesce(source, 'unknown') AS domain, count(*) AS n FROM documents GROUP BY ALL")
def domain_distribution(read: Read) -> DataFrame:
    return read("documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 20")
def pagination(read: Read) -> DataFrame:
    return read("documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(50)


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS sd_pop, round(var_samp(value), 6) AS var_samp FROM events GROUP BY ALL")
def latency_percentiles(read: Read) -> DataFrame:
    return evaluate.latency(read("events"), "value", ("event_type",))


# Graphs


@query(f"WITH {TURN} SELECT source_id, target_id, k.type, k.weight FROM p, (VALUES ('next_turn', 1.0::DOUBLE), ('same_session', 0.5::DOUBLE)) k(type, weight)")
def session_next_turn(read: Read) -> DataFrame:
    return turn_edges(read).select("source_id", "target_id", "type", "weight")


@query(f"WITH {TURN} SELECT type, count(*) AS n FROM p, (VALUES ('next_turn'), ('same_session')) k(type) GROUP BY ALL")
def edge_type_counts(read: Read) -> DataFrame:
    return turn_edges(read).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {TURN} SELECT t.conv_id AS session_id, count(*) AS nodes, 2 * (SELECT count(*) FROM p WHERE p.conv_id = t.conv_id) AS edges FROM t GROUP BY t.conv_id")
def session_stats(read: Read) -> DataFrame:
    t = turns(read)
    nodes = t.groupBy("conv_id").agg(F.count("*").alias("nodes"))
    home = t.select("node_id", "conv_id")
    inside = turn_edges(read).join(home.withColumnsRenamed({"node_id": "source_id", "conv_id": "a"}), "source_id").join(home.withColumnsRenamed({"node_id": "target_id", "conv_id": "b"}), "target_id").where("a = b")
    edges = inside.groupBy(F.col("a").alias("conv_id")).agg(F.count("*").alias("edges"))
    return nodes.join(edges, "conv_id", "left").select(F.col("conv_id").alias("session_id"), "nodes", F.coalesce("edges", F.lit(0)).alias("edges"))


@query(f"WITH {TURN} SELECT (SELECT count(*) FROM t) AS nodes, 2 * count(*) AS edges, round(2 * count(*) / (SELECT count(*) FROM t), 2) AS avg_edges_per_node FROM p")
def graph_stats(read: Read) -> DataFrame:
    n, e = turns(read).agg(F.count("*").alias("nodes")), turn_edges(read).agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select("nodes", "edges", F.coalesce(F.round(F.try_divide("edges", "nodes"), 2), F.lit(0.0)).alias("avg_edges_per_node"))


@query("WITH e AS (SELECT 'o' || o_orderkey AS s, 'c' || o_custkey AS t FROM orders), d AS (SELECT s AS node_id, 0 AS i, 1 AS o FROM e UNION ALL SELECT t, 1, 0 FROM e) SELECT node_id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS degree FROM d GROUP BY ALL ORDER BY degree DESC, node_id LIMIT 10")
def degree_topk(read: Read) -> DataFrame:
    e = read("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), F.concat(F.lit("c"), "o_custkey").alias("target_id"))
    return graph.degrees(e).orderBy(F.desc("degree"), "node_id").limit(10)


_START = "st AS (SELECT node_id FROM t WHERE node_id % 20 = 0)"


def _starts(read: Read) -> DataFrame:
    return searched(turns(read)).select("query_id", "node_id")


@query(f"WITH {TURN}, {_START} SELECT node_id, target_id AS neighbour_id, 'outgoing' AS direction, 'next_turn' AS type FROM st JOIN p ON source_id = node_id UNION ALL SELECT node_id, source_id, 'incoming', 'next_turn' FROM st JOIN p ON target_id = node_id")
def neighbors(read: Read) -> DataFrame:
    return graph.neighbours(turn_edges(read), _starts(read)).select("node_id", "neighbour_id", "direction", "type")


def _bfs_sql(steps: str, depth: int) -> str:
    return f"WITH RECURSIVE {TURN}, {_START}, g AS ({steps}), r AS (SELECT node_id AS query_id, node_id, 0 AS depth FROM st UNION SELECT query_id, dst, depth + 1 FROM r JOIN g ON src = node_id WHERE depth < {depth}) SELECT query_id, node_id, min(depth) AS depth FROM r GROUP BY ALL HAVING min(depth) > 0"


_OUT, _IN = "SELECT source_id AS src, target_id AS dst FROM p", "SELECT target_id AS src, source_id AS dst FROM p"


@query(_bfs_sql(_OUT, 2))
def bfs_out(read: Read) -> DataFrame:
    return graph.bfs(turn_edges(read), _starts(read), 2, "outgoing").drop("path")


@query(_bfs_sql(_IN, 2))
def bfs_in(read: Read) -> DataFrame:
    return graph.bfs(turn_edges(read), _starts(read), 2, "incoming").drop("path")


@query(_bfs_sql(f"{_OUT} UNION ALL {_IN}", 2))
def bfs_both(read: Read) -> DataFrame:
    return graph.bfs(turn_edges(read), _starts(read), 2).drop("path")


@query(_bfs_sql(f"{_OUT} UNION ALL {_IN}", 3))
def bfs_typed(read: Read) -> DataFrame:
    return graph.bfs(turn_edges(read), _starts(read), 3, types=["next_turn"]).drop("path")


@query(f"WITH {TURN}, {_START} SELECT st.node_id AS query_id, count(*) AS size FROM st JOIN t ON t.conv_id = st.node_id // 1000 GROUP BY ALL")
def component_sizes(read: Read) -> DataFrame:
    return graph.component(turn_edges(read), _starts(read)).groupBy("query_id").agg(F.count("*").alias("size"))


@query(f"WITH {TURN} SELECT conv_id AS query_id, node_id, CASE WHEN turn <= 3 THEN round(1 / (1 + turn), 4) ELSE 0 END AS proximity FROM t")
def proximity(read: Read) -> DataFrame:
    """Of every turn to the first of its conversation."""
    t = turns(read).withColumn("query_id", F.col("conv_id"))
    return graph.proximity(turn_edges(read), t, t.where("turn = 0").select("query_id", "node_id"))


def _ends(read: Read) -> DataFrame:
    return turns(read).groupBy(F.col("conv_id").alias("query_id")).agg(F.min("node_id").alias("source_id"), F.max("node_id").alias("target_id"))


@query(f"WITH {TURN} SELECT conv_id AS query_id, list(node_id ORDER BY turn)::VARCHAR AS path, CAST(count(*) - 1 AS INT) AS length, CAST(count(*) - 1 AS DOUBLE) AS cost FROM t GROUP BY ALL")
def shortest_path_hops(read: Read) -> DataFrame:
    found = graph.shortest_paths(graph.graph_edges(turn_edges(read)), _ends(read), weighted=False)
    return found.select("query_id", F.concat(F.lit("["), F.array_join(F.col("path").cast("array<string>"), ", "), F.lit("]")).alias("path"), "length", "cost")


@query(f"WITH {TURN} SELECT conv_id AS query_id, CAST(count(*) - 1 AS INT) AS length, 2.0 * (count(*) - 1) AS cost, 0.5 * (count(*) - 1) AS total_weight FROM t GROUP BY ALL".replace("2.0 *", "2.0::DOUBLE *").replace("0.5 *", "0.5::DOUBLE *"))
def shortest_path_weighted(read: Read) -> DataFrame:
    """Of two edges between turns the one with the greater id stays: same_session, with half the weight."""
    return graph.shortest_paths(graph.graph_edges(turn_edges(read)), _ends(read)).drop("path")


@query(f"WITH {TURN}, g AS (SELECT node_id FROM t WHERE turn = 0) SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM g) AS nodes_left, 2 * count(*) AS edges_left FROM p WHERE source_id NOT IN (SELECT node_id FROM g) AND target_id NOT IN (SELECT node_id FROM g)")
def soft_delete_cascade(read: Read) -> DataFrame:
    t = turns(read).select("node_id", "turn", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    nodes, edges = ingest.soft_delete(t, turn_edges(read), t.where("turn = 0"))
    return ingest.active(nodes).agg(F.count("*").alias("nodes_left")).crossJoin(edges.agg(F.count("*").alias("edges_left")))


@query(f"WITH {TURN} SELECT node_id + 1 AS node_id FROM t WHERE node_id + 1 NOT IN (SELECT node_id FROM t)")
def missing_nodes_anti(read: Read) -> DataFrame:
    t = turns(read)
    return ingest.missing_ends(t.select(F.col("node_id").alias("source_id"), (F.col("node_id") + 1).alias("target_id")), t)


_THRESHOLDS = (0.45, 0.4, 0.35, 0.3)


@query(f"""WITH RECURSIVE {UNIT}, e AS (SELECT a.node_id AS s, b.node_id AS t, {COS} AS w FROM u a, u b WHERE a.node_id < b.node_id AND {COS} >= 0.3), th AS (SELECT unnest({list(_THRESHOLDS)})::DOUBLE AS threshold),
g AS (SELECT threshold, s, t FROM e, th WHERE w >= threshold UNION ALL SELECT threshold, t, s FROM e, th WHERE w >= threshold), r AS (SELECT threshold, node_id AS a, node_id AS b FROM u, th UNION SELECT r.threshold, r.a, g.t FROM r JOIN g ON g.threshold = r.threshold AND g.s = r.b),
c AS (SELECT threshold, a, min(b) AS c FROM r GROUP BY ALL), z AS (SELECT threshold, c, count(*) AS n FROM c GROUP BY ALL)
SELECT threshold, (SELECT count(*) FROM e WHERE w >= z.threshold) AS edges, count(*) AS components, max(n) AS largest FROM z GROUP BY threshold""")
def threshold_sweep(read: Read) -> DataFrame:
    """The graph of similar vectors at several thresholds, from one spanning forest."""
    return forest.similarity_sweep(vectors_of(read), _THRESHOLDS)


# Changes


def _conflicting(read: Read) -> DataFrame:
    """Changes to every second document, and to some that don't exist, in three turns."""
    d = read("documents").select("doc_id").where("doc_id % 2 = 0")
    none = lambda kind: F.lit(None).cast(kind)
    turn = lambda rows, at, source, n, op=None: rows.select("doc_id", F.lit(at).alias("turn"), source.alias("source"), n.alias("n_chars"), F.lit(op).cast("string").alias("op"))
    parts = [
        turn(d.where("doc_id % 4 = 0"), 3, F.lit("third"), none("long")), turn(d, 1, F.lit("first"), F.col("doc_id") * 10), turn(d.where("doc_id % 6 = 0"), 2, F.lit("second"), F.lit(-1).cast("long")),
        turn(d.where("doc_id % 10 = 0"), 1, none("string"), none("long"), "delete"), turn(d.where("doc_id % 50 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000_000), 1, F.lit("lost"), none("long")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT doc_id, lang, CASE WHEN doc_id % 2 = 1 THEN source WHEN doc_id % 4 = 0 THEN 'third' WHEN doc_id % 6 = 0 THEN 'second' ELSE 'first' END AS source, CASE WHEN doc_id % 2 = 1 THEN n_chars WHEN doc_id % 6 = 0 THEN -1 ELSE doc_id * 10 END AS n_chars, md5(text) AS text FROM documents WHERE doc_id % 10 <> 0")
def merge_conflicting(read: Read) -> DataFrame:
    """Half of the documents merged with conflicting changes, the last of each column counting."""
    return changes.merge(read("documents"), _conflicting(read), "doc_id", "turn").table.withColumn("text", F.md5("text"))


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'deleted' ELSE 'updated' END AS change FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'missing' FROM documents WHERE doc_id % 50 = 0) GROUP BY ALL")
def merge_changes(read: Read) -> DataFrame:
    return changes.merge(read("documents"), _conflicting(read), "doc_id", "turn").changes.groupBy("change").agg(F.count("*").alias("n"))


def _import_inputs(read: Read) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as batches: every third one's first turn exists, turns that 5 divides repeat an id, and edges go from turn to turn and past the last."""
    t = turns(read)
    nodes = t.select(F.col("conv_id").alias("batch"), F.col("turn").alias("index"), F.when(F.col("turn") % 5 == 4, F.col("node_id") - 1).otherwise(F.col("node_id")).cast("string").alias("node_id"), F.when(F.col("turn") == 6, "").otherwise(F.col("text")).alias("text"))
    kind = F.when(F.col("turn") % 7 == 5, "unheard_of").when(F.col("turn") % 2 == 0, "related_to").otherwise("led_to")
    edges = t.select(F.col("conv_id").alias("batch"), F.col("turn").alias("index"), F.col("turn").alias("source"), (F.col("turn") + 1).alias("target"), kind.alias("type"), F.when(F.col("conv_id") % 11 == 0, 1.5).when(F.col("turn") % 2 == 0, 0.5).alias("weight"))
    return t.where("conv_id % 3 = 0 AND turn = 0").select(F.col("node_id").cast("string").alias("node_id")), nodes, edges


_IMPORT = """WITH t AS (SELECT conv_id AS b, turn AS i, text FROM conversations), n AS (SELECT b, i, CASE WHEN b % 3 = 0 AND i = 0 THEN 'exists' WHEN i % 5 = 4 THEN 'repeated' WHEN i = 6 OR length(text) NOT BETWEEN 1 AND 50000 THEN 'text' END AS reason FROM t),
e AS (SELECT t.b, t.i, CASE WHEN s.reason IS NOT NULL THEN 'no source' WHEN x.i IS NULL OR x.reason IS NOT NULL THEN 'no target' WHEN t.b % 11 = 0 THEN 'weight' WHEN t.i % 7 = 5 THEN 'type' END AS reason FROM t JOIN n s ON s.b = t.b AND s.i = t.i LEFT JOIN n x ON x.b = t.b AND x.i = t.i + 1),
r AS (SELECT 'node' AS kind, * FROM n UNION ALL SELECT 'edge', * FROM e)"""


@query(f"{_IMPORT} SELECT b AS batch, kind, i AS index, coalesce(reason, 'accepted') AS outcome FROM r")
def import_outcomes(read: Read) -> DataFrame:
    """What becomes of each node and edge of a batch that refers to its nodes by index."""
    done = changes.import_batches(*_import_inputs(read))
    accepted = [df.select("batch", F.lit(kind).alias("kind"), F.col("index").cast("long").alias("index"), F.lit("accepted").alias("outcome")) for df, kind in ((done.nodes, "node"), (done.edges, "edge"))]
    return done.rejects.withColumnRenamed("reason", "outcome").union(accepted[0]).union(accepted[1])


@query(f"{_IMPORT}, bad AS (SELECT DISTINCT b FROM r WHERE reason IS NOT NULL) SELECT kind, CASE WHEN reason IS NOT NULL THEN reason WHEN b IN (SELECT b FROM bad) THEN 'batch' ELSE 'accepted' END AS outcome, count(*) AS n FROM r GROUP BY ALL")
def import_all_or_nothing(read: Read) -> DataFrame:
    done = changes.import_batches(*_import_inputs(read), whole=True)
    accepted = [df.select(F.lit(kind).alias("kind"), F.lit("accepted").alias("outcome")) for df, kind in ((done.nodes, "node"), (done.edges, "edge"))]
    return done.rejects.select("kind", F.col("reason").alias("outcome")).union(accepted[0]).union(accepted[1]).groupBy("kind", "outcome").agg(F.count("*").alias("n"))


# Evaluation


@query(f"WITH {BM25_TOP}, {QRELS}, {JUDGED} SELECT * FROM ms")
def retrieval_metrics(read: Read) -> DataFrame:
    return evaluate.metrics(bm25.search(_index(read), _benchmark(read)), _qrels(read))


@query(f"WITH {BM25_TOP}, {QRELS}, {JUDGED} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS queries FROM ms")
def retrieval_summary(read: Read) -> DataFrame:
    return evaluate.summary(evaluate.metrics(bm25.search(_index(read), _benchmark(read)), _qrels(read)))


# Hybrid


def _similar_edges(read: Read) -> DataFrame:
    v = vectors_of(read)
    found = vector.similar(v, v, 3, "node_id", "node_id", exclude_self=True)
    return found.select(F.col("source_node_id").alias("source_id"), F.col("target_node_id").alias("target_id"), F.lit("analogous_to").alias("type"), F.col("score").alias("weight"), F.concat_ws("-", "source_node_id", "target_node_id").alias("edge_id"))


def _hybrid_inputs(read: Read) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes are written once, since a search reads them many times and each join of theirs would shuffle all texts."""
    nodes = graph.settled(documents_with_vectors(read))
    return nodes, graph.settled(_similar_edges(read)), searched(nodes).select("query_id", "text", "embedding")


_KNN = f"{UNIT}, s AS (SELECT a.node_id AS src, b.node_id AS dst, {COS} AS score FROM u a, u b), e AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS i FROM s WHERE src <> dst) WHERE i <= 3)"
_HYBRID = f"""WITH RECURSIVE {_KNN}, nd AS (SELECT doc_id AS node_id, text, {TOKENS.format('text')} AS tk FROM documents WHERE doc_id IN (SELECT node_id FROM u)),
qs AS (SELECT node_id AS query_id, tk FROM nd WHERE node_id % 20 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS i FROM (SELECT src AS query_id, dst AS node_id, score FROM s WHERE src IN (SELECT query_id FROM qs) AND dst IN (SELECT node_id FROM nd) AND score >= 0)),
tok AS (SELECT node_id, unnest(tk) AS term FROM nd), tf AS (SELECT node_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT node_id, sum(tf) AS dl FROM tf GROUP BY ALL), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), c),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tk) AS term FROM qs) GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS i FROM (SELECT query_id, node_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (node_id), c GROUP BY ALL) WHERE score > 0),
m AS (SELECT query_id, node_id, max(cs) AS cs FROM (SELECT query_id, node_id, score AS cs FROM vr WHERE i <= 100 UNION ALL SELECT query_id, node_id, NULL FROM br WHERE i <= 100) GROUP BY ALL),
o AS (SELECT m.*, CASE WHEN len(qs.tk) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qs.tk), list_distinct(nd.tk))) / len(list_distinct(qs.tk)) END AS ov FROM m JOIN qs USING (query_id) JOIN nd USING (node_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, node_id) AS i FROM (SELECT query_id, node_id, round(least(1.0, coalesce(cs, least(0.65, ov)) + 0.25 * ov), 6) AS v FROM o)),
cand AS (SELECT query_id, node_id, v FROM k WHERE i <= 100), ref AS (SELECT query_id, node_id FROM k WHERE i <= 3),
bo AS (SELECT query_id, node_id, 0 AS d FROM ref UNION SELECT query_id, dst, d + 1 FROM bo JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) g ON g.src = bo.node_id WHERE d < 2),
fo AS (SELECT query_id, node_id, 0 AS d FROM ref UNION SELECT query_id, dst, d + 1 FROM fo JOIN e ON e.src = fo.node_id WHERE d < 2),
ba AS (SELECT query_id, node_id, 0 AS d FROM ref UNION SELECT query_id, src, d + 1 FROM ba JOIN e ON e.dst = ba.node_id WHERE d < 2),
px AS (SELECT query_id, node_id, round(1 / (1 + min(d)), 4) AS g FROM (SELECT * FROM fo UNION ALL SELECT * FROM ba) GROUP BY ALL),
f AS (SELECT query_id, node_id, max(v) AS v FROM (SELECT * FROM cand UNION ALL SELECT DISTINCT query_id, node_id, 0.0 FROM bo WHERE node_id IN (SELECT node_id FROM nd)) GROUP BY ALL),
h AS (SELECT f.query_id, f.node_id, v, coalesce(g, 0) AS g, round(0.6 * v + 0.4 * coalesce(g, 0), 6) AS c, regexp_replace(nd.text, '^\\s+|\\s+$', '', 'g') AS t FROM f JOIN nd USING (node_id) LEFT JOIN px ON px.query_id = f.query_id AND px.node_id = f.node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, node_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY c DESC, node_id) AS j FROM h) WHERE j = 1)
SELECT query_id, node_id, round(v, 4) AS vector_score, round(g, 4) AS graph_score, round(c, 4) AS combined_score, rank FROM r WHERE rank <= 10"""


# Graphs with branches, ties and pairs that aren't connected: each vector with its three nearest ones, and orders with their customers


def _near_graph(read: Read) -> DataFrame:
    return graph.settled(_similar_edges(read))


def _near_starts(read: Read) -> DataFrame:
    return searched(vectors_of(read)).select("query_id", "node_id")


_KNN_W = f"{UNIT}, e AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS i FROM (SELECT a.node_id AS src, b.node_id AS dst, {COS} AS w FROM u a, u b WHERE a.node_id <> b.node_id)) WHERE i <= 3)"
_WAYS = {"outgoing": "SELECT src, dst FROM e", "incoming": "SELECT dst AS src, src AS dst FROM e", "both": "SELECT src, dst FROM e UNION SELECT dst, src FROM e"}


def _reach(way: str, starts: str, depth: int) -> str:
    return f"SELECT node_id AS query_id, node_id, 0 AS depth FROM u WHERE {starts} UNION SELECT query_id, dst, depth + 1 FROM r_{way} JOIN ({_WAYS[way]}) g ON g.src = r_{way}.node_id WHERE depth < {depth}"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH RECURSIVE {_KNN_W}, r_{w} AS ({_reach(w, 'node_id % 20 = 0', 3)}) SELECT '{w}' AS way, query_id, node_id, min(depth) AS depth FROM r_{w} GROUP BY query_id, node_id HAVING min(depth) > 0)" for w in _WAYS))
def bfs_similar(read: Read) -> DataFrame:
    e, starts = _near_graph(read), _near_starts(read)
    found = [graph.bfs(e, starts, 3, w).select(F.lit(w).alias("way"), "query_id", "node_id", "depth") for w in _WAYS]
    return found[0].union(found[1]).union(found[2])


@query(f"WITH RECURSIVE {_KNN_W}, r_outgoing AS ({_reach('outgoing', 'node_id % 50 = 0', 3)}), r_incoming AS ({_reach('incoming', 'node_id % 50 = 0', 3)}), d AS (SELECT query_id, node_id, min(depth) AS d FROM (SELECT * FROM r_outgoing UNION ALL SELECT * FROM r_incoming) GROUP BY ALL) SELECT q.node_id AS query_id, u.node_id, coalesce(round(1 / (1 + d), 4), 0.0) AS proximity FROM u q CROSS JOIN u LEFT JOIN d ON d.query_id = q.node_id AND d.node_id = u.node_id WHERE q.node_id % 50 = 0")
def proximity_similar(read: Read) -> DataFrame:
    """Of every vector to each fiftieth one."""
    anchors = vectors_of(read).where("node_id % 50 = 0").select(F.col("node_id").alias("query_id"), "node_id")
    return graph.proximity_of_all(_near_graph(read), vectors_of(read), anchors)


@query(f"WITH {_KNN_W}, st AS (SELECT node_id FROM u WHERE node_id % 20 = 0), x AS (SELECT node_id, dst AS neighbour_id, 'outgoing' AS direction, w AS weight FROM st JOIN e ON src = node_id UNION ALL SELECT node_id, src, 'incoming', w FROM st JOIN e ON dst = node_id) SELECT node_id, neighbour_id, max(direction) AS direction, max(weight) AS weight FROM x GROUP BY ALL")
def neighbors_similar(read: Read) -> DataFrame:
    """Both ways; of two edges between a pair the outgoing one counts, and they weigh the same."""
    return graph.neighbours(_near_graph(read), _near_starts(read)).select("node_id", "neighbour_id", "direction", "weight")


_ROUNDS = 24


def _paths_sql(step: str) -> str:
    """Relaxations by so many hops, each state with its path."""
    state = "row(round(cost + {0}, 9), hops + 1, list_append(path, dst), round(total + w, 9))".format(step)
    first = "s0 AS (SELECT node_id AS q, node_id AS n, row(0.0::DOUBLE, 0, [node_id], 0.0::DOUBLE) AS b FROM u WHERE node_id % 20 = 0)"
    rounds = ", ".join(f"s{i + 1} AS (SELECT q, n, min(b) AS b FROM (SELECT * FROM s{i} UNION ALL SELECT q, dst, {state} FROM (SELECT q, n, b[1] AS cost, b[2] AS hops, b[3] AS path, b[4] AS total FROM s{i}) z JOIN e ON e.src = z.n WHERE NOT list_contains(path, dst)) GROUP BY q, n)" for i in range(_ROUNDS))
    return f"WITH {_KNN_W}, {first}, {rounds} SELECT q AS query_id, array_to_string(b[3], ' ') AS path, b[2] AS length, round(b[1], 4) AS cost, round(b[4], 4) AS total_weight FROM s{_ROUNDS} WHERE n = (q * 7 + 3) % (SELECT count(*) FROM u)"


def _pairs(read: Read) -> DataFrame:
    n = vectors_of(read).count()
    return _near_starts(read).select("query_id", F.col("node_id").alias("source_id"), ((F.col("node_id") * 7 + 3) % n).alias("target_id"))


@query(_paths_sql("1.0"))
def shortest_path_hops_similar(read: Read) -> DataFrame:
    return graph.shortest_paths(_near_graph(read), _pairs(read), weighted=False).withColumn("path", F.array_join(F.col("path").cast("array<string>"), " "))


@query(_paths_sql("round(1 / greatest(w, 0.01), 9)"))
def shortest_path_weighted_similar(read: Read) -> DataFrame:
    return graph.shortest_paths(_near_graph(read), _pairs(read)).withColumn("path", F.array_join(F.col("path").cast("array<string>"), " "))


def _order_graph(read: Read) -> DataFrame:
    e = read("orders").select(F.concat(F.lit("o"), "o_orderkey").alias("source_id"), F.concat(F.lit("c"), "o_custkey").alias("target_id"), F.lit("led_to").alias("type"), F.lit(1.0).alias("weight"))
    return e.withColumn("edge_id", F.col("source_id"))


def _some_orders(read: Read) -> DataFrame:
    return read("orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("o"), "o_orderkey").alias("node_id"))


@query("SELECT a.o_orderkey AS query_id, 'o' || b.o_orderkey AS node_id, 2 AS depth FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey WHERE a.o_orderkey % 20 = 0 UNION ALL SELECT o_orderkey, 'c' || o_custkey, 1 FROM orders WHERE o_orderkey % 20 = 0")
def bfs_orders(read: Read) -> DataFrame:
    """From orders to their customers and on to those customers' other orders."""
    return graph.bfs(_order_graph(read), _some_orders(read), 2).drop("path")


@query("SELECT a.o_orderkey AS query_id, least(100, 1 + count(*)) AS size FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey WHERE a.o_orderkey % 20 = 0 GROUP BY ALL")
def component_orders(read: Read) -> DataFrame:
    return graph.component(_order_graph(read), _some_orders(read)).groupBy("query_id").agg(F.count("*").alias("size"))


@query("SELECT 'c' || c_custkey AS node_id, c_name AS text, 'o' || o_orderkey AS neighbour_id, CASE WHEN o_orderkey IS NOT NULL THEN 'incoming' END AS direction FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 20 = 0")
def nodes_with_edges(read: Read) -> DataFrame:
    """Every twentieth customer with the edges at it, and those without any."""
    nodes = read("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.col("c_name").alias("text"), "c_custkey")
    return ingest.with_edges(nodes, _order_graph(read), nodes.where("c_custkey % 20 = 0")).select("node_id", "text", "neighbour_id", "direction")


@query("SELECT 'o' || o_orderkey AS edge_id, 'c' || o_custkey AS target_id FROM orders WHERE o_custkey = 7 OR o_orderkey % 20 = 0")
def edges_found(read: Read) -> DataFrame:
    """Edges by their ids, and those that meet predicates."""
    e, ids = _order_graph(read), read("orders").where("o_orderkey % 20 = 0").select(F.concat(F.lit("o"), "o_orderkey").alias("edge_id"))
    listed = ingest.list_edges(e, target_id="c7", type="led_to", limit=1000)
    return ingest.by_id(e, ids, "edge_id").union(listed).select("edge_id", "target_id").distinct()


@query(_HYBRID)
def hybrid_search(read: Read) -> DataFrame:
    return hybrid.hybrid_search(*_hybrid_inputs(read), parent=None)


# Conditions of the ranking: their candidates are searched for once


def _conditions_sql(table, anchored: bool = False, where: str = "true", chunk: bool = False, top_k: int = 10, min_score: float = 0.0) -> str:
    """CTEs up to res(condition, query_id, node_id, v, g, c, rank) for hybrid.search_conditions; with chunk, odd nodes are chunks of the even ones before them."""
    base = _HYBRID[: _HYBRID.index("k AS (SELECT *, row_number()")].replace("NULL FROM br", "NULL, true FROM br").replace("score AS cs FROM vr", "score AS cs, false AS lex FROM vr").replace("max(cs) AS cs FROM (SELECT query_id, node_id, score", "max(cs) AS cs, bool_or(lex) AS lex FROM (SELECT query_id, node_id, score")
    if where != "true":
        base = base.replace("dst IN (SELECT node_id FROM nd)", f"dst IN (SELECT node_id FROM nd WHERE {where})").replace("WHERE score > 0)", f"WHERE score > 0 AND node_id IN (SELECT node_id FROM nd WHERE {where}))").replace("{TOKENS}", "")
        base = base.replace("SELECT doc_id AS node_id, text,", "SELECT doc_id AS node_id, text, lang,")
    up = "CASE WHEN node_id % 2 = 1 THEN node_id - 1 ELSE node_id END" if chunk else "node_id"
    out = []
    for i, c in enumerate(table):
        cs = "cs" if c.vector else "NULL"
        score = f"coalesce({cs}, {'least(0.65, ov)' if c.boost else '0.0'}) + {c.boost} * ov"
        own = f"SELECT node_id AS query_id, node_id FROM nd WHERE node_id % 20 = 0" if anchored and c.expand else f"SELECT query_id, node_id FROM k{i} WHERE i <= 3"
        both = f"SELECT DISTINCT query_id, node_id, 0.0 FROM bo{i} WHERE node_id IN (SELECT node_id FROM nd WHERE {where})" if c.expand else "SELECT query_id, node_id, 0.0 FROM nd, qs WHERE false"
        out.append(f"""p{i} AS (SELECT query_id, {up} AS node_id, max({score}) AS v FROM o {'' if c.vector else 'WHERE lex'} GROUP BY ALL),
k{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, node_id) AS i FROM (SELECT query_id, node_id, round(least(1.0, v), 6) AS v FROM p{i} WHERE node_id IN (SELECT node_id FROM nd))),
ref{i} AS ({own}),
bo{i} AS (SELECT query_id, node_id, 0 AS d FROM ref{i} UNION SELECT query_id, dst, d + 1 FROM bo{i} b JOIN (SELECT src, dst FROM e UNION SELECT dst, src FROM e) g ON g.src = b.node_id WHERE d < 2),
fo{i} AS (SELECT query_id, node_id, 0 AS d FROM ref{i} UNION SELECT query_id, dst, d + 1 FROM fo{i} b JOIN e ON e.src = b.node_id WHERE d < 2),
ba{i} AS (SELECT query_id, node_id, 0 AS d FROM ref{i} UNION SELECT query_id, src, d + 1 FROM ba{i} b JOIN e ON e.dst = b.node_id WHERE d < 2),
px{i} AS (SELECT query_id, node_id, round(1 / (1 + min(d)), 4) AS g FROM (SELECT * FROM fo{i} UNION ALL SELECT * FROM ba{i}) GROUP BY ALL),
f{i} AS (SELECT query_id, node_id, max(v) AS v FROM (SELECT query_id, node_id, v FROM k{i} WHERE i <= {hybrid.pool(top_k, where != "true")[1]} UNION ALL {both}) GROUP BY ALL),
h{i} AS (SELECT f.query_id, f.node_id, v, coalesce(g, 0) AS g, round({c.alpha}::DOUBLE * v + {c.beta}::DOUBLE * coalesce(g, 0), 6) AS c, regexp_replace(nd.text, '^\\s+|\\s+$', '', 'g') AS t FROM f{i} f JOIN nd USING (node_id) LEFT JOIN px{i} x ON x.query_id = f.query_id AND x.node_id = f.node_id),
r{i} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, node_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, t ORDER BY c DESC, node_id) AS j FROM h{i}) WHERE j = 1 AND c >= {min_score})""")
    union = " UNION ALL ".join(f"SELECT '{c.name}' AS condition, query_id, node_id, v, g, c, rank FROM r{i} WHERE rank <= {top_k}" for i, c in enumerate(table))
    return f"{base}{', '.join(out)}, res AS ({union})"


_SCORES = "query_id, node_id, round(v + 1e-9, 4) AS vector_score, round(g, 4) AS graph_score, round(c + 1e-9, 4) AS combined_score, rank"
_LABELLED = "lab AS (SELECT node_id, label FROM u WHERE node_id IN (SELECT node_id FROM nd)), qrels AS (SELECT a.node_id AS query_id, b.node_id FROM lab a JOIN lab b USING (label) WHERE a.node_id % 20 = 0)"


def _judged_sql(source: str, keys: str, k: int, bottom: str = "got") -> str:
    """CTEs up to ms(keys, query_id, precision, recall, hit, mrr, ndcg) of source(keys, query_id, node_id, rank) against qrels."""
    return f"""tot AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY ALL), sy AS (SELECT DISTINCT {keys} FROM {source}),
mk AS (SELECT x.*, CASE WHEN q.node_id IS NULL THEN 0 ELSE 1 END AS rel FROM {source} x LEFT JOIN qrels q ON q.query_id = x.query_id AND q.node_id = x.node_id),
ag AS (SELECT {keys}, query_id, count(*) FILTER (rank <= {k}) AS got, coalesce(sum(rel) FILTER (rank <= {k}), 0) AS hits, min(CASE WHEN rel = 1 THEN rank END) AS first, coalesce(sum(rel / log2(rank + 1)) FILTER (rank <= {k}), 0) AS dcg FROM mk GROUP BY ALL),
ms AS (SELECT {keys}, query_id, round(coalesce(hits / nullif({bottom}, 0), 0), 6) AS precision, round(coalesce(hits, 0) / relevant, 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum([1 / log2(i + 1) for i in range(1, least({k}, relevant) + 1)]), 6) AS ndcg FROM tot CROSS JOIN sy LEFT JOIN ag USING ({keys}, query_id))"""


_MEANS = "round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"


def _label_qrels(nodes: DataFrame, queries: DataFrame) -> evaluate.Relevance:
    """Relevant are the rows with the query's label."""
    labels = nodes.select("node_id", "label")
    return evaluate.by_label(labels, labels.withColumnRenamed("node_id", "query_id").join(queries.select("query_id"), "query_id", "left_semi"))


@query(f"{_conditions_sql(hybrid.ABLATION)}, {_LABELLED}, {_judged_sql('res', 'condition', 10)} SELECT condition, {_MEANS}, count(*) AS queries FROM ms GROUP BY ALL")
def ablation_conditions(read: Read) -> DataFrame:
    """The conditions of the ablation by their measures, against rows with the query's label."""
    nodes, edges, queries = _hybrid_inputs(read)
    ranked = graph.settled(hybrid.search_conditions(nodes, edges, queries, parent=None))
    return evaluate.summary(evaluate.metrics(ranked, _label_qrels(nodes, queries), by=("condition",)), ("condition",))


@query(f"{_conditions_sql([hybrid.Condition()], anchored=True, where='lang = ' + chr(39) + 'en' + chr(39), chunk=True, top_k=5, min_score=0.3)} SELECT {_SCORES} FROM res")
def hybrid_anchored(read: Read) -> DataFrame:
    """With anchors, a filter, chunks that are rolled up, and a least score."""
    nodes, edges, queries = _hybrid_inputs(read)
    nodes = nodes.withColumns({"metadata": F.to_json(F.struct("lang")), "parent_id": F.when(F.col("node_id") % 2 == 1, F.col("node_id") - 1)})
    own = queries.select("query_id", F.col("query_id").alias("node_id"))
    return hybrid.hybrid_search(nodes, edges, queries, 5, anchors=own, min_score=0.3, where=filters.metadata_filter({"lang": "en"}))


_MODES = f"""{_conditions_sql([hybrid.Condition()], anchored=True)},
vm AS (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM (SELECT s.src AS query_id, s.dst AS node_id, s.score, row_number() OVER (PARTITION BY s.src, regexp_replace(nd.text, '^\\s+|\\s+$', '', 'g') ORDER BY s.score DESC, s.dst) AS j FROM s JOIN nd ON nd.node_id = s.dst WHERE s.src IN (SELECT query_id FROM qs) AND s.score >= 0) WHERE j = 1),
gm AS (SELECT query_id, node_id, round(1 / (1 + d), 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY d, node_id) AS rank FROM (SELECT query_id, node_id, min(d) AS d FROM bo0 GROUP BY ALL) WHERE d > 0 AND node_id IN (SELECT node_id FROM nd)),
md AS (SELECT 'vector' AS mode, query_id, node_id, score, rank FROM vm WHERE rank <= 10 UNION ALL SELECT 'graph', query_id, node_id, score, rank FROM gm WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, node_id, round(c, 4), rank FROM res)"""


def _modes(read: Read) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges, queries = _hybrid_inputs(read)
    return nodes, queries, graph.settled(hybrid.compare_modes(nodes, edges, queries, queries.select("query_id", F.col("query_id").alias("node_id")), parent=None))


@query(f"{_MODES}, hd AS (SELECT query_id, node_id, bool_or(mode = 'vector') AS v, bool_or(mode = 'graph') AS g, bool_or(mode = 'hybrid') AS h FROM md GROUP BY ALL) SELECT query_id, count(*) FILTER (v AND NOT h) AS vector_only, count(*) FILTER (g AND NOT h) AS graph_only, count(*) FILTER (h AND NOT v AND NOT g) AS hybrid_unique, count(*) FILTER (v AND g AND h) AS all_three, count(*) FILTER (h AND (v OR g)) AS hybrid_shared FROM hd GROUP BY ALL")
def compare_modes_overlap(read: Read) -> DataFrame:
    return hybrid.mode_overlap(_modes(read)[2])


_POOLED = "qrels AS (SELECT query_id, node_id FROM md GROUP BY ALL HAVING count(DISTINCT mode) >= 2 OR max(score) >= 0.3)"


@query(f"{_MODES}, {_POOLED}, {_judged_sql('md', 'mode', 10, '10')}, av AS (SELECT mode, {_MEANS} FROM ms GROUP BY ALL) SELECT *, round((ndcg - (SELECT ndcg FROM av WHERE mode = 'vector')) / greatest((SELECT ndcg FROM av WHERE mode = 'vector'), 0.001) * 100, 4) AS ndcg_gain, (SELECT arg_max(mode, ndcg + precision) FROM av) AS winner FROM av")
def compare_systems(read: Read) -> DataFrame:
    return evaluate.compare_systems(_modes(read)[2])


@query(f"""{_MODES}, {_LABELLED}, {_judged_sql('md', 'mode', 10, '10')}, fd AS (SELECT mode, query_id, count(*) AS finds FROM md JOIN qrels USING (query_id, node_id) GROUP BY ALL), sc AS (SELECT mode, query_id, avg(score) AS a, var_pop(score) AS w FROM md GROUP BY ALL)
SELECT mode, {_MEANS.replace(', 6)', ', 4)')}, round(avg(coalesce(finds, 0) / relevant), 4) AS coverage, round(avg(coalesce(finds, 0)), 4) AS relevant_finds, round(avg(coalesce(a, 0)), 4) AS avg_score, round(avg(coalesce(w, 0)), 4) AS score_variance, count(*) AS queries FROM ms JOIN tot USING (query_id) LEFT JOIN fd USING (mode, query_id) LEFT JOIN sc USING (mode, query_id) GROUP BY mode""")
def effectiveness(read: Read) -> DataFrame:
    nodes, queries, results = _modes(read)
    return evaluate.effectiveness(results, _label_qrels(nodes, queries))


@query(f"{_MODES}, dm AS (SELECT doc_id AS node_id, lang FROM documents) SELECT mode, query_id, round(count(*) FILTER (a.lang = b.lang) / 10, 4) AS correct FROM md JOIN dm a USING (node_id) JOIN dm b ON b.node_id = md.query_id GROUP BY ALL")
def domain_correct_fraction(read: Read) -> DataFrame:
    """How many of each mode's results are in the query's language."""
    nodes, queries, results = _modes(read)
    domains = nodes.select("node_id", F.col("lang").alias("domain"))
    return evaluate.domain_correct(results, domains, domains.withColumnRenamed("node_id", "query_id").join(queries.select("query_id"), "query_id", "left_semi"))


@query(f"{_MODES}, pr AS (SELECT src AS query_id, dst AS node_id FROM e WHERE src IN (SELECT query_id FROM qs)) SELECT query_id, node_id, max(CASE WHEN mode = 'vector' THEN rank END) AS vector_rank, max(CASE WHEN mode = 'hybrid' THEN rank END) AS hybrid_rank, coalesce(bool_or(mode = 'hybrid') AND NOT bool_or(mode = 'vector'), false) AS hidden_gem FROM pr LEFT JOIN md USING (query_id, node_id) GROUP BY ALL")
def hidden_gems(read: Read) -> DataFrame:
    """The ends of each query's edges, and whether hybrid search alone finds them."""
    nodes, queries, results = _modes(read)
    pairs = _similar_edges(read).select(F.col("source_id").alias("query_id"), F.col("target_id").alias("node_id")).join(queries.select("query_id"), "query_id", "left_semi")
    return evaluate.hidden_gems(results, pairs)


_WEIGHTED = f"""{_conditions_sql([hybrid.Condition(expand=False)])}, an AS (SELECT query_id, query_id AS node_id, 0 AS d FROM qs), wf AS (SELECT * FROM an UNION SELECT query_id, dst, d + 1 FROM wf JOIN e ON e.src = wf.node_id WHERE d < 3), wb AS (SELECT * FROM an UNION SELECT query_id, src, d + 1 FROM wb JOIN e ON e.dst = wb.node_id WHERE d < 3),
nr AS (SELECT query_id, node_id, round(1 / (1 + min(d)), 4) AS g FROM (SELECT * FROM wf UNION ALL SELECT * FROM wb) GROUP BY ALL), wt AS (SELECT unnest({[a for a, _ in evaluate.WEIGHTS]})::DOUBLE AS alpha, unnest({[b for _, b in evaluate.WEIGHTS]})::DOUBLE AS beta),
sc AS (SELECT alpha, beta, k0.query_id, k0.node_id, round(alpha * k0.v + beta * coalesce(nr.g, 0), 6) AS score FROM k0 CROSS JOIN wt LEFT JOIN nr ON nr.query_id = k0.query_id AND nr.node_id = k0.node_id WHERE k0.i <= 100),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alpha, beta, query_id ORDER BY score DESC, node_id) AS rank FROM sc) WHERE rank <= 10)"""


@query(f"{_WEIGHTED}, {_LABELLED}, {_judged_sql('rk', 'alpha, beta', 10)} SELECT alpha, beta, {_MEANS}, count(*) AS queries FROM ms GROUP BY ALL")
def weight_ablation(read: Read) -> DataFrame:
    """Of candidates' vector score and proximity to the query's own node, against rows with the query's label."""
    nodes, edges, queries = _hybrid_inputs(read)
    found = graph.settled(hybrid.candidates(nodes, queries, 10, parent=None))
    near = graph.proximity(edges, found, queries.select("query_id", F.col("query_id").alias("node_id")))
    return evaluate.weight_ablation(found.join(near, ["query_id", "node_id"]).select("query_id", "node_id", "v", F.col("proximity").alias("g")), _label_qrels(nodes, queries))
