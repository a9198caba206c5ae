"""Queries over retrieval: channels, fusion, routing, transforms, rerankers, metrics, sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import encode, fusion, metrics, rerank, retrieve, transform
from docengine.plans import run_query as lifecycle
from docengine.plans import sweeps
from docengine.plans.fixtures import benchmark_queries, table, vector_chunks, vector_queries, whole_chunks
from docengine.plans.registry import query

WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
POSTINGS_SQL = f"""
dw AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM dw),
tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM dw) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT doc_id, tf.term, tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS sat, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, ln(1 + tf::DOUBLE) AS lg FROM tf JOIN df ON tf.term = df.term, st),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(sat * idf * qtf), 6) AS bm25, round(sum(lg * idf * qtf), 6) AS learned FROM w JOIN qt ON w.term = qt.term GROUP BY ALL)"""


def _top(column: str, name: str, k: int) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, chunk_id, {column} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {column} DESC, chunk_id) AS rank FROM sc) WHERE rank <= {k})"


RANKED = "query_id, chunk_id, score::DOUBLE AS score, rank::INT AS rank"
CHANNELS_SQL = f"{POSTINGS_SQL}, {_top('learned', 'a', 50)}, {_top('bm25', 'b', 50)}"
NORMS_SQL = """
na AS (SELECT *, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM a WINDOW w AS (PARTITION BY query_id)),
nb AS (SELECT *, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM b WINDOW w AS (PARTITION BY query_id)),
u AS (SELECT query_id, chunk_id, 0 AS list_no, rank, norm, score FROM na UNION ALL SELECT query_id, chunk_id, 1, rank, norm, score FROM nb)"""


def _fused(part: str, k: int, extra: str = "") -> str:
    return f"""f AS (SELECT query_id, chunk_id, round(sum(p), 6) AS score, min(list_no * 1000000 + rank) AS first FROM (SELECT *, {part} AS p FROM u {extra}) WHERE p IS NOT NULL GROUP BY ALL)
SELECT {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f) WHERE rank <= {k}"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.sparse_lists(benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir), 50)


@query(f"WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)} SELECT {RANKED} FROM b")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 top ten of the benchmark texts."""
    return retrieve.sparse(benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir), 10)


@query(f"WITH {POSTINGS_SQL}, {_top('learned', 'b', 10)} SELECT {RANKED} FROM b")
def learned_sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned-sparse top ten."""
    return retrieve.sparse(benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir), 10, "learned")


@query(f"WITH {POSTINGS_SQL}" + " SELECT term, df::BIGINT AS df FROM df")
def document_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: how many documents have each term."""
    return encode.document_frequency(encode.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _dense_sql(dim: int) -> str:
    norm = f"(SELECT vec_id, embedding[1:{dim}]::DOUBLE[] AS v FROM embeddings)"
    return f"""WITH e AS (SELECT vec_id, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM {norm}),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.v, c.v), 6) AS score FROM e q, e c WHERE q.vec_id % 50 = 0)
SELECT {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 10"""


@query(_dense_sql(64))
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: exact cosine top ten."""
    return retrieve.dense(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 10)


@query(_dense_sql(16))
def matryoshka_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: the same at a quarter of the width."""
    return retrieve.dense(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 10, 16)


@query("SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.v, c.v), 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, c.v), 6) DESC, c.vec_id))::INT AS rank FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings) q, (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS v FROM embeddings WHERE label IN (1, 2)) c WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, c.v), 6) DESC, c.vec_id) <= 10")
def filtered_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a payload filter before scoring."""
    return retrieve.search(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), "dense", 10, filters={"label": [1, 2]})


@query("SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, len(v)::INT AS width FROM (SELECT vec_id, list_transform(w, lambda x: x / greatest(sqrt(list_inner_product(w, w)), 1e-12)) AS v FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS w FROM embeddings))")
def truncated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: vectors cut to half their width have unit length again."""
    from docengine.functions.arrays import norm

    df = encode.all_dims(table(spark, sf_dir, "embeddings"))
    return df.select("vec_id", F.round(norm(F.col("embedding_32")), 6).alias("norm"), F.size("embedding_32").alias("width"))


@query(f"WITH {CHANNELS_SQL}, {NORMS_SQL}, " + _fused("1.0 / (60 + rank)", 10))
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of two channels."""
    return fusion.rrf(_channels(spark, sf_dir), top=10)


@query(f"WITH {CHANNELS_SQL}, {NORMS_SQL}, " + _fused("CASE WHEN list_no = 0 THEN 0.7 * norm ELSE 0.3 * norm END", 10))
def convex_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex combination of two channels."""
    return fusion.convex_lists(_channels(spark, sf_dir), 0.7, 10)


QUERY_FORMS = """CASE item_id % 4 WHEN 0 THEN array_to_string(string_split(text, ' ')[1:3], ' ') WHEN 1 THEN array_to_string(string_split(text, ' ')[1:10], ' ') WHEN 2 THEN text ELSE 'Item 7A ' || array_to_string(string_split(text, ' ')[1:6], ' ') END"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as short, middle, long and exact-term queries."""
    words = lambda n: F.array_join(F.slice(F.split("text", " "), 1, n), " ")
    form = F.when(F.col("item_id") % 4 == 0, words(3)).when(F.col("item_id") % 4 == 1, words(10)).when(F.col("item_id") % 4 == 2, F.col("text")).otherwise(F.concat(F.lit("Item 7A "), words(6)))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), form.alias("query"))


STRATEGY_SQL = f"""qf AS (SELECT item_id AS query_id, {QUERY_FORMS} AS q FROM benchmark),
ch AS (SELECT query_id, CASE WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) < 5 THEN 'sparse' WHEN regexp_matches(q, '\\b[A-Z]-\\d+|"[^"]+"|\\b\\d{{4,}}\\b|\\bItem \\d+[A-Z]?\\b') THEN 'exact' WHEN len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) > 15 THEN 'long' ELSE 'rrf' END AS strategy FROM qf)"""


@query(f"WITH {STRATEGY_SQL} SELECT query_id, strategy FROM ch")
def query_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fusion each query gets."""
    return _forms(spark, sf_dir).select("query_id", fusion.strategy(F.col("query")).alias("strategy"))


ROUTE = "CASE strategy WHEN 'sparse' THEN CASE WHEN list_no = 1 THEN score END WHEN 'rrf' THEN 1.0 / (60 + rank) WHEN 'exact' THEN CASE WHEN list_no = 0 THEN 0.4 ELSE 0.6 END * norm ELSE CASE WHEN list_no = 0 THEN 0.85 ELSE 0.15 END * norm END"


@query(f"WITH {CHANNELS_SQL}, {NORMS_SQL}, {STRATEGY_SQL}, " + _fused(ROUTE, 10, "JOIN ch USING (query_id)"))
def router_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed fusion; all strategies in one plan."""
    return fusion.routed_lists(_forms(spark, sf_dir), _channels(spark, sf_dir), 10)


@query(f"""WITH {CHANNELS_SQL}, {NORMS_SQL},
al AS (SELECT * FROM (VALUES (0.1), (0.2), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8), (0.9)) t(alpha)),
f AS (SELECT alpha::DOUBLE AS alpha, query_id, chunk_id, round(sum(CASE WHEN list_no = 0 THEN alpha::DOUBLE * norm ELSE (1 - alpha::DOUBLE) * norm END), 6) AS score, min(list_no * 1000000 + rank) AS first FROM u, al GROUP BY ALL)
SELECT alpha, {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f) WHERE rank <= 5""")
def alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine weights over channels that are read once."""
    return fusion.alpha_sweep(_channels(spark, sf_dir), sweeps.ALPHAS, 5)


@query(f"WITH {CHANNELS_SQL}, u AS (SELECT *, 0 AS list_no FROM a UNION ALL SELECT *, 1 FROM b), f AS (SELECT query_id, chunk_id, max(score) AS score, min(list_no * 1000000 + rank) AS first FROM u GROUP BY ALL) SELECT {RANKED} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f) WHERE rank <= 30")
def best_of_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of channels with each chunk's best score."""
    return fusion.keep_best(_channels(spark, sf_dir), 30)


@query()
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three channels with hashed vectors, fused by rank."""
    q = encode.embed(benchmark_queries(spark, sf_dir), "query", prompt=encode.QUERY_PROMPT)
    return retrieve.search(q, encode.embed(whole_chunks(spark, sf_dir), "content"), "hybrid", 10)


@query(f"""WITH {POSTINGS_SQL}, {_top('bm25', 'b', 5)},
pw AS (SELECT query_id, unnest(list_distinct({WORDS.format('substr(text, 1, 600)')})) AS term FROM b JOIN documents ON doc_id = chunk_id),
pc AS (SELECT query_id, term, count(*) AS n FROM pw WHERE length(term) >= 3 GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, term) AS k FROM pc ANTI JOIN qt USING (query_id, term)),
ad AS (SELECT query_id, string_agg(term, ' ' ORDER BY k) AS added FROM pk WHERE k <= 6 GROUP BY query_id)
SELECT item_id AS query_id, 0 AS variant_no, concat_ws(' ', text, added) AS query FROM benchmark LEFT JOIN ad ON query_id = item_id""")
def feedback_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: queries expanded by what their first passages share."""
    q, c = benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir)
    return transform.prf(q, retrieve.sparse(q, c, 5), c, "compliance")


VARIANT_RESPONSE = """CASE item_id % 3 WHEN 0 THEN '["one", " two ", "", "three", "four", "five"]' WHEN 1 THEN '{"queries": ["alpha", "beta"]}' ELSE 'no list' END"""


@query("""WITH r AS (SELECT item_id AS query_id, text AS q, CASE item_id % 3 WHEN 0 THEN [text, 'one', 'two', 'three', 'four'] WHEN 1 THEN [text, 'alpha', 'beta'] ELSE [text, 'no list'] END AS vs FROM benchmark)
SELECT query_id, (i - 1)::INT AS variant_no, vs[i] AS query FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM r)""")
def multi_query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: variants parsed from three forms of responses."""
    df = benchmark_queries(spark, sf_dir).withColumn("item_id", F.col("query_id")).withColumn("response", F.expr(VARIANT_RESPONSE))
    return df.select("query_id", F.posexplode(transform.parsed_variants(F.col("response"), F.col("query"))).alias("variant_no", "query"))


@query(f"""WITH {POSTINGS_SQL}, {_top('bm25', 'b', 5)}, o AS (SELECT *, CASE rank WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 10 + rank END AS k FROM b)
SELECT query_id, chunk_id, round(1.0 / row_number() OVER (PARTITION BY query_id ORDER BY k), 6)::DOUBLE AS score, (row_number() OVER (PARTITION BY query_id ORDER BY k))::INT AS rank FROM o""")
def listwise_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a model's list with repeats, strays and gaps."""
    q = benchmark_queries(spark, sf_dir)
    said = q.select("query_id", F.lit('[3, 1, "x", 3, 99, 2]').alias("response"))
    return rerank.listwise(bm25_topk(spark, sf_dir).where("rank <= 5"), said, 5).select("query_id", "chunk_id", "score", "rank")


def _candidates(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    q, c = benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir)
    return retrieve.sparse(q, c, k).join(c.select("chunk_id", "content"), "chunk_id").join(q, "query_id")


@query(f"""WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)},
x AS (SELECT b.query_id, b.chunk_id, b.rank AS r0, list_distinct({WORDS.format('q.text')}) AS qw, {WORDS.format('d.text')} AS cw FROM b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id),
y AS (SELECT query_id, chunk_id, r0, round(len(list_intersect(qw, cw)) / greatest(len(qw), 1) / (1 + ln(1 + len(cw)::DOUBLE) / 20), 6) AS score FROM x)
SELECT query_id, chunk_id, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r0, chunk_id) AS rank FROM y) WHERE rank <= 5""")
def pair_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: candidates by the pair scorer."""
    return rerank.rerank(_candidates(spark, sf_dir), "cross_encoder", 5).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {POSTINGS_SQL}, {_top('bm25', 'b', 30)},
x AS (SELECT b.query_id, b.chunk_id, b.rank AS r0, list_distinct({WORDS.format('q.text')}) AS qw, {WORDS.format('d.text')} AS cw FROM b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id),
y AS (SELECT query_id, chunk_id, r0, len(list_intersect(qw, cw)) / greatest(len(qw), 1) / (1 + ln(1 + len(cw)::DOUBLE) / 20) AS p FROM x),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 6) DESC, r0, chunk_id) AS r1 FROM y) WHERE r1 <= 10),
two AS (SELECT query_id, chunk_id, round(1 / (1 + exp(-(4 * p - 1))), 6) AS score, r1 FROM one)
SELECT query_id, chunk_id, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r1, chunk_id) AS rank FROM two) WHERE rank <= 5""")
def rerank_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: two rerankers in a row."""
    return rerank.cascade(_candidates(spark, sf_dir, 30), [("cross_encoder", 10), ("monot5", 5)]).select("query_id", "chunk_id", "score", "rank")


METRICS_SQL = """
g AS (SELECT query_id, rank, (chunk_id % 3 = 0)::INT AS rel FROM b),
h AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits, sum(rel) OVER (PARTITION BY query_id) AS n FROM g),
pq AS (SELECT query_id, max(n)::BIGINT AS n_rel, sum(rel / log2(rank + 1)) AS dcg, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS mrr, coalesce(avg(hits / rank) FILTER (rel = 1), 0) AS ap,
  max(rel) FILTER (rank <= 1) AS r1, max(rel) FILTER (rank <= 3) AS r3, max(rel) FILTER (rank <= 5) AS r5, max(rel) FILTER (rank <= 10) AS r10 FROM h GROUP BY query_id),
m AS (SELECT query_id, round(CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, n_rel + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg, round(mrr, 6) AS mrr, round(ap, 6) AS ap,
  coalesce(r1, 0)::DOUBLE AS recall_1, coalesce(r3, 0)::DOUBLE AS recall_3, coalesce(r5, 0)::DOUBLE AS recall_5, coalesce(r10, 0)::DOUBLE AS recall_10 FROM pq)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir).withColumn("relevance", (F.col("chunk_id") % 3 == 0).cast("int"))


@query(f"WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)}, {METRICS_SQL} SELECT query_id, ndcg::DOUBLE AS ndcg, mrr::DOUBLE AS mrr, ap::DOUBLE AS ap, recall_1, recall_3, recall_5, recall_10 FROM m")
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M4 of each query."""
    return metrics.per_query(_judged(spark, sf_dir))


@query(f"WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)}, {METRICS_SQL} SELECT count(*)::BIGINT AS n_queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap, round(avg(recall_1), 6) AS recall_1, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10 FROM m")
def track_a_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: means over queries."""
    return metrics.summary(metrics.per_query(_judged(spark, sf_dir)))


@query("SELECT event_type, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: percentiles with linear interpolation, of event values."""
    return metrics.latency(table(spark, sf_dir, "events"), "value", ("event_type",))


@query(f"""WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)}, t AS (SELECT query_id, chunk_id AS src FROM b WHERE rank = 1)
SELECT b.query_id, b.chunk_id, b.rank::INT AS rank, (b.chunk_id = t.src AND least(200, length(d.text)) / 200.0 > 0.3)::INT AS relevance FROM b JOIN t USING (query_id) JOIN documents d ON d.doc_id = b.chunk_id""")
def overlap_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance by overlap with a source passage."""
    from docengine.functions.spans import overlap_relevance as judge

    found = bm25_topk(spark, sf_dir)
    sources = found.where("rank = 1").select("query_id", F.col("chunk_id").alias("source_doc_id"), F.lit(0).alias("char_start"), F.lit(200).alias("char_end"))
    placed = found.join(whole_chunks(spark, sf_dir).select("chunk_id", "doc_id", "char_start", "char_end"), "chunk_id")
    return judge(placed, sources).select("query_id", "chunk_id", "rank", "relevance")


@query()
def run_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole lifecycle over the benchmark texts, up to the guardrails."""
    chunks = encode.embed(whole_chunks(spark, sf_dir), "content")
    results = lifecycle.run(benchmark_queries(spark, sf_dir), chunks, lifecycle.Config(method="bm25", transform="prf", reranker="cross_encoder"))
    return results.select("query_id", "transformed_queries", F.transform("top", lambda c: c["chunk_id"]).alias("chunks"), "confidence", "confidence_label")


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every fiftieth vector as a query, all other vectors as chunks of their label's document, and the labels' passages: a
    vector is relevant for a query of its label."""
    c = vector_chunks(spark, sf_dir).where("chunk_id % 50 <> 0").select("chunk_id", "embedding", F.col("label").alias("doc_id"), F.lit(0).alias("char_start"), F.lit(100).alias("char_end"))
    q = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return q, c, q.select("query_id", F.col("label").alias("source_doc_id"), F.lit(0).alias("char_start"), F.lit(100).alias("char_end"))


def _judged_sql(lists: str, key: str) -> str:
    """Metrics of ranked lists (key, query_id, rank, rel) in SQL."""
    return f"""h AS (SELECT *, sum(rel) OVER (PARTITION BY {key}, query_id ORDER BY rank) AS hits FROM ({lists})),
pq AS (SELECT {key}, query_id, sum(rel)::BIGINT AS n_rel, sum(rel / log2(rank + 1)) AS dcg, coalesce(1.0 / min(rank) FILTER (rel = 1), 0) AS mrr, coalesce(avg(hits / rank) FILTER (rel = 1), 0) AS ap,
  {', '.join(f'coalesce(max(rel) FILTER (rank <= {n}), 0) AS r{n}' for n in (1, 3, 5, 10))} FROM h GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_rel > 0 THEN dcg / list_sum(list_transform(range(1, n_rel + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS ndcg FROM pq)
SELECT {key}, count(*)::BIGINT AS n_queries, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr, round(avg(ap), 6) AS ap, {', '.join(f'round(avg(r{n}), 6) AS recall_{n}' for n in (1, 3, 5, 10))} FROM m GROUP BY {key}"""


def _unit_sql(dim: int) -> str:
    return f"SELECT vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS v FROM (SELECT vec_id, label, embedding[1:{dim}]::DOUBLE[] AS v FROM embeddings)"


def _dense_list_sql(dim: int, k: int) -> str:
    return f"""SELECT {dim} AS dim, q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_inner_product(q.v, c.v), 6) AS score, (q.label = c.label)::INT AS rel,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.v, c.v), 6) DESC, c.vec_id) AS rank FROM ({_unit_sql(dim)}) q, ({_unit_sql(dim)}) c WHERE q.vec_id % 50 = 0 AND c.vec_id % 50 <> 0 QUALIFY rank <= {k}"""


@query("WITH " + _judged_sql(" UNION ALL ".join(f"({_dense_list_sql(d, 10)})" for d in encode.DIMS), "dim"))
def dimension_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense metrics for each width, judged by the vectors' labels."""
    return sweeps.dimension_grid(*_labelled(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_topk(spark, sf_dir).where("rank = 1").select("query_id", F.col("chunk_id").cast("string").alias("source_doc_id"), F.lit(0).alias("char_start"), F.lit(400).alias("char_end"))


@query()
def chunking_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategies' chunks, each retrieved among its own, by their metrics."""
    from docengine.plans.catalog_text import financial_chunks, narrative_chunks

    chunks = {"financial_statement": financial_chunks(spark, sf_dir), "narrative_section": narrative_chunks(spark, sf_dir)}
    return sweeps.strategy_grid(benchmark_queries(spark, sf_dir), chunks, _sources(spark, sf_dir))


@query(f"""WITH l AS (SELECT 0 AS list_no, * FROM ({_dense_list_sql(64, 50)}) UNION ALL SELECT 1, * FROM ({_dense_list_sql(8, 50)})),
u AS (SELECT *, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm FROM l WINDOW w AS (PARTITION BY query_id, list_no)),
f AS (SELECT (i / 10.0)::DOUBLE AS alpha, query_id, chunk_id, any_value(rel) AS rel, round(sum(CASE WHEN list_no = 0 THEN (i / 10.0)::DOUBLE * norm ELSE (1 - (i / 10.0)::DOUBLE) * norm END), 6) AS score, min(list_no * 1000000 + rank) AS first FROM u, range(1, 10) t(i) GROUP BY ALL),
{_judged_sql("SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f QUALIFY rank <= 10", "alpha")}""")
def alpha_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics for each weight between whole vectors and short ones, judged by the vectors' labels."""
    q, c, passages = _labelled(spark, sf_dir)
    lists = fusion.two_lists(retrieve.dense(q, c, 50), retrieve.dense(q, c, 50, 8))
    return sweeps.alpha_grid(lists, c, passages)


@query()
def track_b_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6-M9: assistant turns as answers, user turns as references."""
    t = table(spark, sf_dir, "conversations")
    pair = t.withColumn("pair", F.floor(F.col("turn") / 2)).groupBy("conv_id", "pair").agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("reference_answer"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("answer"))
    words = encode.terms(F.col("reference_answer"))
    rows = pair.withColumn("key_concepts", F.slice(words, 1, 3)).withColumn("latency_ms", (F.col("conv_id") % 100).cast("double"))
    return metrics.track_b_summary(metrics.answer_scores(rows))


@query()
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle's results in the query log's shape."""
    from docengine.sources.querylog import records

    chunks = encode.embed(whole_chunks(spark, sf_dir), "content")
    config = lifecycle.Config(method="bm25", final_k=3)
    return records(lifecycle.log_rows(lifecycle.run(benchmark_queries(spark, sf_dir), chunks, config), config)).drop("timestamp_utc")


@query(f"WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)} SELECT query_id::VARCHAR AS label, round(max(score), 6)::DOUBLE AS value FROM b GROUP BY query_id")
def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: the frame behind a bar chart."""
    best = bm25_topk(spark, sf_dir).groupBy(F.col("query_id").cast("string").alias("query")).agg(F.max("score").alias("score"))
    return sweeps.chart_bars(best, "query", "score")
