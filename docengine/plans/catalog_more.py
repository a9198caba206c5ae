"""Queries over transforms with responses, rerankers by vectors, indexes, documents' formats, stores and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import arrays, spans
from docengine.operators import cells, encode, metrics, pca, rerank, responses, retrieve, transform
from docengine.plans import run_query as lifecycle
from docengine.plans import sweeps
from docengine.plans.catalog_retrieval import CHANNELS_SQL, POSTINGS_SQL, RANKED, WORDS, _top
from docengine.plans.fixtures import benchmark_queries, table, vector_chunks, vector_queries, whole_chunks, workspace
from docengine.plans.registry import query
from docengine.sources import filings, html, querylog, sections, stores

TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def _said(queries: DataFrame, task: str, response) -> DataFrame:
    """A responses table for a transform's prompts: every second query has an answer."""
    some = queries.where("query_id % 2 = 0")
    return some.select(responses.key_of(transform.prompt(task, F.col("query"), "compliance")).alias("key"), response.alias("response"))


def _passage():
    return F.concat(F.lit("a passage about "), F.col("query_id").cast("string"))


@query("SELECT item_id AS query_id, 0 AS variant_no, CASE WHEN item_id % 2 = 0 THEN 'a passage about ' || item_id ELSE text END AS query FROM benchmark")
def hyde_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: hypothetical passages, the query itself where the model has no answer."""
    q = benchmark_queries(spark, sf_dir)
    return transform.hyde(q, "compliance", _said(q, "hyde", _passage()))


@query("SELECT item_id AS query_id, 0 AS variant_no, text AS query FROM benchmark UNION ALL SELECT item_id, 1, 'a passage about ' || item_id FROM benchmark WHERE item_id % 2 = 0")
def step_back_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: the query and a more general one."""
    q = benchmark_queries(spark, sf_dir)
    return transform.step_back(q, "compliance", _said(q, "step_back", F.concat(F.lit(" \n"), _passage(), F.lit(" "))))


@query("""WITH n(name) AS (VALUES ('none'), ('hyde'), ('multi_query'), ('step_back')), v AS (SELECT name, item_id, item_id % 2 = 0 AS said, text FROM benchmark, n)
SELECT name, item_id AS query_id, 0 AS variant_no, CASE WHEN name = 'hyde' AND said THEN 'x' ELSE text END AS query FROM v UNION ALL SELECT name, item_id, 1, CASE name WHEN 'step_back' THEN 'x' ELSE 'one' END FROM v WHERE said AND name IN ('multi_query', 'step_back')
UNION ALL SELECT name, item_id, 2, 'two' FROM v WHERE said AND name = 'multi_query'""")
def dispatched_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: transforms by name."""
    q = benchmark_queries(spark, sf_dir)
    said = _said(q, "hyde", F.lit("x")).unionAll(_said(q, "step_back", F.lit("x"))).unionAll(_said(q, "multi_query", F.lit('```json\n["one", "two", " "]\n```')))
    parts = [transform.apply(name, q, "compliance", said).select(F.lit(name).alias("name"), "*") for name in ("none", "hyde", "multi_query", "step_back")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("""WITH u AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'what of ' || conv_id WHEN 1 THEN q ELSE q END AS rewritten FROM u""")
def rewritten_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: last questions as standalone ones: the model's answer without quotes, the question where it is blank or absent."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query")).join(transform.history_text(turns), "conv_id")
    key = responses.key_of(transform.prompt("rewrite", F.col("query"), "compliance", F.col("history")))
    answer = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit(' "what of '), F.col("conv_id").cast("string"), F.lit('" '))).when(F.col("conv_id") % 3 == 1, F.lit(' "" '))
    said = asked.select(key.alias("key"), answer.alias("response")).where("response is not null").dropDuplicates(["key"])
    return transform.rewrite_followups(asked, said).select("conv_id", "rewritten")


@query(f"""WITH {POSTINGS_SQL}, {_top('bm25', 'b', 3)}
SELECT query_id, string_agg('[' || rank || '] (doc: ' || doc_id || ', section: ' || source || ')' || chr(10) || substr(text, 1, 1800), chr(10) || chr(10) ORDER BY rank) AS passages FROM b JOIN documents ON doc_id = chunk_id GROUP BY query_id""")
def passage_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: retrieved chunks as numbered blocks of a prompt."""
    q, c = benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir)
    top = retrieve.sparse(q, c, 3).join(c.select("chunk_id", "doc_id", "content", F.col("source").alias("section_title")), "chunk_id")
    return transform.passage_blocks(top)


@query("""SELECT item_id, CASE item_id % 4 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '[2]' END AS json, CASE item_id % 4 WHEN 2 THEN 'not valid JSON' WHEN 3 THEN 'no response' END AS error FROM benchmark""")
def repaired_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: JSON answers in fences, repaired in a second round, broken twice, and absent."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("prompt"))
    first = q.where("item_id % 4 < 3").select(responses.key_of(F.col("prompt")).alias("key"), F.when(F.col("item_id") % 4 == 0, '```json\n{"a": 1}\n```').otherwise("[2").alias("response"))
    again = responses.key_of(F.concat(F.col("prompt"), F.lit(responses.REPAIR), F.lit("[2")))
    second = q.where("item_id % 4 in (1, 2)").select(again.alias("key"), F.when(F.col("item_id") % 4 == 1, "[2]").otherwise("{").alias("response"))
    return responses.json_answered(q, first.unionAll(second)).select("item_id", "json", "error")


@query("SELECT conv_id AS query_id, turn AS token_no, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS text FROM conversations")
def token_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10: a stream of pieces as the text so far at each."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("token_no"), F.col("text").alias("token"))
    return responses.cumulative(t).select("query_id", "token_no", "text")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'answer ' || turn END AS response FROM conversations")
def cached_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by the prompt's key; a key's copies count once, other settings have other keys."""
    prompts = table(spark, sf_dir, "conversations").withColumn("prompt", F.concat_ws("/", "conv_id", "turn", "text"))
    right = prompts.where("role = 'user'").select(responses.key_of(F.col("prompt")).alias("key"), F.concat(F.lit("answer "), F.col("turn").cast("string")).alias("response"))
    other = prompts.select(responses.key_of(F.col("prompt"), temperature=0.7).alias("key"), F.lit("warmer").alias("response"))
    return responses.answered(prompts, right.unionAll(right).unionAll(other)).select("conv_id", "turn", "response")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT q.vec_id AS query_id, d.chunk AS chunk_id FROM (SELECT vec_id FROM e WHERE vec_id % 50 = 0) q, (SELECT DISTINCT vec_id // 4 AS chunk FROM e) d WHERE d.chunk BETWEEN q.vec_id // 4 AND q.vec_id // 4 + 20),
t AS (SELECT vec_id // 50 * 50 AS query_id, vec_id % 50 AS token_no, v FROM e WHERE vec_id % 50 < 3),
m AS (SELECT c.query_id, c.chunk_id, t.token_no, max(list_inner_product(t.v, e.v)) AS m FROM c JOIN t USING (query_id) JOIN e ON e.vec_id // 4 = c.chunk_id GROUP BY ALL),
s AS (SELECT query_id, chunk_id, round(sum(m), 6) AS score FROM m GROUP BY ALL)
SELECT query_id, chunk_id, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def maxsim_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K5: late interaction: queries of three token vectors, chunks of four."""
    e = table(spark, sf_dir, "embeddings")
    tokens = e.where("vec_id % 50 < 3").select((F.floor(F.col("vec_id") / 50) * 50).alias("query_id"), (F.col("vec_id") % 50).alias("token_no"), F.col("embedding").alias("vector"))
    chunk = F.floor(F.col("vec_id") / 4)
    chunks = e.select(chunk.alias("chunk_id"), F.col("embedding").alias("vector"))
    wanted = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.explode(F.sequence(chunk, chunk + 20)).alias("chunk_id"))
    candidates = wanted.join(chunks.select("chunk_id").distinct(), "chunk_id").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id")))
    return rerank.rerank(candidates.withColumn("score", F.lit(0.0)), "colbert", 5, query_vectors=tokens, chunk_vectors=chunks).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {POSTINGS_SQL}, {_top('bm25', 'b', 10)} SELECT {RANKED} FROM b")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that was written before: no text is read for the search."""
    path = workspace(spark, "index")
    retrieve.write_index(whole_chunks(spark, sf_dir), path)
    return retrieve.indexed(benchmark_queries(spark, sf_dir), path, 10)


@query()
def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2: approximate dense search; tests measure its recall against the exact one."""
    chunks = vector_chunks(spark, sf_dir)
    c = cells.centroids(chunks)
    return cells.search(vector_queries(spark, sf_dir), cells.index(chunks, c), c, 10)


@query(f"WITH {CHANNELS_SQL} SELECT 'bm25' AS channel, {RANKED} FROM b UNION ALL SELECT 'learned', {RANKED} FROM a")
def separate_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels apart; the dense one has the embedder's vectors and is left to the tests."""
    q, c = benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir)
    found = retrieve.channels(encode.embed(q, "query"), encode.embed(c, "content"))
    return found["bm25"].select(F.lit("bm25").alias("channel"), "query_id", "chunk_id", "score", "rank").unionAll(found["learned"].select(F.lit("learned"), "query_id", "chunk_id", "score", "rank"))


@query(f"WITH {CHANNELS_SQL} SELECT 'bm25' AS method, {RANKED} FROM b WHERE rank <= 10 UNION ALL SELECT m, {RANKED} FROM a, (VALUES ('learned'), ('splade')) t(m) WHERE rank <= 10")
def dispatched_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval methods by name."""
    q, c = benchmark_queries(spark, sf_dir), whole_chunks(spark, sf_dir)
    parts = [retrieve.by_method(m, q, c, 10).select(F.lit(m).alias("method"), "query_id", "chunk_id", "score", "rank") for m in ("bm25", "learned", "splade")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(f"WITH {POSTINGS_SQL}, {_top('bm25', 'b', 5)} SELECT {RANKED} FROM b WHERE query_id % 3 <> 0")
def blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """blank queries find nothing."""
    q = benchmark_queries(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 3 != 0, F.col("query")).when(F.col("query_id") % 2 == 0, F.lit(" \n")))
    return retrieve.sparse(q, whole_chunks(spark, sf_dir), 5)


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_transform(embedding, lambda x: 0.0) ELSE embedding::DOUBLE[] END AS v FROM embeddings), p AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN list_inner_product(x, x) * list_inner_product(y, y) = 0 THEN 0 ELSE list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) END, 6) AS similarity FROM p""")
def guarded_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring vectors' cosine, 0 where one is zero."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(F.col("embedding").cast("array<double>")).alias("x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(arrays.cosine(F.col("x"), F.col("y")), 6).alias("similarity"))




@query(f"""WITH p AS (SELECT conv_id, turn // 2 AS pair, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a FROM conversations GROUP BY ALL),
w AS (SELECT *, {WORDS.format('u')} AS r, {WORDS.format('a')} AS c FROM p), x AS (SELECT *, len(list_filter(c, lambda t: list_contains(r, t))) / greatest(len(c), 1) AS pr, len(list_filter(r, lambda t: list_contains(c, t))) / greatest(len(r), 1) AS re FROM w)
SELECT conv_id, pair::BIGINT AS pair, round(CASE WHEN len(r) = 0 OR len(c) = 0 OR pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6)::DOUBLE AS f1, round(CASE WHEN len(r) > 0 THEN len(list_filter(r[1:3], lambda t: contains(lower(coalesce(a, '')), t))) / len(r[1:3]) END, 6)::DOUBLE AS concepts FROM x""")
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, M8: matching of tokens and coverage of concepts, assistant turns against user turns."""
    t = table(spark, sf_dir, "conversations")
    pair = t.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.max(F.when(F.col("role") == "user", F.col("text"))).alias("u"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("a"))
    r, c = encode.terms(F.col("u")), encode.terms(F.col("a"))
    f1 = metrics.token_f1(r, c, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return pair.select("conv_id", "pair", F.round(f1, 6).alias("f1"), F.round(metrics.concept_coverage(F.slice(r, 1, 3), F.col("a")), 6).alias("concepts"))


RESULTS = "SELECT s_suppkey::INT AS config_no, CASE WHEN s_suppkey % 4 > 0 THEN round(s_acctbal / 1000) / 10.0 + 0.0::DOUBLE END AS ndcg FROM supplier"


@query(f"SELECT config_no, ndcg::DOUBLE AS ndcg, (row_number() OVER (ORDER BY coalesce(ndcg, 0) DESC, config_no))::INT AS place FROM ({RESULTS})")
def compared_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations by a metric that some lack."""
    return metrics.compared(_results(spark, sf_dir), "ndcg")


@query(f"SELECT config_no, ndcg::DOUBLE AS ndcg FROM ({RESULTS}) ORDER BY coalesce(ndcg, 0) DESC, config_no LIMIT 1")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of them, the first of equals."""
    return metrics.best(_results(spark, sf_dir), "ndcg")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("config_no"), F.when(F.col("s_suppkey") % 4 > 0, F.round(F.col("s_acctbal").cast("double") / 1000) / 10.0).alias("ndcg"))


@query()
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy stages over sparse methods and rerankers, judged by the document that each query was taken from."""
    c = whole_chunks(spark, sf_dir)
    q, sources = _taken(spark, sf_dir)
    return sweeps.ablation(spark, q, c, sources, methods=("bm25", "learned"), transforms=("none",), rerankers=("none", "cross_encoder", "monot5"))


def _taken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Twelve words from the middle of every fiftieth document as queries, and these documents as their sources."""
    docs = table(spark, sf_dir, "documents").where("doc_id % 50 = 0 and text is not null")
    words = F.split("text", " ")
    q = docs.select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, F.floor(F.size(words) / 2).cast("int") + 1, F.lit(12)), " ").alias("query"))
    return q, docs.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("source_doc_id"), F.lit(0).alias("char_start"), F.length("text").alias("char_end"))


@query(f"""WITH {POSTINGS_SQL.replace("SELECT item_id AS query_id, unnest(" + WORDS.format('text') + ") AS term FROM benchmark", "SELECT doc_id AS query_id, unnest(" + WORDS.format("array_to_string(string_split(text, ' ')[len(string_split(text, ' ')) // 2 + 1:len(string_split(text, ' ')) // 2 + 12], ' ')") + ") AS term FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL")}, {_top('bm25', 'b', 10)}
SELECT query_id, min(rank) FILTER (chunk_id = query_id)::INT AS place, count(*)::BIGINT AS n FROM b GROUP BY query_id""")
def known_item_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a search finds the document that a query was taken from."""
    q, _ = _taken(spark, sf_dir)
    found = retrieve.search(q, whole_chunks(spark, sf_dir), "sparse", 10, "bm25")
    return found.groupBy("query_id").agg(F.min(F.when(F.col("chunk_id") == F.col("query_id"), F.col("rank"))).alias("place"), F.count("*").alias("n"))


# --- documents' formats, stores, logs ---------------------------------------------------------------------------------


PAGES_SQL = f"""l AS (SELECT doc_id, i::INT AS page_number, {TRIM.format('ls[i]')} AS t FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
pg AS (SELECT doc_id, page_number, t, (coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS char_start FROM l WHERE t <> '')"""


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "text"))
    return sections.page_texts(lines.select("doc_id", (F.col("k") + 1).alias("page_number"), "text"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, string_agg(t || chr(10) || chr(10), '' ORDER BY page_number) AS full_text, count(*)::INT AS n_pages, max(char_start + length(t) + 2)::INT AS last_end FROM pg GROUP BY doc_id")
def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts as documents with page spans; lines stand for pages."""
    return _paged(spark, sf_dir).select("doc_id", "full_text", F.size("pages").alias("n_pages"), F.element_at("pages", -1)["char_end"].alias("last_end"))


@query(f"WITH {PAGES_SQL}, n AS (SELECT doc_id, sum(length(t) + 2)::INT // 2 AS p FROM pg GROUP BY doc_id) SELECT n.doc_id, page_number FROM n LEFT JOIN pg ON pg.doc_id = n.doc_id AND char_start <= p AND p < char_start + length(t) + 2")
def middle_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page at the middle of each document."""
    return _paged(spark, sf_dir).select("doc_id", spans.page_at(F.col("pages"), F.floor(F.length("full_text") / 2).cast("int")).alias("page_number"))


HEADING_SQL = r"'^\s*(Article\s+\d+[a-z]?|Chapter\s+(?:\d+|[IVXLCDM]+)|Item\s+\d+[A-Z]?|\d+(?:\.\d+){0,3})\.?\s*[—:.\-]?\s*(.*)$'"
TITLES = "CASE doc_id % 5 WHEN 0 THEN 'Item 7A. ' || t WHEN 1 THEN 'Chapter IV — ' || t WHEN 2 THEN '3.1.2 ' || t WHEN 3 THEN t ELSE 'Article 12b' END"


@query(rf"""WITH h AS (SELECT doc_id, {TITLES} AS h FROM (SELECT doc_id, array_to_string(string_split(string_split(coalesce(text, ''), chr(10))[1], ' ')[1:4], ' ') AS t FROM documents))
SELECT doc_id, CASE WHEN regexp_matches(h, {HEADING_SQL}) THEN trim(regexp_extract(h, {HEADING_SQL}, 1)) ELSE '' END AS number, CASE WHEN regexp_matches(h, {HEADING_SQL}) AND trim(regexp_extract(h, {HEADING_SQL}, 2)) <> '' THEN trim(regexp_extract(h, {HEADING_SQL}, 2)) ELSE h END AS heading FROM h""")
def heading_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: headings as number and text."""
    first = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), 0), " "), 1, 4), " ").alias("t"))
    number, text = sections.heading_parts(F.col("h"))
    return first.select("doc_id", F.expr(TITLES).alias("h")).select("doc_id", number.alias("number"), text.alias("heading"))


@query("""SELECT page_id::VARCHAR AS doc_id, CASE page_id % 4 WHEN 2 THEN 'unsupported file extension' WHEN 3 THEN 'no page texts' END AS error, CASE WHEN page_id % 4 = 1 THEN 'page one of ' || page_id || chr(10) || chr(10) || 'Item 2. The second page' || chr(10) || chr(10) WHEN page_id % 4 > 1 THEN '' END AS pdf_text,
CASE WHEN page_id % 4 = 1 THEN 2 ELSE 0 END AS n_pages, CASE WHEN page_id % 4 = 1 THEN 'Item 2' END AS first_section FROM pages""")
def dispatched_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of several formats; those that can't be parsed have an error and fail nothing."""
    of = F.col("page_id") % 4
    p = table(spark, sf_dir, "pages")
    texts = F.array(*(F.struct(F.lit(n).alias("page_number"), t.alias("text")) for n, t in ((3, F.lit(" \n")), (2, F.lit("Item 2. The second page ")), (1, F.concat(F.lit("page one of "), F.col("page_id").cast("string"))))))
    path = F.concat(F.lit("a.b/"), F.col("page_id").cast("string"), F.when(of == 0, ".HTM").when(of == 2, ".txt").otherwise(".pdf"))
    files = p.select(F.col("page_id").alias("doc_id"), F.create_map().cast("map<string,string>").alias("metadata"), "html", path.alias("path"), F.when(of == 1, texts).alias("page_texts"))
    parsed = html.parse_documents(files, "credit")
    pdf = F.when(F.col("doc_id").cast("long") % 4 > 0, F.col("full_text"))
    return parsed.select("doc_id", "error", pdf.alias("pdf_text"), F.size("pages").alias("n_pages"), F.when(pdf.isNotNull(), F.get("sections", 0)["section_number"]).alias("first_section"))


@query("SELECT 'd' || n_nationkey AS stem, 'raw/d' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '.html' ELSE '.pdf' END AS path, n_name AS metadata FROM nation WHERE n_nationkey % 3 > 0")
def paired_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files and their sidecars by stem; files without one are left out, the first of several files counts."""
    n = table(spark, sf_dir, "nation")
    path = lambda end: F.concat(F.lit("raw/d"), F.col("n_nationkey").cast("string"), end).alias("path")
    raw = n.select(path(F.when(F.col("n_nationkey") % 2 == 0, ".html").otherwise(".pdf"))).unionAll(n.where("n_nationkey % 2 = 0").select(path(F.lit(".pdf"))))
    return filings.paired_files(raw, n.where("n_nationkey % 3 > 0").select(path(F.lit(".meta.json")), F.col("n_name").alias("metadata")))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0")
def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a store lacks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return stores.new_documents(docs, docs.where("doc_id % 3 = 0"))


@query("SELECT n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS region FROM nation")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows written as JSON lines without nulls and read again under a schema."""
    path = workspace(spark, "lines")
    stores.write_jsonl(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_regionkey")).alias("region")), path)
    return stores.read_jsonl(spark, path, "key long, name string, region long").select(F.col("key"), "name", "region")


@query("""SELECT '[' || string_agg('{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}', ',' ORDER BY r_regionkey) || ']' AS json FROM region""")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as one JSON array."""
    return stores.json_array(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")


@query("SELECT * FROM (VALUES (1, 'created', 0), (2, 'skipped', 0), (3, 'loaded', (SELECT count(*) FROM nation)), (4, 'skipped', (SELECT count(*) FROM nation)), (5, 'loaded', (SELECT count(*) FROM nation)), (6, 'recreated', 0)) t(step, status, n_rows)")
def collection_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made, loaded once, loaded by force, and made anew."""
    path, rows, done = workspace(spark, "points"), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chunk_id"), "n_name"), []
    for step in (lambda: stores.ensure(spark, path, rows.schema), lambda: stores.ensure(spark, path, rows.schema), lambda: stores.load(spark, path, rows), lambda: stores.load(spark, path, rows), lambda: stores.load(spark, path, rows, force=True), lambda: stores.ensure(spark, path, rows.schema, recreate=True)):
        status = step()
        done.append((len(done) + 1, status, spark.read.parquet(path).count()))
    return spark.createDataFrame(done, "step int, status string, n_rows long")


@query("SELECT module || '_' || chunk_strategy AS collection, 'loaded' AS status, (SELECT count(*) FROM nation WHERE n_nationkey % 6 = k)::BIGINT AS n_rows FROM (VALUES (0, 'compliance', 'regulatory_boundary'), (1, 'compliance', 'semantic'), (2, 'compliance', 'hierarchical'), (3, 'credit', 'financial_statement'), (4, 'credit', 'semantic'), (5, 'credit', 'narrative_section')) t(k, module, chunk_strategy)")
def loaded_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every collection loaded from one chunk table."""
    root = workspace(spark, "collections")
    names = [(m, s) for m, ss in stores.REGISTRY.items() for s in ss]
    of = lambda k: F.coalesce(*(F.when(F.col("n_nationkey") % 6 == i, x[k]) for i, x in enumerate(names)))
    chunks = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chunk_id"), of(0).alias("module"), of(1).alias("chunk_strategy"))
    done = stores.load_all(spark, root, chunks)
    return spark.createDataFrame([(c, s, spark.read.parquet(f"{root}/{c}").count()) for c, s in done.items()], "collection string, status string, n_rows long")


@query("SELECT doc_id, content, lang FROM (SELECT doc_id, text AS content, lang FROM documents)")
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks without ids and vectors."""
    c = whole_chunks(spark, sf_dir).select("chunk_id", "doc_id", "content", "lang", F.array(F.lit(1.0)).alias("embedding"))
    return stores.payload(c)


@query("SELECT round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS square, count(*)::BIGINT AS n FROM embeddings GROUP BY square")
def scanned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector column of a stored table, and nothing else of it."""
    v = stores.vectors(spark, f"{sf_dir}/embeddings.parquet")
    return v.select(F.round(arrays.dot(F.col("embedding"), F.col("embedding")), 6).alias("square")).groupBy("square").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT conv_id || '-' || turn AS query_id, lpad(((conv_id * 7 + turn * 13) % 1000)::VARCHAR, 4, '0') AS timestamp_utc, text AS query FROM conversations) ORDER BY timestamp_utc DESC, query_id LIMIT 50")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fifty records of a log with broken lines in it."""
    path = workspace(spark, "log")
    t = table(spark, sf_dir, "conversations")
    rows = t.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.lpad(((F.col("conv_id") * 7 + F.col("turn") * 13) % 1000).cast("string"), 4, "0").alias("timestamp_utc"), F.col("text").alias("query"))
    rows.write.json(path)
    t.select(F.concat(F.lit("{broken "), F.col("turn").cast("string")).alias("value")).write.mode("append").text(path)
    return querylog.tail(spark, path, 50).select("query_id", "timestamp_utc", "query")


@query("""SELECT event_type, 'total ' || printf('%.2f', count(*) / 100.0) || ' s | rerank ' || printf('%.2f', count(value) / 50.0) || ' s | retrieve ' || printf('%.2f', 0.25::DOUBLE) || ' s' AS line FROM events GROUP BY event_type""")
def timing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage times as a line."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") / 100.0).cast("double").alias("t"), (F.count("value") / 50.0).cast("double").alias("r"))
    return e.select("event_type", lifecycle.timing_line(F.create_map(F.lit("retrieve"), F.lit(0.25), F.lit("total"), F.col("t"), F.lit("rerank"), F.col("r"))).alias("line"))


@query("SELECT a.s_suppkey AS first, b.s_suppkey AS second, CASE WHEN a.d < b.d THEN 'confirmed' WHEN a.d > b.d THEN 'rejected' ELSE 'inconclusive' END AS verdict FROM (SELECT s_suppkey, s_nationkey % 4 AS d FROM supplier) a JOIN (SELECT s_suppkey, s_nationkey % 4 AS d FROM supplier) b ON b.s_suppkey = a.s_suppkey + 1")
def dimension_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two modules' vectors needs fewer dimensions."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("d"))
    other = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_suppkey").alias("second"), F.col("d").alias("e"))
    return s.join(other, "s_suppkey").select(F.col("s_suppkey").alias("first"), "second", pca.verdict(F.col("d"), F.col("e")).alias("verdict"))


@query("SELECT 2 * count(*)::BIGINT AS n FROM embeddings")
def joined_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of two tables as one, repeats kept."""
    e = table(spark, sf_dir, "embeddings")
    return pca.union([e, e]).agg(F.count("*").alias("n"))


@query()
def reloaded_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components saved and read again, and the largest difference that this makes: none."""
    path = workspace(spark, "components")
    model, _ = pca.fit(table(spark, sf_dir, "embeddings"))
    model.save(spark, path)
    again = pca.Model.load(spark, path)
    worst = max(abs(model.mean - again.mean).max(), abs(model.components - again.components).max())
    return spark.createDataFrame([(len(model.mean), float(worst))], "width int, difference double")
