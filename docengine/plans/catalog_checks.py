"""Queries over answers' checks, conversations, filings, stores, components of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import guardrails, passages, pca, transform
from docengine.plans.fixtures import table
from docengine.plans.registry import query
from docengine.sources import filings, stores

TODAY = "2000-06-01"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers, each with up to three documents as its passages; dates and scores follow from ids."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    ids = F.explode(F.array(*(F.col("conv_id") + k for k in range(3))))
    wanted = turns.select("conv_id", "turn", ids.alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    found = wanted.join(docs, "doc_id")
    one = F.struct(
        (F.col("doc_id") - F.col("conv_id")).alias("rank"), ((F.col("conv_id") + F.col("turn")) % 20 / 2.0).alias("score"), "content", "doc_id",
        F.concat((F.col("doc_id") % 4 + 1996).cast("string"), F.lit("-05-01")).alias("effective_date"), F.lit("").alias("filing_date"),
    )
    top = found.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(one)).alias("top"))  # three entries
    modules = F.when(F.col("conv_id") % 2 == 0, "compliance").otherwise("credit").alias("module")
    return turns.select("conv_id", "turn", modules, F.lit("What is the current rule?").alias("query"), F.col("text").alias("answer")).join(top, ["conv_id", "turn"])


CONFIDENCE = "CASE WHEN score <= 0 THEN 0.0 WHEN score <= 1.5 THEN least(score / 1.5, 1.0) ELSE least(score / 15, 1.0) END"


@query(f"""WITH s AS (SELECT conv_id, turn, ((conv_id + turn) % 20) / 2.0 AS score FROM conversations), c AS (SELECT *, {CONFIDENCE} AS c FROM s)
SELECT conv_id, turn, round(c, 6)::DOUBLE AS confidence, CASE WHEN c < 0.4 THEN 'low' WHEN c < 0.7 THEN 'medium' ELSE 'high' END AS label FROM c""")
def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: confidence of scores and its label."""
    c = guardrails.confidence((F.col("conv_id") + F.col("turn")) % 20 / 2.0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(c, 6).alias("confidence"), guardrails.confidence_label(c).alias("label"))


# Passages, sentences and numbers of the answers in SQL. Letters beyond ASCII become underscores there, which are word characters
# that no content word has: word boundaries of DuckDB's patterns know ASCII only.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS_SQL = "list_filter(list_distinct(list_filter(regexp_extract_all(regexp_replace(lower({0}), '[^\\x00-\\x7F\\p{{P}}\\p{{Z}}\\p{{S}}\\p{{C}}]', '_', 'g'), '\\b[a-z][a-z0-9-]+\\b'), lambda w: length(w) >= 3)), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in guardrails.STOP_WORDS) + "], w))"
NUMBERS_SQL = "regexp_extract_all({0}, '(?i)\\$\\s*\\d[\\d,]*(?:\\.\\d+)?(?:\\s*(?:million|billion|trillion|m|bn|k))?|\\d+(?:\\.\\d+)?\\s*%|\\b\\d{{4}}\\b|\\b\\d{{1,3}}(?:,\\d{{3}})+(?:\\.\\d+)?\\b|\\b\\d+\\.\\d+\\b')"
PHRASE_SQL = f"regexp_replace(translate(trim(lower({{0}}), {SPACES}), ',$ ', ''), 'million|billion|trillion|bn|m\\b|k\\b', '', 'g')"
ANSWERS_SQL = f"""an AS (SELECT row_number() OVER () AS r, conv_id, turn, text AS answer, CASE WHEN conv_id % 2 = 0 THEN 'compliance' ELSE 'credit' END AS module, least(((conv_id + turn) % 20) / 2.0, 1e9) AS score FROM conversations WHERE role = 'assistant'),
tp AS (SELECT r, d.doc_id, d.doc_id - an.conv_id AS rank, coalesce(d.text, '') AS content FROM an JOIN documents d ON d.doc_id BETWEEN an.conv_id AND an.conv_id + 2),
hs AS (SELECT DISTINCT r FROM tp),
se AS (SELECT r, i, trim(s, {SPACES}) AS s FROM (SELECT r, i, ss[i] AS s FROM (SELECT r, ss, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT r, string_split(regexp_replace(answer, '([.!?])\\s+([A-Z"''(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM an SEMI JOIN hs USING (r)))) WHERE trim(s, {SPACES}) <> ''),
sw AS (SELECT r, i, {WORDS_SQL.format('s')} AS ws FROM se),
pw AS (SELECT r, {WORDS_SQL.format('content')} AS ws FROM tp),
ok AS (SELECT DISTINCT sw.r, sw.i FROM sw JOIN pw USING (r) WHERE len(list_intersect(sw.ws, pw.ws)) >= 3),
cv AS (SELECT sw.r, count(*) AS n, count(*) FILTER (len(ws) >= 3 AND ok.i IS NULL) AS bad FROM sw LEFT JOIN ok ON ok.r = sw.r AND ok.i = sw.i GROUP BY sw.r),
c AS (SELECT an.r, conv_id, turn, module, score, answer, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, CASE WHEN coalesce(answer, '') = '' THEN NULL WHEN n IS NULL THEN 1.0 ELSE 1.0 - bad / n END AS coverage FROM an SEMI JOIN hs USING (r) LEFT JOIN cv USING (r)),
co AS (SELECT r, string_agg({PHRASE_SQL.format('content')}, ' ' ORDER BY rank) AS corpus FROM tp GROUP BY r),
nu AS (SELECT r, {PHRASE_SQL.format('x')} AS p FROM (SELECT r, unnest({NUMBERS_SQL.format('answer')}) AS x FROM c)),
ng AS (SELECT r, count(*) FILTER (contains(corpus, p)) AS good, count(*) FILTER (NOT contains(corpus, p)) AS loose FROM nu JOIN co USING (r) WHERE p NOT IN ('', '0') GROUP BY r)"""


@query(f"WITH {ANSWERS_SQL} SELECT conv_id, turn, round(coverage, 6)::DOUBLE AS coverage, bad::INT AS n_unsupported FROM c")
def citation_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of supported sentences, and how many are not."""
    r = guardrails.check(_answers(spark, sf_dir), F.lit(TODAY).cast("date"))
    return r.select("conv_id", "turn", F.round("citation_coverage", 6).alias("coverage"), F.size("unsupported_sentences").alias("n_unsupported"))


@query(f"""WITH {ANSWERS_SQL},
st AS (SELECT r, count(*) FILTER (doc_id % 4 < 3) AS n FROM tp GROUP BY r),
w AS (SELECT conv_id, turn, coalesce(coverage < 0.7 AND bad > 0, false) AS low, module <> 'compliance' AND coalesce(loose, 0) > 0 AS loose, ({CONFIDENCE}) < 0.4 AS unsure, st.n AS n FROM c LEFT JOIN ng USING (r) JOIN st USING (r))
SELECT conv_id, turn, array_to_string(list_concat([x for x in [CASE WHEN low THEN 'low_citation_coverage' END, CASE WHEN loose THEN 'ungrounded_numbers' END, CASE WHEN unsure THEN 'low_retrieval_confidence' END] if x IS NOT NULL],
  list_transform(range(n), lambda i: 'stale_source'), CASE WHEN n >= 3 THEN ['temporal_mismatch'] ELSE [] END), ',') AS codes, low OR loose AS high FROM w""")
def guardrail_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of each answer's warnings."""
    r = guardrails.check(_answers(spark, sf_dir), F.lit(TODAY).cast("date"))
    return r.select("conv_id", "turn", F.array_join(F.transform("warnings", lambda w: w["code"]), ",").alias("codes"), guardrails.has_high_severity(F.col("warnings")).alias("high"))


@query(r"""WITH n AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '(?i)\$\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:million|billion|trillion|m|bn|k))?|\d+(?:\.\d+)?\s*%|\b\d{4}\b|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b') AS ns FROM documents)
SELECT doc_id, len(ns)::INT AS n_numbers, array_to_string(list_transform(ns, lambda x: regexp_replace(translate(trim(lower(x)), ',$ ', ''), 'million|billion|trillion|bn|m\b|k\b', '', 'g')), ';') AS numbers FROM n""")
def number_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of texts, normalised."""
    found = guardrails.numbers(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_numbers"), F.array_join(F.transform(found, guardrails.number_phrase), ";").alias("numbers"))


@query(f"WITH {ANSWERS_SQL} SELECT conv_id, turn, coalesce(good, 0)::INT AS grounded_numbers, coalesce(loose, 0)::INT AS n_ungrounded FROM c LEFT JOIN ng USING (r)")
def number_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of answers that the passages hold, or don't."""
    r = guardrails.check(_answers(spark, sf_dir).withColumn("module", F.lit("credit")), F.lit(TODAY).cast("date"))
    return r.select("conv_id", "turn", "grounded_numbers", F.size("ungrounded_numbers").alias("n_ungrounded"))


@query(f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, round((DATE '{TODAY}' - o_orderdate::DATE) / 365.25, 6)::DOUBLE AS years, (DATE '{TODAY}' - o_orderdate::DATE) / 365.25 > 2 AS stale FROM orders")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ages of dates and whether they are stale."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"))
    years = guardrails.age(F.col("filing_date"), F.lit(TODAY).cast("date"))
    return df.select("o_orderkey", "filing_date", F.round(years, 6).alias("years"), (years > guardrails.YEARS).alias("stale"))


@query(r"""SELECT doc_id, length(t) >= 50 AND regexp_matches(t, '^(\p{Lu}|["(\[])') AND NOT regexp_matches(t, '(?i)^\s*Footnote|^\s*Skip to|^\s*Search|^\s*Language selection|^\s*Return to footnote|^\s*Page \d+|^\s*Table of Contents|^\s*Item \d+[A-Z]?\s*$')
AND NOT regexp_matches(t, '(?i)\b(as discussed above|see above|the above|the foregoing|the table below|the figure below|the chart below|the previous|the preceding|see Note \d+|refer to page \d+)\b')
AND length(regexp_replace(t, '[^\p{L}]', '', 'g')) / greatest(length(t), 1) >= 0.5 AS self_contained FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)""")
def self_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts that stand by themselves."""
    return table(spark, sf_dir, "documents").select("doc_id", passages.self_contained(F.col("text")).alias("self_contained"))


@query("""WITH l AS (SELECT conv_id, turn // 2 AS pair, turn, role, CASE role WHEN 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || text AS line, dense_rank() OVER (PARTITION BY conv_id ORDER BY turn // 2 DESC) AS k FROM conversations WHERE role IN ('user', 'assistant'))
SELECT conv_id, coalesce(h, '(none)') AS history FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) ORDER BY pair, role = 'assistant', turn) AS h FROM l WHERE k <= 6 AND length(line) > CASE role WHEN 'user' THEN 6 ELSE 11 END GROUP BY conv_id) USING (conv_id)""")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: the last six exchanges of each conversation."""
    return transform.history_text(table(spark, sf_dir, "conversations"))


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filing listings: a customer's orders as parallel arrays, by key."""
    o = table(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_custkey").cast("string").alias("cik")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))).alias("r"))
    of = lambda f: F.transform("r", f)
    form = F.transform("r", lambda x: F.when(x["o_orderstatus"] == "F", "8-K").when(x["o_orderstatus"] == "O", "10-K").otherwise("10-Q"))
    day = of(lambda x: F.date_format(x["o_orderdate"], "yyyy-MM-dd"))
    items = of(lambda x: F.when(x["o_orderkey"] % 2 == 0, "2.02,9.01").otherwise("9.01"))
    recent = F.struct(form.alias("form"), of(lambda x: F.concat_ws("-", F.lpad(x["o_orderkey"].cast("string"), 10, "0"), F.lit("00"))).alias("accessionNumber"), day.alias("filingDate"), day.alias("reportDate"), of(lambda x: F.concat(x["o_orderkey"].cast("string"), F.lit(".htm"))).alias("primaryDocument"), of(lambda x: x["o_orderpriority"]).alias("primaryDocDescription"), items.alias("items"))
    return rows.select("cik", F.struct(recent.alias("recent")).alias("filings"))


@query("""WITH f AS (SELECT o_custkey::VARCHAR AS cik, o_orderkey, CASE o_orderstatus WHEN 'F' THEN '8-K' WHEN 'O' THEN '10-K' ELSE '10-Q' END AS form, strftime(o_orderdate, '%Y-%m-%d') AS d, year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY cik, form ORDER BY d DESC, o_orderkey) AS place FROM f WHERE form <> '8-K' OR o_orderkey % 2 = 0)
SELECT cik, form, place::INT AS place, lpad(cik, 10, '0') AS padded, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || lpad(o_orderkey::VARCHAR, 10, '0') || '00/' || o_orderkey::VARCHAR || '.htm' AS url,
  'C' || cik || '_' || form || '_' || d || '_' || lpad(o_orderkey::VARCHAR, 10, '0') || '00' AS base, replace(lower(form), '-', '') AS doc_type, y::INT AS fiscal_year, q::INT AS fiscal_quarter
FROM k WHERE place <= CASE form WHEN '10-K' THEN 2 WHEN '10-Q' THEN 3 ELSE 1 END""")
def selected_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings to rows, the latest of each form, names, periods."""
    rows = filings.filings(_listings(spark, sf_dir))
    quotas = rows.select("cik").distinct().withColumn("q", F.explode(F.array(*(F.struct(F.lit(f).alias("form"), F.lit(n).alias("quota")) for f, n in (("10-K", 2), ("10-Q", 3), ("8-K", 1)))))).select("cik", "q.*")
    year, quarter = filings.fiscal_period(F.col("report_date"))
    chosen = filings.select_filings(rows, quotas)
    return chosen.select(
        "cik", "form", "place", filings.padded_cik(F.col("cik")).alias("padded"), filings.filing_url(F.col("cik"), F.col("accession"), F.col("primary_doc")).alias("url"),
        filings.base_name(F.concat(F.lit("C"), "cik"), F.col("form"), F.col("filing_date"), F.col("accession")).alias("base"), filings.doc_type(F.col("form")).alias("doc_type"), year.alias("fiscal_year"), quarter.alias("fiscal_quarter"),
    )


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus <> 'P')::BIGINT AS n_success, count(*) FILTER (o_orderstatus = 'O')::BIGINT AS n_skipped, count(*) FILTER (o_orderstatus = 'P')::BIGINT AS n_failed, coalesce(sum(o_orderkey) FILTER (o_orderstatus <> 'P'), 0)::BIGINT AS total_bytes FROM orders")
def fetch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of fetches."""
    return filings.manifest(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") != "P").alias("success"), (F.col("o_orderstatus") == "O").alias("skipped"), F.col("o_orderkey").alias("n_bytes")))


@query("SELECT o_orderkey AS key, 'order' AS kind, o_custkey::BIGINT AS value FROM orders UNION ALL SELECT vec_id, 'vector', label::BIGINT FROM embeddings ANTI JOIN orders ON vec_id = o_orderkey")
def merged_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert of one whole table into another; new rows replace those with their keys."""
    present = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.lit("vector").alias("kind"), F.col("label").cast("long").alias("value"))
    return stores.merged(present, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.lit("order").alias("kind"), F.col("o_custkey").cast("long").alias("value")), "key")


@query("SELECT module, chunk_strategy, module || '_' || chunk_strategy AS collection FROM (VALUES ('compliance', 'regulatory_boundary'), ('compliance', 'semantic'), ('compliance', 'hierarchical'), ('credit', 'financial_statement'), ('credit', 'semantic'), ('credit', 'narrative_section')) t(module, chunk_strategy)")
def collection_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collections."""
    return stores.collections(spark)


@query("""WITH e AS (SELECT unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT i::INT AS i, round(avg(x), 6) AS mean, round(var_samp(x), 6) AS variance FROM e GROUP BY i""")
def component_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: means and variances behind the components."""
    n, mean, scatter = pca.moments(table(spark, sf_dir, "embeddings"))
    rows = [(i + 1, round(float(m), 6), round(float(scatter[i, i]) / (n - 1), 6)) for i, m in enumerate(mean)]
    return spark.createDataFrame(rows, "i int, mean double, variance double")


@query()
def component_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A5: eigenvalues, elbows, cumulative variance."""
    _, whole = pca.fit(table(spark, sf_dir, "embeddings"), "credit", "embeddings")
    return pca.as_row(spark, whole)


@query()
def projected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight coordinates around the mean, of unit length."""
    e = table(spark, sf_dir, "embeddings")
    model, _ = pca.fit(e)
    return pca.project(e, model, 8).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


@query(r"""WITH u AS (SELECT url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
SELECT url, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM u""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: version-5 UUIDs of addresses."""
    return table(spark, sf_dir, "pages").select("url", X.uuid5(F.col("url")).alias("id"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS preview FROM (SELECT conv_id, turn, trim(replace(text, chr(10), ' ')) AS t FROM conversations)""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-line previews of turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.preview(F.col("text")).alias("preview"))
