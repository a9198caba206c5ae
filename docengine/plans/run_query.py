"""The query lifecycle as one plan over a batch of queries: transform, retrieve, fuse, rerank, answer, check, log."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators import encode, guardrails, rerank, retrieve, transform
from docengine.operators.responses import answered
from docengine.operators.scan import settled


@dataclass
class Config:
    module: str = "compliance"
    method: str = "bm25"
    transform: str = "none"
    reranker: str = "none"
    top_k: int = 10
    final_k: int = 5
    dim: int | None = None
    generate: bool = True

    def summary(self) -> str:
        return "  ".join(f"{k}={v}" for k, v in asdict(self).items())


def run(queries: DataFrame, chunks: DataFrame, config: Config, responses: DataFrame | None = None, embedder=encode.hashing_embedder) -> DataFrame:
    """One row for each non-empty query (query_id, query[, history]): rewritten, transformed_queries, top (retrieved chunks in
    order), answer, and the guardrails' columns.

    Chunks have chunk_id, doc_id, content, embedding and whatever else the checks read. Answers come from the responses
    table; a query without an answer has a null one. Variants are fused before reranking, which sees the rewritten query;
    a listwise reranker's answers come from the responses table too.
    """
    q = queries.where(encode.clean_query(F.col("query")) != "").withColumn("query_id", F.col("query_id").cast("string"))
    if "history" in q.columns:
        q = transform.rewrite_followups(q, responses, config.module)
    else:
        q = q.withColumn("rewritten", F.col("query"))
    asked = q.select("query_id", F.col("rewritten").alias("query"))
    initial = None
    if config.transform == "prf":
        initial = settled(retrieve.search(encode.embed(asked, "query", embedder=embedder, prompt=encode.QUERY_PROMPT), chunks, "hybrid", transform.FEEDBACK))
    variants = settled(transform.apply(config.transform, asked, config.module, responses, initial, chunks if initial is None else retrieve.found_chunks(initial, chunks)))
    vectors = encode.embed(variants, "query", embedder=embedder, prompt=encode.QUERY_PROMPT)
    found = retrieve.fan_out(vectors, chunks, config.method, config.top_k, dim=config.dim)
    candidates = found.join(retrieve.found_chunks(found, chunks.drop("embedding")), "chunk_id").join(asked, "query_id")
    said = None
    if config.reranker == "rankgpt" and responses is not None:
        said = answered(rerank.listwise_prompt(candidates), responses).where("response is not null").select("query_id", "response")
    best = rerank.rerank(candidates, config.reranker, config.final_k, responses=said)
    for c in ("section_title", "section_number", "effective_date", "filing_date"):
        if c not in best.columns:
            best = best.withColumn(c, F.lit("") if c.startswith("section") else F.lit(None).cast("string"))
    for c in ("char_start", "char_end"):
        if c not in best.columns:
            best = best.withColumn(c, F.lit(0))
    fields = ("rank", "chunk_id", "score", "doc_id", "content", "section_title", "section_number", "char_start", "char_end", "effective_date", "filing_date")
    best = settled(best.select("query_id", *fields))
    top = best.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("top"))  # final_k entries
    listed = variants.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("variant_no", "query"))).alias("v")).select("query_id", F.transform("v", lambda x: x["query"]).alias("transformed_queries"))
    blocks = transform.passage_blocks(best)
    rows = q.join(listed, "query_id", "left").join(top, "query_id", "left").join(blocks, "query_id", "left")
    rows = rows.withColumn("top", F.coalesce("top", F.array().cast(top.schema["top"].dataType)))
    history = F.coalesce("history", F.lit("(none)")) if "history" in q.columns else F.lit("(none)")
    rows = rows.withColumn("prompt", F.concat(F.lit("Conversation:\n"), history, F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nPassages:\n"), F.coalesce("passages", F.lit(""))))
    rows = answered(rows, responses if config.generate else None, into="answer").drop("prompt", "passages")
    return guardrails.check(rows.withColumn("module", F.lit(config.module)))


def timed(queries: DataFrame, chunks: DataFrame, config: Config, responses: DataFrame | None = None, embedder=encode.hashing_embedder) -> tuple[list, dict[str, float]]:
    """The rows of `run` for a batch of queries that fits the driver, and the seconds of each stage and in total.

    One plan does all stages, so a stage's time is that of the plan up to it less that of the plan before: the plans are run
    in turn. For batches of any size use `run`, whose times are the job's.
    """
    from dataclasses import replace
    from time import perf_counter

    took, so_far = {}, 0.0
    for name, part in (("retrieve", replace(config, transform="none", reranker="none", generate=False)), ("transform", replace(config, reranker="none", generate=False)), ("rerank", replace(config, generate=False)), ("generate", config)):
        begun = perf_counter()
        rows = run(queries, chunks, part, responses, embedder).collect()
        total = perf_counter() - begun
        took[name] = round(max(total - so_far, 0.0), 3)
        so_far = total
    return rows, took | {"total": round(so_far, 3)}


def timing_line(timings: Column) -> Column:
    """A map of seconds as one line: `total 1.20 s | retrieve 0.70 s | ...`, the total first, the others by name."""
    rest = F.array_sort(F.filter(F.map_keys(timings), lambda k: k != "total"))
    shown = lambda k: F.format_string("%s %.2f s", k, F.try_element_at(timings, k))
    head = F.when(F.map_contains_key(timings, F.lit("total")), F.array(shown(F.lit("total")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rest, shown)), " | ")


def log_rows(results: DataFrame, config: Config, timings: dict[str, float] | None = None) -> DataFrame:
    """Results in the query log's shape."""
    settings = F.create_map(*(F.lit(str(x)) for kv in asdict(config).items() for x in kv))
    times = F.create_map(*(F.lit(x) for kv in (timings or {}).items() for x in kv)).cast("map<string,double>")
    return results.select(
        "query_id", "query", settings.alias("config"), (F.col("transformed_queries") if config.transform != "none" else F.array().cast("array<string>")).alias("transformed_queries"),
        times.alias("timings"), "top", "answer", guardrails.as_record(results).alias("report"),
    )


def chunk_lines(results: DataFrame) -> DataFrame:
    """A markdown line for each retrieved chunk: number, document, section (80 characters), score, content (350)."""
    c = F.col("c")
    text = F.format_string("**[%d] %s** — %s (score %.3f)\n\n> %s", c["rank"], c["doc_id"].cast("string"), F.substring(c["section_title"], 1, 80), c["score"], F.substring(F.regexp_replace(c["content"], "\\s+", " "), 1, 350))
    return results.select("query_id", F.explode("top").alias("c")).select("query_id", c["rank"].alias("rank"), text.alias("markdown"))


def report_lines(results: DataFrame) -> DataFrame:
    """A markdown text for each query's checks: confidence, coverage, warnings, up to three unsupported sentences of 200 characters."""
    head = F.format_string("Confidence: %.2f (%s)", "confidence", "confidence_label")
    cover = F.when(F.col("citation_coverage").isNotNull(), F.format_string("Citation coverage: %.0f%%", F.col("citation_coverage") * 100))
    warned = F.transform("warnings", lambda w: F.format_string("- %s %s: %s", w["severity"], w["code"], w["message"]))
    bad = F.transform(F.slice("unsupported_sentences", 1, 3), lambda s: F.concat(F.lit("  - "), F.substring(s, 1, 200)))
    return results.select("query_id", F.concat_ws("\n", head, cover, F.array_join(warned, "\n"), F.array_join(bad, "\n")).alias("markdown"))
