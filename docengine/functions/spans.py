"""Interval functions over arrays of spans, evaluated within a row, and interval joins between frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions.arrays import block_sums, let, prefix_sum


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<m, char_start>> of all matches, in code points. The pattern must have no look-around that a split undoes."""
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    lengths = lambda x: F.flatten(F.zip_with(x["p"], x["m"], lambda p, m: F.array(F.length(p).cast("long"), F.coalesce(F.length(m), F.lit(0)).cast("long"))))
    placed = lambda x, n, s: F.transform(x["m"], lambda m, i: F.struct(m.alias("m"), prefix_sum(n, s, 2 * i + 1).cast("int").alias("char_start")))
    return let(parts, lambda x: let(lengths(x), lambda n: let(block_sums(n), lambda s: placed(x, n, s))))


def containing(spans: Column, position: Column) -> Column:
    """The first span, in array order, with char_start <= position < char_end; null if there is none."""
    return F.get(F.filter(spans, lambda s: (s["char_start"] <= position) & (position < s["char_end"])), 0)


def page_at(pages: Column, position: Column) -> Column:
    """Page number at a position; null between pages and without pages."""
    return containing(pages, position)["page_number"]


def overlaps_any(spans: Column, start: Column, end: Column) -> Column:
    """Does [start, end) overlap a span."""
    return F.coalesce(F.exists(spans, lambda t: ~((end <= t["char_start"]) | (start >= t["char_end"]))), F.lit(False))


def inside_any(spans: Column, position: Column) -> Column:
    """Does a span contain the position; boundaries at such places are suppressed."""
    return F.coalesce(F.exists(spans, lambda t: (t["char_start"] <= position) & (position < t["char_end"])), F.lit(False))


def overlap_length(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end_a, end_b) - F.greatest(start_a, start_b))


def is_relevant(src_start: Column, src_end: Column, start: Column, end: Column, threshold: float = 0.3) -> Column:
    """More than `threshold` of the source passage lies within the chunk."""
    return overlap_length(src_start, src_end, start, end) / F.greatest(src_end - src_start, F.lit(1)) > threshold


def overlap_relevance(retrieved: DataFrame, passages: DataFrame, threshold: float = 0.3) -> DataFrame:
    """retrieved (query_id, rank, doc_id, char_start, char_end) with relevance 0/1 against each query's passage
    (query_id, source_doc_id, char_start, char_end). A chunk of another document, or a query without passage, gets 0."""
    p = passages.select("query_id", "source_doc_id", F.col("char_start").alias("src_start"), F.col("char_end").alias("src_end"))
    hit = (F.col("doc_id") == F.col("source_doc_id")) & is_relevant(F.col("src_start"), F.col("src_end"), F.col("char_start"), F.col("char_end"), threshold)
    return retrieved.join(p, "query_id", "left").withColumn("relevance", F.coalesce(hit, F.lit(False)).cast("int")).drop("source_doc_id", "src_start", "src_end")


def with_section(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """chunks (doc_id, char_start, ...) with heading and section_number of the first section (doc_id, section_index,
    heading, section_number, char_start, char_end) that contains their start; empty texts if none does.

    Sections of a document are gathered into one array first, so no row is multiplied and the join is on doc_id alone.
    """
    gathered = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("section_index", "heading", "section_number", "char_start", "char_end"))).alias("__sections"))
    found = containing(F.col("__sections"), F.col("char_start"))
    joined = chunks.join(gathered, "doc_id", "left")
    return joined.select(*chunks.columns, F.coalesce(found["heading"], F.lit("")).alias("section_title"), F.coalesce(found["section_number"], F.lit("")).alias("section_number"))


def with_ends(spans: DataFrame, length: Column) -> DataFrame:
    """spans (doc_id, char_start) with char_end: the start of the document's next span, or its length."""
    following = F.lead("char_start").over(W.partitionBy("doc_id").orderBy("char_start"))
    return spans.withColumn("char_end", F.coalesce(following, length))
