"""Section detection by headings' patterns, and page texts of paged documents; both within a row, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.spans import match_spans
from docengine.functions.text import stripped

# Heading patterns with their levels, in order of priority; 0: the number of dots, and one more.
PATTERNS = [
    (r"^\s*(Item\s+\d+[A-Z]?)\.?\s+(.{3,200})$", 2),
    (r"^\s*(Article\s+\d+[a-z]?)\s*[—:.\-]?\s*(.{3,200})$", 2),
    (r"^\s*(Chapter\s+(?:\d+|[IVXLCDM]+))\s*[—:.\-]?\s*(.{3,200})$", 1),
    (r"^\s*(\d+(?:\.\d+){0,3})\.?\s+([A-Z][^\n]{3,200})$", 0),
]
# Fixed value: what may number a heading of a page.
HEADING_NUMBER = r"^\s*(Article\s+\d+[a-z]?|Chapter\s+(?:\d+|[IVXLCDM]+)|Item\s+\d+[A-Z]?|\d+(?:\.\d+){0,3})\.?\s*[—:.\-]?\s*(.*)$"
FLAGS = "(?mdU)"


def detect_sections(text: Column) -> Column:
    """array<struct<heading, level, section_number, char_start, char_end>> by start; a section ends where the next begins.
    Where two patterns match at one place, the earlier pattern counts."""

    def by_pattern(order: int, pattern: str, level: int) -> Column:
        p = FLAGS + pattern

        def section(x: Column) -> Column:
            number = stripped(F.regexp_extract(x["m"], p, 1))
            depth = F.lit(level) if level else F.least(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1, F.lit(6))
            return F.struct(x["char_start"].alias("char_start"), F.lit(order).alias("o"), stripped(F.regexp_extract(x["m"], p, 2)).alias("heading"), depth.cast("int").alias("level"), number.alias("section_number"))

        return F.transform(match_spans(text, p), section)

    found = [by_pattern(i, pattern, level) for i, (pattern, level) in enumerate(PATTERNS)]
    ordered = F.array_sort(F.concat(*found))
    firsts = F.transform(F.array(ordered), lambda a: F.filter(a, lambda s, i: (i == 0) | (F.get(a, i - 1)["char_start"] != s["char_start"])))
    ended = F.transform(
        firsts,
        lambda a: F.transform(
            a,
            lambda s, i: F.struct(
                s["heading"].alias("heading"), s["level"].alias("level"), s["section_number"].alias("section_number"), s["char_start"].alias("char_start"),
                F.coalesce(F.get(a, i + 1)["char_start"], F.length(text)).alias("char_end"),
            ),
        ),
    )
    return F.get(ended, 0)


def heading_parts(heading: Column) -> tuple[Column, Column]:
    """Number and text of a heading; the whole heading is its text where nothing follows the number."""
    p = "(?dU)" + HEADING_NUMBER
    number, rest = stripped(F.regexp_extract(heading, p, 1)), stripped(F.regexp_extract(heading, p, 2))
    return number, F.when(heading.rlike(p) & (rest != ""), rest).otherwise(heading)


def page_texts(pages: DataFrame) -> DataFrame:
    """doc_id, full_text and pages of (doc_id, page_number, text) rows: stripped texts, each followed by a blank line;
    blank pages leave no trace. Pages of one document are one array; its texts make the document anyway."""
    kept = pages.select("doc_id", "page_number", F.concat(stripped(F.coalesce("text", F.lit(""))), F.lit("\n\n")).alias("block")).where(F.col("block") != "\n\n")
    whole = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "block"))).alias("b"))
    ends = lambda i: F.aggregate(F.slice("b", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x["block"]))
    spans = F.transform("b", lambda x, i: F.struct(x["page_number"].alias("page_number"), ends(i).alias("char_start"), ends(i + 1).alias("char_end")))
    return whole.select("doc_id", F.array_join(F.transform("b", lambda x: x["block"]), "").alias("full_text"), spans.alias("pages"))
