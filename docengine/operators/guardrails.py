"""Rule checks of answers against retrieved passages, as columns of one row per answer.

An answer row has module, query, answer and `top`: array<struct<score, content, doc_id, effective_date, filing_date>> in
rank order, the few passages that were retrieved for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import ANSWER_SENTENCE, stripped

# Words that carry no content, number phrases, unit words, words that ask for the present.
STOP_WORDS = (
    "the a an and or but of to in on for with as by from at that this these those is are was were be been being have has had "
    "do does did will would should could may might must it its their they them any such not if then than so no all some more most less"
).split()
NUMBER = r"(?i)\$\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:million|billion|trillion|m|bn|k))?|\d+(?:\.\d+)?\s*%|\b\d{4}\b|\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+\.\d+\b"
UNITS = r"million|billion|trillion|bn|m\b|k\b"
PRESENT = r"(?i)\b(current|currently|today|this year|now|latest|recent|present|upcoming|next year|future)\b"
OVERLAP, COVERAGE, YEARS, TOP, STALE = 3, 0.7, 2, 5, 3


def confidence(score: Column) -> Column:
    """From the best score: small scores over 1.5, larger ones over 15, within [0, 1]; 0 without passages."""
    return F.when(score.isNull() | (score <= 0), 0.0).when(score <= 1.5, F.least(score / 1.5, F.lit(1.0))).otherwise(F.least(score / 15, F.lit(1.0)))


def confidence_label(value: Column) -> Column:
    return F.when(value < 0.4, "low").when(value < 0.7, "medium").otherwise("high")


def content_words(text: Column) -> Column:
    """Distinct lower-case words of three characters or more that carry content."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\b[a-z][a-z0-9-]+\b"), F.lit(0))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3)), F.array(*map(F.lit, STOP_WORDS)))


def sentences(answer: Column) -> Column:
    return F.filter(F.transform(F.split(answer, ANSWER_SENTENCE), stripped), lambda s: s != "")


def unsupported(answer: Column, contents: Column) -> Column:
    """Sentences with OVERLAP content words or more of which no passage has that many."""
    words = F.transform(contents, content_words)

    def bad(s: Column) -> Column:
        own = content_words(s)
        return (F.size(own) >= OVERLAP) & ~F.exists(words, lambda w: F.size(F.array_intersect(own, w)) >= OVERLAP)

    return F.filter(sentences(answer), bad)


def coverage(answer: Column, contents: Column, bad: Column) -> Column:
    """Share of supported sentences: 0 without answer or passages, 1 without sentences."""
    n = F.size(sentences(answer))
    return F.when((F.coalesce(answer, F.lit("")) == "") | (F.size(contents) <= 0), 0.0).when(n == 0, 1.0).otherwise(1.0 - F.size(bad) / n)


def number_phrase(text: Column) -> Column:
    """A number phrase, or a text, without case, grouping, currency, blanks and units."""
    return F.regexp_replace(F.translate(stripped(F.lower(text)), ",$ ", ""), UNITS, "")


def numbers(answer: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(NUMBER), F.lit(0))


def checked_numbers(answer: Column, contents: Column) -> tuple[Column, Column]:
    """How many of an answer's numbers the passages hold, and those that they don't; zeros and blanks count as neither."""
    corpus = F.array_join(F.transform(contents, number_phrase), " ")
    counting = F.filter(numbers(answer), lambda x: ~number_phrase(x).isin("", "0"))
    return F.size(F.filter(counting, lambda x: F.contains(corpus, number_phrase(x)))), F.transform(F.filter(counting, lambda x: ~F.contains(corpus, number_phrase(x))), stripped)


def parsed_date(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.try_to_timestamp(text, F.lit("yyyy/MM/dd")).cast("date"))


def age(text: Column, today: Column) -> Column:
    """Years from a date to today; null if the text isn't a date."""
    return F.date_diff(today, parsed_date(text)) / 365.25


def _warning(severity: str, code: str, message: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))


def stale_warnings(top: Column, today: Column) -> Column:
    """One warning for each document and date field of the first TOP passages that is more than YEARS old."""

    def of(c: Column, field: str) -> Column:
        years = age(c[field], today)
        text = F.concat(F.lit("Passage of "), F.coalesce(c["doc_id"].cast("string"), F.lit("?")), F.lit(f" has {field}="), parsed_date(c[field]).cast("string"), F.lit(" ("), F.format_number(years, 1), F.lit(" years old); newer sources may exist."))
        return F.when(years > YEARS, F.struct(F.concat_ws(":", F.coalesce(c["doc_id"].cast("string"), F.lit("?")), F.lit(field)).alias("key"), text.alias("text")))

    found = F.flatten(F.transform(F.slice(top, 1, TOP), lambda c: F.array_compact(F.array(of(c, "effective_date"), of(c, "filing_date")))))
    keys = F.transform(found, lambda x: x["key"])
    firsts = F.filter(found, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.transform(firsts, lambda x: _warning("warning", "stale_source", x["text"]))


def asks_for_present(query: Column) -> Column:
    return F.coalesce(query.rlike(PRESENT), F.lit(False))


def temporal_mismatch(query: Column, top: Column, today: Column) -> Column:
    """The query asks for the present, but STALE of the first TOP passages or more are old in a date field."""
    old = F.filter(F.slice(top, 1, TOP), lambda c: F.coalesce(age(c["effective_date"], today) > YEARS, F.lit(False)) | F.coalesce(age(c["filing_date"], today) > YEARS, F.lit(False)))
    return asks_for_present(query) & (F.size(old) >= STALE)


def check(answers: DataFrame, today: Column | None = None) -> DataFrame:
    """answers with confidence, confidence_label, warnings, citation_coverage, unsupported_sentences, grounded_numbers and
    ungrounded_numbers. Numbers are checked for every module but `compliance`; without an answer the coverage is null."""
    today = F.current_date() if today is None else today
    contents = F.transform("top", lambda c: F.coalesce(c["content"], F.lit("")))
    given = F.coalesce("answer", F.lit("")) != ""
    none = F.array().cast("array<string>")
    bad = F.when(given & (F.size("top") > 0), unsupported(F.col("answer"), contents)).otherwise(none)
    grounded, loose = checked_numbers(F.col("answer"), contents)
    credit = given & (F.col("module") != "compliance")
    best = F.get("top", 0)["score"]
    df = answers.withColumns({"confidence": confidence(best), "unsupported_sentences": bad, "grounded_numbers": F.when(credit, grounded).otherwise(0), "ungrounded_numbers": F.when(credit, loose).otherwise(none)})
    df = df.withColumns({"confidence_label": confidence_label(F.col("confidence")), "citation_coverage": F.when(given, coverage(F.col("answer"), contents, F.col("unsupported_sentences")))})
    n = F.size("unsupported_sentences")
    whole = F.concat(n.cast("string"), F.when(F.col("module") == "compliance", F.concat(F.lit(" of "), (n + F.floor(F.col("citation_coverage") * 10)).cast("string"))).otherwise(F.lit("")), F.lit(" sentences have no passage that clearly supports them."))
    loose_text = F.concat(F.size("ungrounded_numbers").cast("string"), F.lit(" numbers do not appear in the passages: "), F.array_join(F.slice("ungrounded_numbers", 1, 5), ", "), F.when(F.size("ungrounded_numbers") > 5, " …").otherwise(""))
    first = F.array_compact(F.array(
        F.when((F.col("citation_coverage") < COVERAGE) & (n > 0), _warning("high", "low_citation_coverage", whole)),
        F.when(F.size("ungrounded_numbers") > 0, _warning("high", "ungrounded_numbers", loose_text)),
        F.when(F.col("confidence_label") == "low", _warning("warning", "low_retrieval_confidence", F.concat(F.lit("Best retrieval score: "), F.coalesce(F.format_number(best, 3), F.lit("no results"))))),
    ))
    last = F.array_compact(F.array(F.when(temporal_mismatch(F.col("query"), F.col("top"), today), _warning("warning", "temporal_mismatch", F.lit("The query asks for the present, but most passages are old.")))))
    return df.withColumn("warnings", F.concat(first, stale_warnings(F.col("top"), today), last))


def has_high_severity(warnings: Column) -> Column:
    return F.exists(warnings, lambda w: w["severity"] == "high")


def as_record(report: DataFrame) -> Column:
    """A report as a struct with rounded ratios, for logs."""
    return F.struct(F.round("confidence", 3).alias("confidence"), "confidence_label", "warnings", F.round("citation_coverage", 3).alias("citation_coverage"), "unsupported_sentences", "grounded_numbers", "ungrounded_numbers")
