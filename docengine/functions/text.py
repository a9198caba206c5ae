"""Text functions as columns: spans of sentences and paragraphs, token counts, names, stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.arrays import block_sums, let, prefix_sum

# Boundaries of sentences in documents, of sentences in passages and answers, and of paragraphs.
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z\"'(\[])"
ANSWER_SENTENCE = r"(?<=[.!?])\s+(?=[A-Z\"'(])"
PARAGRAPH = r"\n\s*\n"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def count_tokens(text: Column) -> Column:
    """The default token counter: words and single signs; null counts 0. Any other counter of type text -> int fits in."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def split_spans(text: Column, boundary: str, base: Column | int = 0) -> Column:
    """array<struct<text, char_start, char_end>> of what stands between the boundaries, in code points of the document.

    Pieces are stripped and blank ones left out. A span begins at its first visible character and ends where the boundary
    begins, or at the end of the text. `base` is the offset of `text` in its document.
    """
    base = base if isinstance(base, Column) else F.lit(base)
    parts = F.struct(F.split(text, boundary, -1).alias("p"), F.regexp_extract_all(text, F.lit(boundary), F.lit(0)).alias("g"))
    lengths = lambda x: F.flatten(F.zip_with(x["p"], x["g"], lambda p, g: F.array(F.length(p).cast("long"), F.coalesce(F.length(g), F.lit(0)).cast("long"))))

    def summed(x: Column) -> Column:
        return let(lengths(x), lambda n: spans(F.struct(x["p"].alias("p"), n.alias("n"), block_sums(n).alias("s"))))

    def spans(bound: Column) -> Column:
        return let(bound, located)

    def located(x: Column) -> Column:
        def span(p: Column, i: Column) -> Column:
            return let(
                base + prefix_sum(x["n"], x["s"], 2 * i),
                lambda at: F.struct(
                    stripped(p).alias("text"),
                    (at + F.length(p) - F.length(F.regexp_replace(p, r"(?U)^\s+", ""))).cast("int").alias("char_start"),
                    (at + F.length(p)).cast("int").alias("char_end"),
                ),
            )

        return F.filter(F.transform(x["p"], span), lambda s: s["text"] != "")

    return let(parts, summed)


def sentence_spans(text: Column, base: Column | int = 0, boundary: str = SENTENCE) -> Column:
    return split_spans(text, boundary, base)


def paragraph_spans(text: Column, base: Column | int = 0) -> Column:
    return split_spans(text, PARAGRAPH, base)


def counted(spans: Column) -> Column:
    """Spans with n_tokens."""
    return F.transform(spans, lambda s: F.struct(s["text"].alias("text"), s["char_start"].alias("char_start"), s["char_end"].alias("char_end"), count_tokens(s["text"]).alias("n_tokens")))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(doc_id: Column, strategy: Column, index: Column) -> Column:
    return uuid5(F.concat_ws("|", doc_id.cast("string"), strategy, index.cast("string")))


def alpha_ratio(text: Column) -> Column:
    """Share of letters among the characters."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]+", "")) / F.greatest(F.length(text), F.lit(1))


def preview(text: Column, n: int = 80) -> Column:
    """One line of at most n characters, with an ellipsis where it was cut."""
    line = stripped(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("…"))).otherwise(line)
