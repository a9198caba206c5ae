"""Encoders: dense vectors from a pluggable embedder, term postings with BM25 or saturated weights."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.arrays import normalised, truncated
from docengine.functions.text import stripped

#: Full width of the default embedder and the widths that its vectors can be cut to.
FULL, DIMS = 64, (8, 16, 32, 48, 64)
QUERY_PROMPT = "query: "
K1, B = 1.2, 0.75
WORD = "[^a-z0-9]+"


@lru_cache(maxsize=200_000)
def _component(word: str) -> tuple[int, int]:
    h = hashlib.blake2b(word.encode(), digest_size=8).digest()
    return int.from_bytes(h[:4], "little"), 1 if h[4] & 1 else -1


def hashing_embedder(texts: list[str], dim: int = FULL) -> np.ndarray:
    """The offline default: words hashed to signed components, rows of unit length. A neural model fits the same interface.
    Each distinct word of a batch is hashed once, and all texts' components are summed at once."""
    found = [re.findall(r"\w+", (t or "").lower()) for t in texts]
    words = [w for ws in found for w in ws]
    codes, distinct = pd.factorize(np.array(words, object)) if words else (np.zeros(0, np.int64), [])
    parts = np.array([_component(w) for w in distinct], np.int64).reshape(-1, 2)
    rows = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
    at = rows * dim + parts[codes, 0] % dim if words else rows
    out = np.bincount(at, parts[codes, 1] if words else None, minlength=len(texts) * dim).reshape(len(texts), dim)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def embed(texts: DataFrame, text: str, into: str = "embedding", embedder: Callable[[list[str]], np.ndarray] = hashing_embedder, prompt: str = "") -> DataFrame:
    """texts with a vector column; the model is loaded once in a worker, batches are Arrow's. Queries have a prompt first.
    Only the text goes to Python, and what doesn't read the vectors runs no model."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder([prompt + (t or "") for t in batch])), dtype=object)

    vectors = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    return texts.select(*(c for c in texts.columns if c != into), vectors(F.col(text)).alias(into))


def at_dim(vector: Column, dim: int, dims: tuple[int, ...] = DIMS) -> Column:
    """The vector cut to one of the allowed widths."""
    return truncated(vector, dim, dims)


def all_dims(vectors: DataFrame, vector: str = "embedding", dims: tuple[int, ...] = DIMS) -> DataFrame:
    """A column for each allowed width, from one full vector."""
    return vectors.withColumns({f"{vector}_{d}": at_dim(F.col(vector), d, dims) for d in dims})


def unit(vector: Column) -> Column:
    return normalised(vector)


def terms(text: Column) -> Column:
    """Lower-case words of letters a-z and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD), lambda w: w != "")


def postings(docs: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """(key, term, tf, dl): one row for each distinct term of a text, with its length in terms; of the terms of `wanted`
    only, if given, which thin the rows out before they are shuffled. Texts without such terms have no rows."""
    words = docs.select(key, terms(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.explode_outer("w").alias("term")).where("term is not null")  # outer: a plain one infers a filter that splits each text again
    if wanted is not None:
        words = words.join(wanted, "term", "left_semi")
    return words.groupBy(key, "term").agg(F.count("*").cast("int").alias("tf"), F.first("dl").alias("dl"))


def counted_terms(docs: DataFrame, key: str, text: str, wanted: DataFrame | None = None) -> DataFrame:
    """postings, and for each text a row with tf 0 and its length: what the statistics need, from the same pass.

    Rows are told apart by tf, which is an aggregate, so all parts of a plan share one shuffle of them.
    """
    words = docs.select(key, terms(F.col(text)).alias("w")).select(key, F.size("w").alias("dl"), F.explode_outer(F.concat("w", F.array(F.lit("")))).alias("term"))
    if wanted is not None:
        words = words.join(wanted, "term", "left_semi")
    return words.groupBy(key, "term").agg(F.count_if(F.col("term") != "").cast("int").alias("tf"), F.first("dl").alias("dl"))


def statistics_of(counted: DataFrame) -> DataFrame:
    """One row from counted_terms: n, the number of texts, and avgdl, their mean length in terms."""
    return counted.where("tf = 0").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Saturated term frequency with length normalisation, without idf."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def learned_weight(tf: Column, idf_: Column) -> Column:
    """The offline default for learned sparse weights: log-saturated frequency times rarity."""
    return F.log1p(tf.cast("double")) * idf_


def clean_query(query: Column) -> Column:
    return stripped(F.coalesce(query, F.lit("")))
