"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, text, label 0/1) of at most `bound` labelled rows outside the held-out fold, chosen by a hash of the id.

    Repeated label rows of one id count once, with the largest label; null labels and null ids are left out, and so are
    ids without a document. A repeated document is learned from once; of an id's different texts, the one whose hash is
    smallest. Labels other than 0 count as 1; ids keep their type, whatever it is.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", modulus) != held_out))
        .groupBy("doc_id").agg(F.max((F.col(label) != 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(bound)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = found.join(F.broadcast(ids), "doc_id")  # `bound` rows at most
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label"))
