"""The corpus pipeline: five operators in a row over `documents`, each stage's rows written and read again.

1. toxicity: documents that the subsequence-kernel machine, trained on the stage's labelled documents, rejects go.
2. near_dedup: one document of each near-duplicate component stays (five-word runs, similarity 0.8 or more).
3. decontamination: documents that leak a benchmark item go.
4. pii: spans of personal data give way to their kind in angle brackets; n_chars follows.
5. byte_bpe: texts become token ids; `text` is what the ids decode to.

All stages but the last return the columns that they got. Nulls: a null text is not toxic, has no duplicate, leaks and
hides nothing, and encodes to no ids and an empty text; rows with null ids stay unless their own text rejects them.
`run` leaves the rows of the stages before the last in the shared folder, as its result is read from them; a caller that
writes the result inside `staging.scratch` has them deleted.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, decontamination, neardup, pii, toxicity
from docengine.llm.queries import BPE_RANKS, table
from docengine.llm.staging import kept, scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else masked


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, public_tokenizers.path(BPE_RANKS))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Training a machine can't be put in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # the operators' own tables go when the stage's rows are written
            docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
