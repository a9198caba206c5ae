"""Frames that the registered queries share: documents with structure, chunk tables, query sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import count_tokens
from docengine.sources.sections import detect_sections

EMPTY_PAGES = "array<struct<page_number:int,char_start:int,char_end:int>>"


#: Tables whose rows cost much more to work on than to move.
TEXTS = ("documents", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores where a small input comes in fewer partitions; larger inputs are never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as parsed documents: each line is a paragraph that begins with `Item n.`, sections are detected from that,
    and every seventh line counts as a table."""
    docs = table(spark, sf_dir, "documents")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: F.concat(F.lit("Item "), (i + 1).cast("string"), F.lit(". "), line))
    df = docs.select("doc_id", "lang", "source", lines.alias("lines")).withColumn("full_text", F.array_join("lines", "\n\n"))
    start = lambda i: F.aggregate(F.slice("lines", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 2)
    tables = F.transform(F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: i % 7 == 3), lambda i: F.struct(F.get("lines", i).alias("markdown"), start(i).alias("char_start"), (start(i) + F.length(F.get("lines", i))).alias("char_end"), F.lit(1).alias("n_rows"), F.lit(1).alias("n_cols")))
    return df.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("doc_title"), F.col("lang").alias("doc_type"), F.lit("credit").alias("module"),
        F.create_map(F.lit("jurisdiction"), "lang", F.lit("company_ticker"), "source").alias("metadata"), "full_text", F.array().cast(EMPTY_PAGES).alias("pages"),
        detect_sections(F.col("full_text")).alias("sections"), tables.alias("tables"), F.length("full_text").alias("n_chars"),
    )


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks, one each: chunk_id, doc_id, content, offsets, and the source as a filter column."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"), F.lit(0).alias("char_start"), F.length(F.coalesce("text", F.lit(""))).alias("char_end"), "source", "lang", count_tokens(F.col("text")).alias("content_tokens"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector as a query."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads: in spark.checkpoint.dir, else in the warehouse; both are shared."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
