"""The query log: one JSON line for each query, appended; reading it back drops what isn't JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREVIEW = 300
RECORD = (
    "query_id string, timestamp_utc string, query string, config map<string,string>, transformed_queries array<string>, timings map<string,double>, "
    "top_chunks array<struct<chunk_id:string,score:double,doc_id:string,section_title:string,section_number:string,char_start:int,char_end:int,content_preview:string>>, "
    "answer string, guardrail_report string, _corrupt_record string"
)


def chunk_for_log(c: Column) -> Column:
    """A retrieved chunk's eight log fields."""
    return F.struct(
        c["chunk_id"].alias("chunk_id"), c["score"].cast("double").alias("score"), c["doc_id"].cast("string").alias("doc_id"), c["section_title"].alias("section_title"), c["section_number"].alias("section_number"),
        c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), F.substring(F.coalesce(c["content"], F.lit("")), 1, PREVIEW).alias("content_preview"),
    )


def records(results: DataFrame) -> DataFrame:
    """Log records of results (query, config, transformed_queries, timings, top, answer, report), with new ids and the time.
    Results that carry a query_id keep it."""
    own = F.col("query_id").cast("string") if "query_id" in results.columns else F.uuid()
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return results.select(own.alias("query_id"), stamp.alias("timestamp_utc"), "query", "config", "transformed_queries", "timings", F.transform("top", chunk_for_log).alias("top_chunks"), "answer", F.to_json("report").alias("guardrail_report"))


def append(results: DataFrame, path: str) -> None:
    records(results).write.mode("append").json(path)


def tail(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The last n records by time; lines that aren't JSON are dropped."""
    read = spark.read.schema(RECORD).option("mode", "PERMISSIVE").json(path)
    return read.where("_corrupt_record is null").drop("_corrupt_record").orderBy(F.desc("timestamp_utc"), "query_id").limit(n)
