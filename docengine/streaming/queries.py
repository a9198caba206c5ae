"""Streams of queries: each micro-batch runs the query lifecycle and is appended to the log; and a replay of a log's counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docengine.plans.run_query import Config, log_rows, run
from docengine.sources.querylog import append

INCOMING = "query_id string, query string, asked timestamp"


def incoming(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Queries as JSON files arrive in a folder."""
    return spark.readStream.schema(INCOMING).option("maxFilesPerTrigger", files_per_batch).json(path)


def serve(stream: DataFrame, chunks: DataFrame, config: Config, log: str, checkpoint: str, responses: DataFrame | None = None, then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Run each micro-batch of queries as one plan and append its records to the log. What has arrived is worked off, then
    the query ends; with the checkpoint the next call goes on where it stopped. A batch that fails is run again, so a log
    may have records twice, with one query_id."""

    def batch(queries: DataFrame, number: int) -> None:
        results = run(queries, chunks, config, responses)
        append(log_rows(results, config), log)
        if then is not None:
            then(results, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def volumes(stream: DataFrame, time: str = "asked", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Queries in each window; rows later than `late` are dropped, so state stays bounded. An extra."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")
