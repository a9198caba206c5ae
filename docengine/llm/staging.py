"""Tables written between the steps of an operator, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a folder of the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return (folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged").rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """df as written to Parquet in the shared folder: computed once, lineage cut, and not lost with an executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end, so what lives on must be staged or collected by `kept` before, or be read
    up by then. Scopes nest; a scope around a whole run leaves nothing behind:

        with scratch(spark):
            corpus_pipeline.run(spark, folder).write.parquet(out)
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame) -> DataFrame:
    """df staged in the scope around the innermost one: it outlives the tables that it is made of."""
    inner = _scopes.pop()
    try:
        return staged(df)
    finally:
        _scopes.append(inner)
