"""Tables that stand for vector collections and JSON-lines files: naming, creation, upserts, idempotent loads, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Modules and their chunking strategies.
REGISTRY = {"compliance": ("regulatory_boundary", "semantic", "hierarchical"), "credit": ("financial_statement", "semantic", "narrative_section")}


def collection_name(module: str, strategy: str, prefix: str = "") -> str:
    return "_".join(p for p in (prefix, module, strategy) if p)


def collections(spark: SparkSession, prefix: str = "") -> DataFrame:
    """(module, chunk_strategy, collection) of all collections."""
    rows = [(m, s, collection_name(m, s, prefix)) for m, strategies in REGISTRY.items() for s in strategies]
    return spark.createDataFrame(rows, "module string, chunk_strategy string, collection string")


def ensure(spark: SparkSession, path: str, schema: T.StructType, recreate: bool = False) -> str:
    """Make an empty table where there is none, or anew: created, skipped or recreated."""
    there = exists(spark, path)
    if there and not recreate:
        return "skipped"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return "recreated" if there else "created"


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Which tables aren't there."""
    return [p for p in paths if not exists(spark, p)]


def merged(present: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """present with the rows of new in place of those with their keys; of new rows with one key the last by all columns."""
    order = W.partitionBy(key).orderBy(F.desc(F.to_json(F.struct("*"))))
    latest = new.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k")
    return present.join(latest.select(key), key, "left_anti").select(present.columns).unionByName(latest.select(present.columns))


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def recover(spark: SparkSession, path: str) -> None:
    """Finish an upsert that broke off between its two renames: the whole new table takes the place of the one set aside."""
    fs, at = _fs(spark, path)
    beside, aside = path.rstrip("/") + ".next", path.rstrip("/") + ".old"
    if not exists(spark, path) and exists(spark, aside):
        fs.rename(at(beside if exists(spark, beside + "/_SUCCESS") else aside), at(path))
    fs.delete(at(aside), True)


def upsert(spark: SparkSession, path: str, new: DataFrame, key: str = "chunk_id") -> None:
    """Write merged rows beside the table, set the old one aside, and put the new one in its place. A job that fails leaves
    the table as it was; one that breaks off between the renames is finished by the next call (`recover`)."""
    recover(spark, path)
    if not exists(spark, path):
        merged(new.where("false"), new, key).write.parquet(path)
        return
    beside, aside = path.rstrip("/") + ".next", path.rstrip("/") + ".old"
    merged(spark.read.parquet(path), new, key).write.mode("overwrite").parquet(beside)
    fs, at = _fs(spark, path)
    fs.rename(at(path), at(aside))
    fs.rename(at(beside), at(path))
    fs.delete(at(aside), True)


def load(spark: SparkSession, path: str, chunks: DataFrame, key: str = "chunk_id", force: bool = False) -> str:
    """Upsert unless the table has as many rows already: loaded or skipped."""
    if not force and exists(spark, path) and spark.read.parquet(path).count() >= chunks.count():
        return "skipped"
    upsert(spark, path, chunks, key)
    return "loaded"


def payload(chunks: DataFrame) -> DataFrame:
    """A point's payload: everything but its id and its vectors."""
    return chunks.drop("chunk_id", "embedding")


def vectors(spark: SparkSession, path: str, column: str = "embedding") -> DataFrame:
    """One vector column of a table; no other column is read."""
    return spark.read.parquet(path).select(column)


def write_jsonl(df: DataFrame, path: str, by: tuple[str, ...] = (), drop_nulls: bool = True) -> None:
    """JSON lines, in folders by `by`; nulls are left out, or written."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", drop_nulls)
    (writer.partitionBy(*by) if by else writer).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a declared schema; lines that aren't JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON results, or no rows where the file is missing; malformed ones read as nulls."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def json_array(df: DataFrame, order: str, most: int = 100_000) -> DataFrame:
    """All rows as one JSON array text, for small result files: passages, question pairs. More than `most` are an error."""
    some = df.limit(most + 1)
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct("*").alias("r"))))
    text = F.to_json(F.transform(rows, lambda x: x["r"]))
    return some.agg(F.when(F.count("*") <= most, text).otherwise(F.raise_error(F.lit(f"a JSON array of more than {most} rows"))).alias("json"))


def new_documents(parsed: DataFrame, present: DataFrame) -> DataFrame:
    """Documents that aren't there yet, to be appended."""
    return parsed.join(present.select("doc_id"), "doc_id", "left_anti")


def load_all(spark: SparkSession, root: str, chunks: DataFrame, prefix: str = "", force: bool = False) -> dict[str, str]:
    """Load each collection of the registry from a chunk table, one after the other; the first failure ends it."""
    done = {}
    for module, strategies in REGISTRY.items():
        for strategy in strategies:
            name = collection_name(module, strategy, prefix)
            own = chunks.where((F.col("module") == module) & (F.col("chunk_strategy") == strategy))
            done[name] = load(spark, f"{root.rstrip('/')}/{name}", own, force=force)
    return done
