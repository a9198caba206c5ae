"""Filing listings: columnar JSON to rows, selection, names, periods, and manifests of what was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Where listed documents stand, and the item of an earnings release.
ARCHIVE = "https://www.sec.gov/Archives/edgar/data"
EARNINGS_FORM, EARNINGS_ITEM = "8-K", "2.02"
LISTING = (
    "cik string, filings struct<recent:struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,"
    "primaryDocument:array<string>,primaryDocDescription:array<string>,items:array<string>>>"
)


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik.cast("string"), 10, "0")


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LISTING).option("multiLine", True).json(path)


def filings(listings: DataFrame) -> DataFrame:
    """A row for each filing of a listing; missing trailing entries are empty."""
    r = "filings.recent."
    zipped = F.arrays_zip(*(F.col(r + c).alias(c) for c in ("form", "accessionNumber", "filingDate", "reportDate", "primaryDocument", "primaryDocDescription", "items")))
    rows = listings.select("cik", F.posexplode(zipped).alias("listing_no", "f")).where(F.col("f.form").isNotNull())
    some = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    return rows.select(
        "cik", "listing_no", F.col("f.form").alias("form"), F.col("f.accessionNumber").alias("accession"), F.col("f.filingDate").alias("filing_date"), some("reportDate").alias("report_date"),
        F.col("f.primaryDocument").alias("primary_doc"), some("primaryDocDescription").alias("primary_doc_desc"), some("items").alias("items"),
    )


def select_filings(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """The latest filings of each form, as many as the quotas (cik, form, quota) say; of EARNINGS_FORM earnings releases
    only. Filings of one day keep the listing's order."""
    kept = rows.where((F.col("form") != EARNINGS_FORM) | F.contains("items", F.lit(EARNINGS_ITEM)))
    order = W.partitionBy("cik", "form").orderBy(F.desc("filing_date"), "listing_no")
    return kept.join(quotas, ["cik", "form"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("quota")).drop("quota")


def filing_url(cik: Column, accession: Column, primary_doc: Column) -> Column:
    return F.concat_ws("/", F.lit(ARCHIVE), cik.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), primary_doc)


def base_name(ticker: Column, form: Column, filing_date: Column, accession: Column) -> Column:
    return F.concat_ws("_", ticker, F.translate(form, "/", "_"), filing_date, F.replace(accession, F.lit("-"), F.lit("")))


def doc_type(form: Column) -> Column:
    return F.replace(F.lower(form), F.lit("-"), F.lit(""))


def fiscal_period(report_date: Column) -> tuple[Column, Column]:
    """Year and quarter of a year-month-day text; null where it isn't one."""
    parts = F.split(report_date, "-")
    y, m = F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")
    good = (F.size(parts) == 3) & y.isNotNull() & m.isNotNull()
    return F.when(good, y), F.when(good, F.floor((m - 1) / 3).cast("int") + 1)


def extension(primary_doc: Column) -> Column:
    found = F.lower(F.regexp_extract(primary_doc, r"\.([^./]+)$", 1))
    return F.when(found == "", "htm").otherwise(found)


def not_yet_fetched(wanted: DataFrame, present: DataFrame, key: str = "doc_id") -> DataFrame:
    """Skip what is there already, if it isn't empty."""
    return wanted.join(present.where(F.col("n_bytes") > 0).select(key), key, "left_anti")


def manifest(results: DataFrame) -> DataFrame:
    """Counts of fetches (success, skipped, n_bytes) and the bytes of those that succeeded."""
    return results.agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_success"), F.count_if("skipped").alias("n_skipped"), F.count_if(~F.col("success")).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("n_bytes"))), F.lit(0)).alias("total_bytes"),
    )


def paired_files(raw: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Raw files (path) with their sidecars (path, metadata) of the same stem; of several raw files the first by path."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.meta)?\.[^./]+$", 1)
    first = raw.groupBy(stem(F.col("path")).alias("stem")).agg(F.min("path").alias("path"))
    return first.join(sidecars.select(stem(F.col("path")).alias("stem"), "metadata"), "stem")
