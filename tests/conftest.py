import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    """A value in one form, whether Spark or DuckDB gave it."""
    import datetime
    import decimal
    import math

    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (decimal.Decimal, float)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def same_rows(df, con, sql):
    """Do a frame and a SQL query have the same columns and the same rows in any order."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    theirs = sorted((str([plain(v) for _, v in sorted(zip(names, row))]) for row in result.fetchall()))
    ours = sorted(str([plain(v) for _, v in sorted(row.asDict().items())]) for row in df.collect())
    assert len(ours) == len(theirs)
    assert ours == theirs
