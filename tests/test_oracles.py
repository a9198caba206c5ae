"""Every query with SQL gives the SQL's rows; every other one runs."""

import pytest

from docengine.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_modules_need_no_session_to_be_imported():
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > len(e.oracle_sql()) > 60"], check=True, timeout=120)


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
