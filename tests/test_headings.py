"""Headings of pages are whole, as page_headings' SQL has them."""

import duckdb

from docengine.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import same_rows


def test_numbers_and_unended_references_stay(spark, tmp_path):
    titles = ["56.187.231.175 Keit in lich", "4501042323994846 Anth", "3.1 Rates &amp; fees", "cut off &amp", "R&D &lt;b&gt; &#39;x&#39; &quot;y&quot;", "&amp;lt; &ampx &amp1;", "  ", "two\n  lines"]
    rows = [(i, f"<html><body><h1>{t}</h1><p>Item 1. text</p></body></html>") for i, t in enumerate(titles)] + [(90, "<p>Item 2. no heading</p>"), (91, None), (92, "")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = QUERIES["page_headings"](spark, str(tmp_path))
    same_rows(found, con, ORACLE_SQL["page_headings"])
    assert {r.page_id: r.heading for r in found.collect()}[0] == titles[0]
