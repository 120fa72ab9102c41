"""Tables whose rows share what lookups and joins go by, each query against its SQL."""

import duckdb
import pytest
from conftest import same

from startline.plans import catalog
from startline.sources import lookups

LINK = '<a href="/%s">x</a>'
#: Two pages of one address with other links, a page alone, one without text and one without an address.
PAGES = [
    (1, "https://a.example/x", LINK % "one" + LINK % "both"), (2, "https://a.example/x", LINK % "both" + LINK % "two!"), (3, "https://a.example/y", LINK % "y"),
    (4, "https://a.example/z", None), (6, None, LINK % "n"), (8, "https://a.example/x", None), (9, "https://a.example/x", LINK % "n9"), (12, "https://a.example/y", ""),
]


@pytest.mark.parametrize("name", ["candidate_links", "fetch_fallback", "liveness_probe", "missing_links"])
def test_pages_that_share_an_address(spark, tmp_path, name):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(catalog.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(catalog.oracle_sql()[name]).df())


def test_a_lookup_adds_no_requests(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("b",)], "url string")
    pages = spark.createDataFrame([("a", m, [], "h", "a") for m in ("n", "m", "n")], lookups.PAGES)
    got = lookups.fetch(asked, pages, pages)
    assert sorted(tuple(r) for r in got.select("url", "markdown", "fetched").collect()) == [("a", "m", True), ("a", "m", True), ("b", None, False)]
    probes = spark.createDataFrame([("a", 405, 410), ("a", 200, None)], lookups.PROBES)
    assert sorted(tuple(r) for r in lookups.liveness(asked, probes).collect()) == [("a", 200), ("a", 200), ("b", None)]
