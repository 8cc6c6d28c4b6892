import pytest
from compare import same
from pyspark.sql import functions as F

from siltstone.plans import registry
from siltstone.sources.parsers import parse_brave


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    if name in registry.ORACLES:
        same(df, registry.ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_brave_keeps_short_titles(spark, sf, tmp_path):
    """Titles without letters and of one; only a title's first place leaves the snippet; without any title the URL stands for it."""
    title = F.when(F.col("page_id") % 3 == 0, "<h1>.").when(F.col("page_id") % 3 == 1, "<h1>e").otherwise("<h1>ab")
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.withColumn("html", F.regexp_replace("html", F.lit("(?is)<h1[^>]*>.*?(?=</h1>)"), title)).write.parquet(f"{tmp_path}/pages.parquet")
    made = tmp_path / "tables"
    made.mkdir()
    next((tmp_path / "pages.parquet").glob("*.parquet")).rename(made / "pages.parquet")
    df = registry.QUERIES["brave_parse"](spark, str(made))
    assert {"T", "Te", "Tab"} <= {r.title for r in df.collect()}
    same(df, registry.ORACLES["brave_parse"], str(made))
    page = '<a href="https://a.example/"><div class="title">To</div>Tom and To</a><a href="https://c.example/"><img></a>'
    found = {r.url: (r.title, r.snippet) for r in parse_brave(spark.createDataFrame([("q", page)], "query_id string, page string")).collect()}
    assert found == {"https://a.example/": ("To", "Tom and To"), "https://c.example/": ("https://c.example/", "")}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
