"""Each query against its SQL in DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

from vellumine.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    got = catalogue.QUERIES[name](spark, SF)
    assert got.count() > 0


def test_pages_as_files_have_the_same_text(spark):
    """Decoded in Python and by Column functions: the same paragraphs of every page."""
    from pyspark.sql import functions as F

    files = catalogue.QUERIES["extract_pages"](spark, SF).where("kind is not null")
    one = {(r.path, r.block_index): r.text for r in files.select("path", "block_index", "text").collect()}
    two = {(f"{r.page_id}.html", r.block_index): r.text for r in catalogue.QUERIES["html_blocks"](spark, SF).select("page_id", F.col("block_index"), "text").collect()}
    assert {k[0] for k in one} == {k[0] for k in two}
    assert one == two
