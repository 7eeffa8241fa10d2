"""Every catalogue query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomtext.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in at) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_its_sql(spark, oracle, name):
    df = catalogue.queries()[name](spark, SF)
    found = oracle.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, want)


def test_queries_without_sql_run(spark):
    names = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert names == {"seed_cover"}
    for name in names:
        assert catalogue.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize(("name", "text", "times"), [("function_word_counts", "FileScan", 1), ("function_word_counts", "regexp_extract_all", 1), ("keyword_matches", "regexp_extract_all", 1), ("route_rows", "RLIKE", 3), ("split_public", "RLIKE", 0)])
def test_plans_scan_and_match_once(spark, name, text, times):
    """Patterns run once a row, and not again for each column or view that is read."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(text) == times
