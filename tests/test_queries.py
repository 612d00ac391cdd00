"""Every query with a DuckDB counterpart gives the same rows, columns and values."""

import math
import os
import re

import duckdb
import pytest

from talentweave.plans import catalog, registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalog.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_duckdb(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(map(plain, r)) for r in duck.sql(f"select {', '.join(columns)} from ({registry.oracle_sql()[name]})").fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_counterpart_runs_alike_twice(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = lambda: sorted(map(repr, registry.queries()[name](spark, SF).collect()))
    assert df.columns and rows() == rows()


@pytest.mark.parametrize("name", ["entity_extract", "query_entities", "title_match", "two_means", "wrapped_lines", "headers_to_sections", "rule_sections", "bullets_and_blocks", "glued_roles"])
def test_query_reads_whole_tables_and_texts(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan for x in ("<= 2000)", "<= 200)", "<= 400)", "<= 300)", "% 5) = 0)", "% 10) = 0)"))
    assert not re.search(r"substring\(text#\d+, 1, (20|30)\)", plan)
