"""Every query with a SQL twin gives DuckDB's rows on the smallest tables; plans stay free of nested loops."""

import duckdb
import pytest

from tallyroll.plans import all_queries, all_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


#: Its first level is the whole table, so one side of that join is a single row.
ONE_ROW = {"mdl_hierarchical"}


def assert_no_nested_loop(name, df):
    if name in ONE_ROW:
        return
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = all_queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(all_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds or set(kinds.values()) - set(TYPES.values()) <= {"DATE"}
    at = [names.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in at) for r in cur.fetchall())
    assert got == want
    assert_no_nested_loop(name, df)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_without_sql_has_rows(spark, name):
    df = all_queries()[name](spark, SF)
    rows = df.collect()
    assert df.columns and rows and not any(all(v is None for v in r) for r in rows)
    assert_no_nested_loop(name, df)
