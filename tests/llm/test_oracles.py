"""The queries with SQL give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from tallyroll.llm import oracles, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ALL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    cur = con.execute(oracles.ALL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())
    want = sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert got == want
