"""The test tables in the shapes of the domain: transfers, roll, dated events, pairs, two snapshots.

Each adapter exists twice, as a DataFrame and as a SQL text, from the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DEED_COLUMNS = {
    "record_id": "o_orderkey",
    "opa_account_num": "CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_custkey AS {text}) END",
    "has_opa_link": "o_orderkey % 50 <> 0",
    "zip_code": "concat('191', lpad(CAST(c_nationkey AS {text}), 2, '0'), '-0001')",
    "sale_date": "CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END",
    "sale_price": "CASE WHEN o_orderkey % 31 = 0 THEN 1.0E0 WHEN o_orderkey % 37 = 0 THEN o_totalprice / 100.0E0 ELSE o_totalprice END",
    "is_nominal": "o_orderkey % 31 = 0",
    "is_multi_parcel": "o_orderkey % 41 = 0",
    "deed_kind": "CASE WHEN o_orderkey % 13 = 0 THEN 'sheriff' WHEN o_orderkey % 17 = 0 THEN 'land_bank' WHEN o_orderpriority = '5-LOW' THEN 'miscellaneous' ELSE 'standard' END",
    "grantors": "concat('Smith ', c_mktsegment, CASE WHEN o_orderkey % 7 = 0 THEN ' Holdings LLC' ELSE '' END)",
    "grantees": "CASE WHEN o_orderkey % 11 = 0 THEN 'Jones and Smith' WHEN o_orderkey % 5 = 0 THEN 'First Trust Bank' WHEN o_orderkey % 19 = 0 THEN CAST(NULL AS {text}) ELSE 'Mary Brown' END",
}
ROLL_COLUMNS = {
    "parcel_number": "CAST(c_custkey AS {text})",
    "category_code_description": "c_mktsegment",
    "total_livable_area": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE floor(abs(c_acctbal)) END",
}
SALE_COLUMNS = {
    "sale_id": "o_orderkey",
    "parcel_id": "o_custkey",
    "block": "CAST(floor(o_custkey / 8) AS BIGINT)",
    "sale_date": "CAST(o_orderdate AS DATE)",
    "sale_price": "o_totalprice",
    "area": "CAST(300 + (o_custkey * 37) % 2500 AS DOUBLE)",
    "x_m": "CAST((o_custkey * 7919) % 10007 AS DOUBLE)",
    "y_m": "CAST((o_custkey * 104729) % 10009 AS DOUBLE)",
}
PAIR_COLUMNS = {
    "brand": "p_brand",
    "flag": "l_returnflag",
    "line": "l_orderkey * 10 + l_linenumber",
    "est": "p_retailprice * l_quantity",
    "price": "l_extendedprice",
}
EVENT_COLUMNS = {
    "event_id": "l_orderkey * 10 + l_linenumber",
    "parcel_id": "o_custkey",
    "issued": "CAST(l_shipdate AS DATE)",
    "closed": "CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS DATE) + CAST(l_quantity * 20 AS INT) END",
    "kind": "CASE WHEN l_returnflag = 'A' THEN 'Major Alteration' WHEN l_returnflag = 'R' THEN 'Change of Use' ELSE 'Sign' END",
    "state": "l_linestatus",
    "severe": "l_tax > 0.04E0",
}


def _columns(columns: dict[str, str], text: str) -> list[str]:
    return [f"{e.format(text=text)} AS {n}" for n, e in columns.items()]


def _sql(columns: dict[str, str], source: str) -> str:
    return f"SELECT {', '.join(_columns(columns, 'VARCHAR'))} FROM {source}"


def deeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), on=_eq("o_custkey", "c_custkey"), how="inner")
    return both.selectExpr(*_columns(DEED_COLUMNS, "STRING"))


def roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(*_columns(ROLL_COLUMNS, "STRING"))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_columns(SALE_COLUMNS, "STRING"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part"), on=_eq("l_partkey", "p_partkey"), how="inner")
    return both.selectExpr(*_columns(PAIR_COLUMNS, "STRING"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), on=_eq("l_orderkey", "o_orderkey"), how="inner")
    return both.selectExpr(*_columns(EVENT_COLUMNS, "STRING"))


def _eq(a: str, b: str):
    from pyspark.sql import functions as F

    return F.col(a) == F.col(b)


DEEDS = _sql(DEED_COLUMNS, "orders JOIN customer ON o_custkey = c_custkey")
ROLL = _sql(ROLL_COLUMNS, "customer")
SALES = _sql(SALE_COLUMNS, "orders")
PAIRS = _sql(PAIR_COLUMNS, "lineitem JOIN part ON l_partkey = p_partkey")
EVENTS = _sql(EVENT_COLUMNS, "lineitem JOIN orders ON l_orderkey = o_orderkey")
