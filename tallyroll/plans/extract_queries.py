"""Staging of the public-record extracts, over orders and customers in the shape of raw records.

Raw records are made from orders: text columns with gaps, dates of every kind (missing, garbage, of
the year 206, good).  The same expressions make them in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extracts
from .adapters import read
from .catalog import query, r

DAY = {"STRING": "date_format(o_orderdate, 'yyyy-MM-dd')", "VARCHAR": "strftime(o_orderdate, '%Y-%m-%d')"}


def _raw(columns: tuple[str, ...], dates: tuple[str, ...], text: str) -> list[str]:
    out = []
    for i, c in enumerate(columns):
        out.append(f"CASE WHEN (o_orderkey + {i}) % 11 = 0 THEN CAST(NULL AS {text}) ELSE concat('{c[:4]} ', CAST(o_orderkey % {97 + i} AS {text})) END AS {c}")
    for i, d in enumerate(dates):
        out.append(f"CASE (o_orderkey + {i}) % 7 WHEN 0 THEN CAST(NULL AS {text}) WHEN 1 THEN 'garbage' WHEN 2 THEN '0206-04-22T04:56:02Z' ELSE concat({DAY[text]}, 'T00:00:00Z') END AS {d}")
    return out


def _parsed(dates: tuple[str, ...], ends: tuple[str, ...] = ("", "_parsed", "_status")) -> list[str]:
    out = []
    for d in dates:
        p = f"try_strptime({d}, '%Y-%m-%dT%H:%M:%SZ')"
        made = {
            "": d,
            "_parsed": f"CASE WHEN year({p}) BETWEEN 1650 AND 2035 THEN strftime({p}, '%Y-%m-%d') END AS {d}_parsed",
            "_status": f"CASE WHEN {d} IS NULL THEN 'missing' WHEN {p} IS NULL THEN 'invalid' WHEN year({p}) NOT BETWEEN 1650 AND 2035 THEN 'implausible' ELSE 'ok' END AS {d}_status",
        }
        out += [made[e] for e in ends]
    return out


def _as_day(df, dates: tuple[str, ...]):
    return df.withColumns({f"{d}_parsed": F.date_format(f"{d}_parsed", "yyyy-MM-dd") for d in dates})


def _register(name: str, extract: extracts.Extract) -> None:
    keep = f"CASE WHEN o_orderkey % 3 = 0 THEN ' {extract.keep[1]} ' WHEN o_orderkey % 3 = 1 THEN 'Other' END AS {extract.keep[0]}" if extract.keep else "1 AS unused"
    where = f"WHERE trim({extract.keep[0]}) = '{extract.keep[1]}'" if extract.keep else ""
    sql = f"WITH raw AS (SELECT {', '.join(_raw(extract.columns, extract.dates, 'VARCHAR'))}, {keep} FROM orders) SELECT {', '.join([*extract.columns, *_parsed(extract.dates)])} FROM raw {where}"

    def staged(spark, sf_dir):
        raw = read(spark, sf_dir, "orders").selectExpr(*_raw(extract.columns, extract.dates, "STRING"), keep)
        return _as_day(extracts.stage(raw, extract), extract.dates)

    staged.__name__ = f"stg_{name}"
    query(sql)(staged)


for _name, _extract in extracts.EXTRACTS.items():
    _register(_name, _extract)


_NAMES = tuple(extracts.ROLL_DATES)
_GEOM = "CASE o_orderkey % 3 WHEN 0 THEN '0101000020E61000000000000000C052C00000000000004440' WHEN 1 THEN 'zz' END"
_HOUSE = "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '12A' ELSE concat(' ', CAST(o_orderkey % 900 AS {text}), ' ') END"
_BUILT = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '196Y' WHEN 2 THEN '2099' ELSE CAST(1900 + o_orderkey % 120 AS {text}) END"


@query(
    f"""WITH raw AS (SELECT o_orderkey AS parcel_number, {', '.join(_raw((), _NAMES, 'VARCHAR'))}, {_BUILT.format(text='VARCHAR')} AS year_built, {_HOUSE.format(text='VARCHAR')} AS house_number, o_orderkey % 3 AS g FROM orders)
SELECT parcel_number, year_built, house_number, {', '.join(_parsed(_NAMES))}, CASE WHEN TRY_CAST(year_built AS INT) BETWEEN 1650 AND 2035 THEN TRY_CAST(year_built AS INT) END AS year_built_parsed,
CASE WHEN year_built IS NULL THEN 'missing' WHEN TRY_CAST(year_built AS INT) IS NULL THEN 'invalid' WHEN TRY_CAST(year_built AS INT) NOT BETWEEN 1650 AND 2035 THEN 'implausible' ELSE 'ok' END AS year_built_status,
CASE WHEN g = 0 THEN -75.0E0 END AS lon, CASE WHEN g = 0 THEN 40.0E0 END AS lat, CASE g WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid' ELSE 'missing' END AS lonlat_status, TRY_CAST(trim(house_number) AS INT) AS house_number_parsed FROM raw"""
)
def stg_properties(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS parcel_number", *_raw((), _NAMES, "STRING"), f"{_BUILT.format(text='STRING')} AS year_built", f"{_HOUSE.format(text='STRING')} AS house_number", f"{_GEOM} AS the_geom")
    return _as_day(extracts.roll_properties(raw), _NAMES).drop("the_geom")


_LOAN_DATES = ("display_date", "document_date", "recording_date")
_LOAN = {
    "record_id": "o_orderkey",
    "document_id": "o_custkey",
    "document_type": "CASE WHEN o_orderkey % 4 = 0 THEN 'DEED' ELSE ' MORTGAGE ' END",
    "opa_account_num": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE CAST(o_custkey AS {text}) END",
    "street_address": "concat('Main ', CAST(o_custkey % 150 AS {text}))",
    "unit_num": "CAST(o_custkey % 40 AS {text})",
    "grantors": "concat('Owner ', CAST(o_custkey AS {text}))",
    "grantees": "CASE o_orderkey % 6 WHEN 0 THEN 'Kiavi Funding Inc' WHEN 1 THEN 'Lima One Capital' WHEN 2 THEN NULL ELSE 'First Bank' END",
    "property_count": "1",
}


@query(
    f"""WITH raw AS (SELECT {', '.join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _LOAN.items())}, {', '.join(_raw((), _LOAN_DATES, 'VARCHAR'))} FROM orders),
p AS (SELECT *, {', '.join(_parsed(_LOAN_DATES, ('_parsed',)))} FROM raw WHERE trim(document_type) = 'MORTGAGE'),
roll AS (SELECT concat('88', lpad(CAST(c_custkey AS VARCHAR), 7, '0')) AS acct, concat('MAIN ', CAST(c_custkey % 150 AS VARCHAR)) AS base, CAST(c_custkey % 40 AS VARCHAR) AS unit FROM customer WHERE c_custkey % 40 <> 0),
once AS (SELECT base, unit, min(acct) AS acct FROM roll GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT *, nullif(trim(opa_account_num), '') AS own FROM p)
SELECT record_id, coalesce(own, acct) AS opa_account_num, coalesce(own, acct) IS NOT NULL AS has_opa_link, CASE WHEN own IS NOT NULL THEN 'recorded' WHEN acct IS NOT NULL THEN 'recovered' ELSE 'none' END AS link_source,
coalesce(display_date_parsed, document_date_parsed, recording_date_parsed) AS mortgage_date, coalesce(contains(upper(grantees), 'KIAVI') OR contains(upper(grantees), 'LIMA ONE'), false) AS is_hard_money
FROM q LEFT JOIN once ON once.base = upper(street_address) AND once.unit = q.unit_num"""
)
def stg_mortgages(spark, sf_dir):
    raw = read(spark, sf_dir, "orders").selectExpr(*[f"{e.format(text='STRING')} AS {c}" for c, e in _LOAN.items()], *_raw((), _LOAN_DATES, "STRING"))
    roll = read(spark, sf_dir, "customer").selectExpr("concat('88', lpad(CAST(c_custkey AS STRING), 7, '0')) AS parcel_number", "concat('main  ', CAST(c_custkey % 150 AS STRING)) AS location", "concat('0', CAST(c_custkey % 40 AS STRING)) AS unit")
    out = extracts.mortgages(raw, roll)
    return out.select("record_id", "opa_account_num", "has_opa_link", "link_source", F.date_format("mortgage_date", "yyyy-MM-dd").alias("mortgage_date"), "is_hard_money")


# Lots in a row of 10 m each, 0.2 or 1 m apart; of three neighbours most have one owner.
_LOT = {
    "parcel_id": "c_custkey",
    "owner": "CASE WHEN c_custkey % 10 = 9 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'City' ELSE concat('owner ', CAST(CAST(floor(c_custkey / 3) AS BIGINT) AS {text})) END",
    "lo": "c_custkey * 10.0E0 + (c_custkey % 2) * 0.5E0",
    "hi": "c_custkey * 10.0E0 + (c_custkey % 2) * 0.5E0 + 9.7E0",
    "deep": "20.0E0 + c_custkey % 5",
}


def _lots(text: str) -> list[str]:
    return [f"{e.format(text=text)} AS {c}" for c, e in _LOT.items()]


@query(
    f"""WITH p AS (SELECT {', '.join(_lots('VARCHAR'))} FROM customer), few AS (SELECT owner FROM p WHERE trim(owner) <> '' GROUP BY owner HAVING count(*) BETWEEN 2 AND 20),
q AS (SELECT p.* FROM p JOIN few USING (owner)), n AS (SELECT a.parcel_id, count(*) AS n, sum((b.hi - b.lo) * b.deep) AS more FROM q a JOIN q b ON a.owner = b.owner AND a.parcel_id <> b.parcel_id AND greatest(a.lo, b.lo) - least(a.hi, b.hi) <= 0.3 GROUP BY a.parcel_id)
SELECT parcel_id, coalesce(n, 0) AS n_linked, {r("(hi - lo) * deep + more", "linked_area", 3)} FROM p LEFT JOIN n USING (parcel_id)""",
    digits=3,
)
def stg_owner_links(spark, sf_dir):
    lots = read(spark, sf_dir, "customer").selectExpr(*_lots("STRING"))
    corners = F.array(*[F.struct(*[F.expr(e).alias(c) for c, e in zip(("x1", "y1", "x2", "y2"), s)]) for s in (("lo", "0.0E0", "hi", "0.0E0"), ("hi", "0.0E0", "hi", "deep"), ("hi", "deep", "lo", "deep"), ("lo", "deep", "lo", "0.0E0"))])
    edges = lots.select("parcel_id", F.explode(corners).alias("e")).select("parcel_id", "e.*")
    return extracts.owner_links(lots.withColumn("area", (F.col("hi") - F.col("lo")) * F.col("deep")), edges)
