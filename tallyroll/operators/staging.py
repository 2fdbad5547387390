"""Raw extracts to typed tables: parse status, keys, one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_address, norm_unit, status_of

MIN_YEAR, MAX_YEAR = 1650, 2035
CONDO_PREFIX = "88"
UNIT_TOKEN = r"\b(?:APT|UNIT|STE|SUITE|PH|FL|#)\s*([0-9A-Z-]+)$"
UNIT_SUFFIX = r"\s+(?:APT|UNIT|STE|SUITE|PH|FL|#)\s*[0-9A-Z-]*$"

# Deed types and the kind each one stands for.
DEED_KINDS = {
    "DEED": "standard",
    "MISCELLANEOUS DEED": "miscellaneous",
    "SHERIFF DEED": "sheriff",
    "DEED SHERIFF": "sheriff",
    "DEED LAND BANK": "land_bank",
    "DEED OF CONDEMNATION": "condemnation",
    "DEED - ADVERSE POSSESSION": "adverse_possession",
}


def parsed_timestamp(df: DataFrame, c: str, low: int = MIN_YEAR, high: int = MAX_YEAR) -> DataFrame:
    """``c`` stays; ``c_parsed`` is the time if it is plausible, ``c_status`` says why not."""
    raw = F.col(c).cast("string")
    at = F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp(raw, F.lit("[yyyy][yyy]-MM-dd'T'HH:mm:ssX")))
    out = df.withColumn("_at", at)
    status = status_of(raw, F.col("_at"), F.year("_at"), low, high)
    return out.withColumns({f"{c}_parsed": F.when(F.year("_at").between(low, high), F.col("_at")), f"{c}_status": status}).drop("_at")


def parsed_year(df: DataFrame, c: str, low: int = MIN_YEAR, high: int = MAX_YEAR) -> DataFrame:
    year = F.trim(F.col(c).cast("string")).try_cast("int")
    status = F.when(F.col(c).isNull(), "missing").when(year.isNull(), "invalid").when(~year.between(low, high), "implausible").otherwise("ok")
    return df.withColumns({f"{c}_parsed": F.when(year.between(low, high), year), f"{c}_status": status})


def latest_per_key(df: DataFrame, keys: list[str], order: list, copies: str | None = None) -> DataFrame:
    """The first row of each key by ``order`` (a total order); ``copies``: how many there were."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("_k", F.row_number().over(w.orderBy(*order)))
    if copies:
        out = out.withColumn(copies, F.count(F.lit(1)).over(w))
    return out.where("_k = 1").drop("_k")


def account_key(c: str):
    """A numeric account with its leading zeros back; zero is no account."""
    n = F.col(c).try_cast("long")
    return F.when(n > 0, F.lpad(n.cast("string"), 9, "0"))


def footprints(raw: DataFrame, bridge: DataFrame) -> DataFrame:
    """The largest footprint of each parcel with the number of footprints, then of each account."""
    size = F.col("square_ft").try_cast("double")
    rows = raw.select(F.col("parcel_id_num").try_cast("long").alias("pwd_parcel_id"), "objectid", size.alias("footprint_sqft")).where("pwd_parcel_id is not null and footprint_sqft > 0")
    main = latest_per_key(rows, ["pwd_parcel_id"], [F.desc("footprint_sqft"), "objectid"], "footprint_count")
    link = bridge.select(F.col("parcelid").try_cast("long").alias("pwd_parcel_id"), F.trim(F.col("brt_id").cast("string")).alias("parcel_id"))
    link = latest_per_key(link.where("pwd_parcel_id is not null and parcel_id <> ''"), ["pwd_parcel_id"], ["parcel_id"])
    both = main.join(link, "pwd_parcel_id")
    return latest_per_key(both, ["parcel_id"], [F.desc("footprint_sqft"), "objectid"])


def deed_kind(c: str):
    """The kind of a deed's trimmed type; null for other documents."""
    pairs = [F.lit(x) for kv in DEED_KINDS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.trim(F.upper(F.col(c))))


def link_recovery(rows: DataFrame, roll: DataFrame, key: str = "record_id") -> DataFrame:
    """Accounts for unlinked rows whose base address and unit name exactly one condominium account."""
    lookup = roll.where(F.col("parcel_number").cast("string").startswith(CONDO_PREFIX) & F.col("unit").isNotNull())
    lookup = lookup.select(F.col("parcel_number").cast("string").alias("recovered"), norm_address("location").alias("_base"), norm_unit("unit").alias("_unit")).where("_unit <> ''")
    once = lookup.groupBy("_base", "_unit").agg(F.count(F.lit(1)).alias("_n"), F.min("recovered").alias("recovered")).where("_n = 1").drop("_n")
    full = norm_address("street_address")
    token = F.regexp_extract(full, UNIT_TOKEN, 1)
    unit = F.coalesce(F.nullif(norm_unit("unit_num"), F.lit("")), F.nullif(norm_unit(token), F.lit("")))
    asked = rows.withColumns({"_base": F.regexp_replace(full, UNIT_SUFFIX, ""), "_unit": unit})
    out = asked.join(once, ["_base", "_unit"], "left").drop("_base", "_unit")
    missing = F.col("opa_account_num").isNull()
    return out.withColumns({
        "link_source": F.when(~missing, "recorded").when(F.col("recovered").isNotNull(), "recovered").otherwise("none"),
        "opa_account_num": F.coalesce("opa_account_num", "recovered"),
    }).drop("recovered")


def _half(c, at: int):
    """The 32-bit word whose little-endian hex starts at ``at``."""
    pairs = [F.substring(c, at + 2 * k, 2) for k in (3, 2, 1, 0)]
    return F.conv(F.concat(*pairs), 16, 10).cast("double")


def _double_at(c, at: int):
    """A little-endian hex double, by arithmetic on its sign, exponent and fraction."""
    low, high = _half(c, at), _half(c, at + 8)
    sign = F.when(high >= 2.0**31, -1.0).otherwise(1.0)
    body = high - F.when(high >= 2.0**31, 2.0**31).otherwise(0.0)
    exponent = F.floor(body / 2.0**20)
    fraction = (body - exponent * 2.0**20) * 2.0**32 + low
    return sign * F.pow(F.lit(2.0), exponent - 1023) * (1 + fraction / 2.0**52)


def point_lonlat(df: DataFrame, c: str) -> DataFrame:
    """lon, lat and lonlat_status of a hex EWKB point with SRID 4326."""
    g = F.upper(F.col(c))
    ok = g.startswith("0101000020E6100000") & (F.length(g) == 50) & g.rlike("^[0-9A-F]+$")
    status = F.when(F.col(c).isNull(), "missing").when(ok, "ok").otherwise("invalid")
    return df.withColumns({"lon": F.when(ok, _double_at(g, 19)), "lat": F.when(ok, _double_at(g, 35)), "lonlat_status": status})


def tract_shares(df: DataFrame, total: str, parts: list[str]) -> DataFrame:
    """Shares of each part where the total is above zero, and the part that is more than half."""
    n = F.col(total).try_cast("double")
    share = {f"{p}_share": F.when(n > 0, F.try_divide(F.col(p).try_cast("double"), n)) for p in parts}
    major = F.coalesce(*[F.when(s > 0.5, F.lit(p)) for p, s in zip(parts, share.values())])
    return df.withColumns(share | {"majority": F.when(n > 0, F.coalesce(major, F.lit("none")))})


def diff_snapshot(old: DataFrame, new: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """One row per watched column: rows added, removed and changed, changes of the column, median change.

    Of rows with the same key the last by all columns counts; rows without a key are left out.
    """
    def load(df):
        rows = df.select(*[F.col(k).cast("string").alias(k) for k in keys], *watched).dropna(subset=keys)
        return latest_per_key(rows, keys, [F.desc(c) for c in watched])

    a, b = load(old), load(new)
    ra = a.select(*keys, F.struct(*watched).alias("_a"))
    rb = b.select(*keys, F.struct(*watched).alias("_b"))
    rows = ra.join(rb, keys, "full_outer")
    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    changed = {c: present & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in watched}
    numeric = {c for c, t in a.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")}
    any_change = F.array_contains(F.array(*changed.values()), True)
    totals = rows.agg(
        F.count_if(F.col("_a").isNull()).alias("n_added"),
        F.count_if(F.col("_b").isNull()).alias("n_removed"),
        F.count_if(any_change).alias("n_changed_rows"),
        F.array(*[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(x).alias("n_changed"),
                (F.median(F.when(x, F.col(f"_b.{c}") - F.col(f"_a.{c}"))) if c in numeric else F.lit(None).cast("double")).alias("median_delta"),
            )
            for c, x in changed.items()
        ]).alias("_c"),
    )
    return totals.select("n_added", "n_removed", "n_changed_rows", F.explode("_c").alias("c")).select("c.*", "n_added", "n_removed", "n_changed_rows")
