"""Column helpers: the null, NaN and division rules, and small expressions used by many operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark a party as a legal entity.
ENTITY_TOKENS = (
    "LLC", "LLP", "INC", "CORP", "CORPORATION", "COMPANY", "BANK", "TRUST", "PARTNERSHIP", "PARTNERS", "AUTHORITY",
    "REDEVELOPMENT", "HOUSING", "COMMONWEALTH", "HUD", "SECRETARY", "FANNIE", "FREDDIE", "PROPERTIES", "REALTY",
    "HOLDINGS", "DEVELOPMENT", "CONSTRUCTION", "INVESTMENTS", "GROUP", "EXECUTOR", "ADMINISTRATOR", "MORTGAGE",
    "FINANCE", "CREDIT",
)
ENTITY_PATTERN = r"\b(" + "|".join(ENTITY_TOKENS) + r")\b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: str | Column) -> Column:
    """A flag with null as false."""
    return F.coalesce(col(c), F.lit(False))


def positive(c: str | Column) -> Column:
    """The number if it is finite and above zero, else null."""
    x = col(c).cast("double")
    return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def sum0(c: str | Column) -> Column:
    """A sum that is 0 over no value."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(col(later), col(earlier))


def entity_flag(party: str | Column) -> Column:
    return known(F.upper(col(party)).rlike(ENTITY_PATTERN))


def name_tokens(party: str | Column) -> Column:
    """The words of three letters or more that don't mark an entity."""
    words = F.regexp_extract_all(F.upper(col(party)), F.lit(r"([A-Z]{3,})"), F.lit(1))
    return F.array_except(words, F.array(*map(F.lit, ENTITY_TOKENS)))


def related_parties(a: str | Column, b: str | Column) -> Column:
    return known(F.size(F.array_intersect(name_tokens(a), name_tokens(b))) > 0)


def block_id(street: str | Column, house: str | Column) -> Column:
    """Street code and hundred block; null if either part is."""
    hundred = (F.floor(col(house) / 100) * 100).cast("long").cast("string")
    return F.concat(col(street).cast("string"), F.lit("_"), hundred)


def recency_weight(days: str | Column) -> Column:
    """Logistic decay with its middle at three years."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(col(days) / F.lit(365.25) - F.lit(3.0)))


# Origin of the tangent plane, and metres per degree of latitude and of longitude at the equator.
ORIGIN_LON, ORIGIN_LAT = -75.16, 39.95
M_PER_DEG_LAT, M_PER_DEG_LON_EQUATOR = 110_540.0, 111_320.0


def project_x(lon: str | Column) -> Column:
    return (col(lon) - F.lit(ORIGIN_LON)) * (F.lit(M_PER_DEG_LON_EQUATOR) * F.cos(F.radians(F.lit(ORIGIN_LAT))))


def project_y(lat: str | Column) -> Column:
    return (col(lat) - F.lit(ORIGIN_LAT)) * F.lit(M_PER_DEG_LAT)


def norm_address(c: str | Column) -> Column:
    """Upper case, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.upper(col(c)), r"\s+", " "))


def norm_unit(c: str | Column) -> Column:
    """Letters and digits of the unit, without leading zeros."""
    return F.ltrim(F.regexp_replace(F.upper(col(c)), "[^0-9A-Z]", ""), F.lit("0"))


def quarter_number(day: str | Column, first_year: int = 1997) -> Column:
    return (F.year(col(day)) - first_year) * 4 + F.quarter(col(day)) - 1


def status_of(raw: Column, value: Column, year: Column, low: int, high: int) -> Column:
    """missing, invalid, implausible or ok."""
    return (
        F.when(raw.isNull() | (F.trim(raw) == ""), "missing")
        .when(value.isNull(), "invalid")
        .when((year < low) | (year > high), "implausible")
        .otherwise("ok")
    )


def digitize(x: str | Column, edges: list[float]) -> Column:
    """How many edges are at most x."""
    return sum((F.when(col(x) >= F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
