"""Recorded characteristics as categories and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import ratio

# Building styles that stand alone.
DETACHED = ("CONVENTIONAL", "CAPE", "COLONIAL", "SPLIT LEVEL", "RANCH", "RANCHER", "BUNGALOW", "TUDOR", "VICTORIAN", "CONTEMPORARY")
# First year after each era.
ERAS = ((1900, "pre1900"), (1920, "1900s"), (1940, "1920s_30s"), (1960, "1940s_50s"), (1980, "1960s_70s"), (2000, "1980s_90s"), (2010, "2000s"))


def style(c: str):
    b = F.trim(F.col(c).cast("string"))
    return (
        F.when(b.isNull(), "unknown").when(b.startswith("ROW"), "row").when(b.startswith("TWIN") | b.startswith("SEMI"), "twin")
        .when(b.startswith("DET") | b.isin(*DETACHED), "detached").otherwise("other")
    )


def era(c: str):
    y = F.col(c)
    out = F.when(y.isNull(), "unknown")
    for before, name in ERAS:
        out = out.when(y < before, name)
    return out.otherwise("2010plus")


def number(c: str, default: float = 0.0):
    return F.coalesce(F.col(c).try_cast("double"), F.lit(default))


def saturating(c: str, scale: float = 1.0):
    """A count as evidence between 0 and 1."""
    return 1 - F.exp(-F.greatest(number(c), F.lit(0.0)) / scale)


def presence(c: str):
    return (number(c) > 0).cast("double")


def noisy_or(*evidence):
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return clip(1 - reduce(lambda a, b: a * (1 - clip(b)), evidence, F.lit(1.0)))


def structure(df: DataFrame) -> DataFrame:
    """Floors from the height, gross area, their gaps to the record, and the area conflict flag."""
    floors = F.least(F.greatest(F.bround(F.col("height_ft") / 10.0, 0), F.lit(1.0)), F.lit(6.0))
    floors = F.when(F.col("height_ft").isNotNull(), floors)
    out = df.withColumn("floors", floors).withColumns({"gross": F.col("footprint") * F.col("floors"), "story_gap": F.col("stories") - F.col("floors")})
    out = out.withColumn("livable_ratio", F.when(F.col("gross") > 0, ratio("livable", "gross")))
    conflict = (
        (F.upper("category") == "MULTI FAMILY") & (number("beds") <= 0) & (number("baths") <= 0) & F.col("stories").between(2, 6)
        & (F.col("floors") >= 2) & (F.abs("story_gap") <= 1) & (number("footprint") >= 200) & (F.coalesce("livable_ratio", F.lit(1e300)) < 0.4)
    )
    return out.withColumn("area_conflict", F.coalesce(conflict, F.lit(False)).cast("double"))
