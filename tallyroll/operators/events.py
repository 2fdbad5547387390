"""Dated events around an anchor: counts in windows, spans that cover it, links between events.

All joins are on the parcel; a row of the anchor without events keeps zero counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import known

WINDOW_DAYS = 1825


def is_renovation(work: str):
    """Alterations, majors and changes of use."""
    w = F.lower(F.col(work))
    return known(w.contains("alter") | (w == "major") | w.contains("change of use"))


def is_change_of_occupancy(*columns: str):
    return F.upper(F.concat_ws(" ", *columns)).contains("CHANGE OF OCCUPANCY")


def completion_date(*dates: str):
    return F.least(*dates)


def counts_before(day: str | Column, flags: dict, since: dict | None = None, days: int = WINDOW_DAYS) -> list[Column]:
    """What ``before_anchor`` counts, of rows with a sale and an event of its parcel."""
    age = F.datediff("sale_date", day)
    inside, holds = known((age > 0) & (age <= days)), lambda c: F.lit(True) if c is None else known(c)
    return [
        *[F.count_if(inside & holds(c)).alias(n) for n, c in flags.items()],
        *[F.min(F.when((age > 0) & holds(c), age)).cast("long").alias(n) for n, c in (since or {}).items()],
    ]


def is_open(opened: str, closed: str) -> Column:
    """Whether the event was opened on or before the sale and not closed by then."""
    return known((F.col(opened) <= F.col("sale_date")) & (F.col(closed).isNull() | (F.col(closed) > F.col("sale_date"))))


def before_anchor(anchors: DataFrame, events: DataFrame, day: str, flags: dict, since: dict | None = None, days: int = WINDOW_DAYS) -> DataFrame:
    """sale_id and, over events strictly before it and at most ``days`` old, a count per flag.

    ``flags``: name -> condition on the event (None: all).  ``since``: name -> condition; days
    since the last such event of any age.
    """
    e = events.withColumnRenamed("parcel_id", "_parcel")
    both = anchors.select("sale_id", "parcel_id", "sale_date").join(e, F.col("parcel_id") == F.col("_parcel")).where(F.datediff("sale_date", day) > 0)
    found = both.groupBy("sale_id").agg(*counts_before(day, flags, since, days))
    out = anchors.select("sale_id").join(found, "sale_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in flags})


def open_at_anchor(anchors: DataFrame, events: DataFrame, opened: str, closed: str, flags: dict) -> DataFrame:
    """Events opened on or before the anchor and not closed by then, a count per flag."""
    e = events.withColumnRenamed("parcel_id", "_parcel")
    both = anchors.select("sale_id", "parcel_id", "sale_date").join(e, F.col("parcel_id") == F.col("_parcel"))
    found = both.where(is_open(opened, closed)).groupBy("sale_id").agg(*[F.count_if(known(c) if c is not None else F.lit(True)).alias(n) for n, c in flags.items()])
    out = anchors.select("sale_id").join(found, "sale_id", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in flags})


def covering_spans(anchors: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (parcel_id, start, stop, owner_occupied, units) with start <= anchor < stop; no stop is open."""
    s = spans.withColumnRenamed("parcel_id", "_parcel")
    both = anchors.select("sale_id", "parcel_id", "sale_date").join(s, F.col("parcel_id") == F.col("_parcel"))
    inside = (F.col("start") <= F.col("sale_date")) & (F.col("stop").isNull() | (F.col("stop") > F.col("sale_date")))
    found = both.where(inside).groupBy("sale_id").agg(F.bool_or(known("owner_occupied")).alias("any_owner"), F.max("units").alias("units"), F.count(F.lit(1)).alias("spans"))
    out = anchors.select("sale_id").join(found, "sale_id", "left")
    return out.withColumns({"any_owner": known("any_owner"), "spans": F.coalesce("spans", F.lit(0))})


def homestead_history(amounts: DataFrame) -> DataFrame:
    """Per (parcel, year): whether 0 < amount <= the year's commonest positive amount (ties: the larger)."""
    counts = amounts.where("amount > 0").groupBy("year", "amount").agg(F.count(F.lit(1)).alias("_n"))
    mode = counts.groupBy("year").agg(F.max(F.struct("_n", "amount"))["amount"].alias("mode_amount"))
    out = amounts.join(mode, "year", "left")
    return out.select("parcel_id", "year", "mode_amount", known((F.col("amount") > 0) & (F.col("amount") <= F.col("mode_amount"))).alias("homestead"))


def financing(loans: DataFrame, purchases: DataFrame, days: int = 75) -> DataFrame:
    """Each loan with ``is_purchase``: some purchase of its parcel lies within ``days``."""
    p = purchases.select(F.col("parcel_id").alias("_parcel"), F.col("sale_date").alias("_bought"))
    near = (F.col("parcel_id") == F.col("_parcel")) & (F.abs(F.datediff("loan_date", "_bought")) <= days)
    hit = loans.join(p, near, "left_semi").select("loan_id").distinct().withColumn("is_purchase", F.lit(True))
    return loans.join(hit, "loan_id", "left").withColumn("is_purchase", known("is_purchase"))


def episodes(sales: DataFrame, events: DataFrame, kind: str, low: int = 120, high: int = 1095) -> DataFrame:
    """Purchase-to-sale episodes of ``low`` to ``high`` days with the events strictly inside."""
    chain = Window.partitionBy("parcel_id").orderBy("sale_date", "sale_id")
    rows = sales.withColumns({"bought": F.lag("sale_date").over(chain), "paid": F.lag("sale_price").over(chain)})
    rows = rows.withColumn("held", F.datediff("sale_date", "bought").cast("long")).where(F.col("held").between(low, high))
    e = events.select(F.col("parcel_id").alias("_parcel"), "issued", F.col(kind).alias("_kind"))
    inside = (F.col("parcel_id") == F.col("_parcel")) & (F.col("issued") > F.col("bought")) & (F.col("issued") < F.col("sale_date"))
    found = rows.join(e, inside).groupBy("sale_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(is_renovation("_kind")).alias("n_reno"),
        F.min(F.datediff("issued", "bought")).cast("long").alias("days_to_first"),
        F.min(F.datediff("sale_date", "issued")).cast("long").alias("days_since_last"),
        F.count_distinct("_kind").alias("n_kinds"),
    )
    out = rows.select("sale_id", "held", (F.ln("sale_price") - F.ln("paid")).alias("log_gain")).join(found, "sale_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "n_reno", "n_kinds")}).withColumn("is_bundle", F.col("n_events") >= 3)


def recovery_labels(sales: DataFrame, cutoff: str, gain: float = 1.6, flat: float = 1.2) -> DataFrame:
    """Look-ahead labels: 1 if the next sale before ``cutoff`` gained at least ``gain``, 0 if it stayed flat, else none."""
    chain = Window.partitionBy("parcel_id").orderBy("sale_date", "sale_id")
    nxt = sales.withColumns({"next_date": F.lead("sale_date").over(chain), "next_price": F.lead("sale_price").over(chain)})
    nxt = nxt.where(F.col("next_date") < F.lit(cutoff).cast("date"))
    g = F.ln("next_price") - F.ln("sale_price")
    import math

    label = F.when(g >= math.log(gain), 1).when(F.abs(g) <= math.log(flat), 0)
    return nxt.select("sale_id", g.alias("log_gain"), label.alias("label")).where("label is not null")
