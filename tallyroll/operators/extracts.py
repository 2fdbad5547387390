"""Public-record extracts to typed tables: the columns each one keeps, with its dates parsed and judged."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import link_recovery, parsed_timestamp, parsed_year, point_lonlat

# The published columns of each extract; those under "dates" get a parsed value and a status.
_PLACE = ("address", "zip", "censustract")
_OWNER = ("opa_account_num", "parcel_id_num")


@dataclass(frozen=True)
class Extract:
    """``keep``: (column, value): only rows whose trimmed column has that value."""

    columns: tuple[str, ...]
    dates: tuple[str, ...]
    keep: tuple[str, str] | None = None


EXTRACTS = {
    "permits": Extract(
        ("permitnumber", *_OWNER, "permittype", "permitdescription", "typeofwork", "commercialorresidential", "approvedscopeofwork", "status", "systemofrecord", *_PLACE, "geocode_x", "geocode_y"),
        ("permitissuedate", "permitcompleteddate", "certificateofoccupancydate"),
    ),
    "complaints": Extract(
        ("complaintnumber", "casenumber", *_OWNER, "complaintcode", "complaintcodename", "complaintstatus", "casestatus", "unitresponsible", *_PLACE),
        ("complaintdate", "complaintresolution_date"),
    ),
    "investigations": Extract(
        ("casenumber", *_OWNER, "casetype", "casepriority", "investigationtype", "investigationstatus", *_PLACE),
        ("investigationcompleted",),
    ),
    "rental_licenses": Extract(
        ("licensenum", *_OWNER, "rentalcategory", "licensestatus", "owneroccupied", "numberofunits", *_PLACE),
        ("initialissuedate", "mostrecentissuedate", "expirationdate", "inactivedate"),
        ("licensetype", "Rental"),
    ),
    "appeals": Extract(
        ("appealnumber", *_OWNER, "appealtype", "applicationtype", "appealstatus", "appealgrounds", "decision", "meetingresult", "relatedpermit", *_PLACE),
        ("createddate", "scheduleddate", "decisiondate", "completeddate"),
    ),
    "demolitions": Extract(
        ("caseorpermitnumber", *_OWNER, "typeofwork", "typeofworkdescription", "city_demo", "status", *_PLACE, "geocode_x", "geocode_y"),
        ("start_date", "completed_date"),
    ),
    "violations": Extract(
        ("violationnumber", "casenumber", *_OWNER, "violationcode", "violationcodetitle", "violationstatus", "caseprioritydesc", *_PLACE),
        ("violationdate", "violationresolutiondate", "casecreateddate"),
    ),
}
ROLL_DATES = ("assessment_date", "market_value_date", "recording_date", "sale_date", "state_code_date")

# Words in the names of lenders who finance renovation for resale.
HARD_MONEY = (
    "KIAVI", "LENDINGHOME", "LIMA ONE", "RCN CAPITAL", "CIVIC FINANCIAL", "ANCHOR LOANS", "DOMINION FINANCIAL", "LENDINGONE",
    "TVC FUNDING", "TEMPLE VIEW CAPITAL", "ROC CAPITAL", "TOORAK", "FUND THAT FLIP", "SHERMAN BRIDGE", "VISIO FINANCIAL",
    "CONSTRUCTIVE LOANS", "EASY STREET CAPITAL",
)
MAX_OWNER_PARCELS = 20
ADJACENT_M = 0.3


def stage(raw: DataFrame, extract: Extract) -> DataFrame:
    """The extract's rows and columns; each date stays as it came, with ``_parsed`` and ``_status``."""
    rows = raw
    if extract.keep:
        column, value = extract.keep
        rows = rows.where(F.trim(F.col(column).cast("string")) == value)
    for date in extract.dates:
        rows = parsed_timestamp(rows, date)
    return rows.select(*extract.columns, *[f"{d}{end}" for d in extract.dates for end in ("", "_parsed", "_status")])


def roll_properties(raw: DataFrame) -> DataFrame:
    """The current roll as it came, with parsed dates, year built, place and a numeric house number."""
    rows = raw
    for date in ROLL_DATES:
        rows = parsed_timestamp(rows, date)
    rows = point_lonlat(parsed_year(rows, "year_built"), "the_geom")
    return rows.withColumn("house_number_parsed", F.trim(F.col("house_number").cast("string")).try_cast("int"))


def is_hard_money(lender: str) -> Column:
    return F.coalesce(F.upper(F.col(lender).cast("string")).rlike("|".join(HARD_MONEY)), F.lit(False))


def mortgages(raw: DataFrame, roll: DataFrame | None = None) -> DataFrame:
    """Financing events: dated by the first of display, document and recording date that parses.

    With the ``roll``, rows without an account get one where address and unit name exactly one.
    """
    rows = raw.where(F.trim("document_type") == "MORTGAGE")
    for date in ("display_date", "document_date", "recording_date"):
        rows = parsed_timestamp(rows, date)
    rows = rows.withColumns({
        "mortgage_date": F.coalesce("display_date_parsed", "document_date_parsed", "recording_date_parsed"),
        "has_opa_link": F.coalesce(F.trim("opa_account_num") != "", F.lit(False)),
        "is_hard_money": is_hard_money("grantees"),
    })
    rows = rows.select("record_id", "document_id", "opa_account_num", "has_opa_link", "street_address", "unit_num", "mortgage_date", "grantors", "grantees", "is_hard_money", "property_count")
    if roll is None:
        return rows
    rows = link_recovery(rows.withColumn("opa_account_num", F.when(F.col("has_opa_link"), F.col("opa_account_num"))), roll)
    return rows.withColumn("has_opa_link", F.col("opa_account_num").isNotNull())


def _point_to_segment(px: str, py: str, a: str) -> Column:
    """Squared distance of a point to segment ``a`` (columns a_x1, a_y1, a_x2, a_y2)."""
    x, y = F.col(px), F.col(py)
    x1, y1, x2, y2 = (F.col(f"{a}_{c}") for c in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.pow(x - x1 - t * dx, F.lit(2)) + F.pow(y - y1 - t * dy, F.lit(2))


def _cross(a: str, px: str, py: str) -> Column:
    x1, y1, x2, y2 = (F.col(f"{a}_{c}") for c in ("x1", "y1", "x2", "y2"))
    return (x2 - x1) * (F.col(py) - y1) - (y2 - y1) * (F.col(px) - x1)


def owner_links(parcels: DataFrame, edges: DataFrame, distance: float = ADJACENT_M, most: int = MAX_OWNER_PARCELS, cell: float = 50.0) -> DataFrame:
    """parcel_id, n_linked and linked_area (own and linked; null if none) of every parcel.

    Linked are parcels of the same owner at most ``distance`` apart, where that owner holds at
    most ``most`` parcels.  ``parcels``: parcel_id, owner, area.  ``edges``: parcel_id, x1, y1, x2,
    y2, the sides of the outlines.  Sides meet by owner and grid cell, so that no two owners' sides
    are ever paired, and an owner has few parcels.
    """
    owned = parcels.where(F.coalesce(F.trim("owner"), F.lit("")) != "")
    few = owned.groupBy("owner").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n").between(2, most)).select("owner")
    rows = owned.join(few, "owner", "left_semi").select("parcel_id", "owner").join(edges, "parcel_id")
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - distance) / cell), F.floor((F.greatest(a, b) + distance) / cell))
    rows = rows.withColumn("_cx", F.explode(span("x1", "x2"))).withColumn("_cy", F.explode(span("y1", "y2")))
    side = lambda s: rows.select("owner", "_cx", "_cy", F.col("parcel_id").alias(f"{s}_id"), *[F.col(c).alias(f"{s}_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = side("a").join(side("b"), ["owner", "_cx", "_cy"]).where("a_id <> b_id")
    apart = F.least(_point_to_segment("a_x1", "a_y1", "b"), _point_to_segment("a_x2", "a_y2", "b"), _point_to_segment("b_x1", "b_y1", "a"), _point_to_segment("b_x2", "b_y2", "a"))
    crossing = (_cross("a", "b_x1", "b_y1") * _cross("a", "b_x2", "b_y2") < 0) & (_cross("b", "a_x1", "a_y1") * _cross("b", "a_x2", "a_y2") < 0)
    near = both.where((apart <= distance * distance) | crossing).select(F.col("a_id").alias("parcel_id"), F.col("b_id").alias("_b")).distinct()
    other = parcels.select(F.col("parcel_id").alias("_b"), F.col("area").alias("_area"))
    sums = near.join(other, "_b").groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_linked"), F.sum("_area").alias("_more"))
    out = parcels.join(sums, "parcel_id", "left")
    return out.select("parcel_id", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), (F.col("area") + F.col("_more")).alias("linked_area"))
