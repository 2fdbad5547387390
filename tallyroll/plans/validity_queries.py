"""Transfers classified as market evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import ENTITY_TOKENS, entity_flag, name_tokens, related_parties
from ..operators import validity
from .adapters import DEEDS, ROLL, deeds, roll
from .catalog import query, r

_TOKENS = ", ".join(f"'{t}'" for t in ENTITY_TOKENS)
_PATTERN = "\\b(" + "|".join(ENTITY_TOKENS) + ")\\b"


def _words(c: str) -> str:
    return f"list_filter(regexp_extract_all(upper({c}), '[A-Z]{{3,}}'), lambda t: t NOT IN ({_TOKENS}))"


FACTS = f"""
deeds AS ({DEEDS}), roll AS ({ROLL}),
steps AS (
  SELECT record_id, sale_price, date_diff('day', lag(sale_date) OVER w, sale_date) AS days_since_prev, lag(sale_price) OVER w AS prev
  FROM deeds WHERE has_opa_link AND sale_date IS NOT NULL AND sale_price > 1
  WINDOW w AS (PARTITION BY opa_account_num ORDER BY sale_date, record_id)),
flags AS (
  SELECT record_id, days_since_prev,
    coalesce(days_since_prev < 365 AND sale_price = prev, false) AS dup_price_within_year,
    coalesce(days_since_prev < 365 AND (sale_price / prev >= 2.0 OR sale_price / prev <= 0.5), false) AS rapid_price_swing
  FROM steps),
facts AS (
  SELECT d.*, category_code_description, total_livable_area, days_since_prev,
    coalesce(dup_price_within_year, false) AS dup_price_within_year, coalesce(rapid_price_swing, false) AS rapid_price_swing,
    substr(zip_code, 1, 5) AS zip5, CAST(year(sale_date) AS INT) AS sale_year,
    coalesce(regexp_matches(upper(grantors), '{_PATTERN}'), false) AS non_person_seller,
    coalesce(regexp_matches(upper(grantees), '{_PATTERN}'), false) AS non_person_buyer,
    coalesce(len(list_intersect({_words("grantors")}, {_words("grantees")})) > 0, false) AS possible_related,
    coalesce(deed_kind IN ('sheriff', 'condemnation'), false) AS is_distress_deed,
    coalesce(deed_kind IN ('land_bank', 'deceased', 'adverse_possession', 'other'), false) AS is_non_market_deed,
    NOT is_nominal AND coalesce(sale_price, 0) <= 10000 AS is_low_price,
    CASE WHEN total_livable_area > 0 THEN sale_price / total_livable_area END AS price_per_sqft,
    CASE WHEN starts_with(d.opa_account_num, '88') THEN 'CONDO UNIT' ELSE category_code_description END AS pool_category,
    has_opa_link AND NOT is_multi_parcel AND sale_date IS NOT NULL AND deed_kind IN ('standard', 'miscellaneous')
      AND coalesce(sale_price, 0) > 10000 AND NOT coalesce(dup_price_within_year, false) AS in_reference_pool
  FROM deeds d LEFT JOIN roll ON d.opa_account_num = parcel_number LEFT JOIN flags USING (record_id)),
stats AS (
  SELECT zip5, pool_category, sale_year, count(*) AS group_n, avg(ln(sale_price)) AS pm, stddev_samp(ln(sale_price)) AS ps,
    avg(ln(price_per_sqft)) AS qm, stddev_samp(ln(price_per_sqft)) AS qs
  FROM facts WHERE in_reference_pool GROUP BY ALL),
scored AS (
  SELECT facts.*, group_n,
    CASE WHEN group_n >= 20 AND ps > 0 THEN (ln(sale_price) - pm) / ps END AS z_log_price,
    CASE WHEN group_n >= 20 AND qs > 0 THEN (ln(price_per_sqft) - qm) / qs END AS z_log_ppsf
  FROM facts LEFT JOIN stats USING (zip5, pool_category, sale_year)),
judged AS (SELECT *, coalesce(in_reference_pool AND abs(z_log_ppsf) >= 3, false) AS is_price_outlier FROM scored),
stated AS (
  SELECT *, CASE WHEN is_multi_parcel OR NOT has_opa_link OR sale_date IS NULL OR dup_price_within_year THEN 'excluded'
    WHEN is_distress_deed OR is_non_market_deed THEN 'not_arms_length' WHEN is_nominal THEN 'nominal'
    WHEN is_low_price OR is_price_outlier OR rapid_price_swing THEN 'suspect' ELSE 'arms_length' END AS validity_status
  FROM judged)"""
REASONS = """array_to_string(list_filter([
    CASE WHEN is_multi_parcel THEN 'multi_parcel' END, CASE WHEN NOT has_opa_link THEN 'no_opa_link' END,
    CASE WHEN sale_date IS NULL THEN 'no_sale_date' END, CASE WHEN dup_price_within_year THEN 'dup_price_within_year' END,
    CASE WHEN is_distress_deed THEN 'distress_deed' END, CASE WHEN is_non_market_deed THEN 'non_market_deed' END,
    CASE WHEN is_nominal THEN 'nominal_consideration' END, CASE WHEN is_low_price THEN 'low_price' END,
    CASE WHEN is_price_outlier AND z_log_ppsf > 0 THEN 'price_outlier_high' END,
    CASE WHEN is_price_outlier AND z_log_ppsf <= 0 THEN 'price_outlier_low' END,
    CASE WHEN rapid_price_swing THEN 'rapid_price_swing' END, CASE WHEN non_person_seller THEN 'non_person_seller' END,
    CASE WHEN non_person_buyer THEN 'non_person_buyer' END, CASE WHEN possible_related THEN 'possible_related_parties' END],
    lambda t: t IS NOT NULL), ',')"""


def _facts(spark, sf_dir):
    return validity.with_facts(deeds(spark, sf_dir), roll(spark, sf_dir))


@query(f"WITH {FACTS} SELECT record_id, days_since_prev, dup_price_within_year, rapid_price_swing FROM facts")
def val_resale_flags(spark, sf_dir):
    out = validity.resale_flags(deeds(spark, sf_dir))
    return out.select("record_id", "days_since_prev", "dup_price_within_year", "rapid_price_swing")


@query(f"WITH {FACTS} SELECT record_id, non_person_seller, non_person_buyer FROM facts")
def val_entity_flag(spark, sf_dir):
    return deeds(spark, sf_dir).select("record_id", entity_flag("grantors").alias("non_person_seller"), entity_flag("grantees").alias("non_person_buyer"))


@query(f"WITH {FACTS} SELECT record_id, array_to_string(list_sort(list_distinct({_words('grantors')})), ' ') AS words, possible_related FROM facts")
def val_related_parties(spark, sf_dir):
    words = F.array_join(F.array_sort(F.array_distinct(name_tokens("grantors"))), " ")
    return deeds(spark, sf_dir).select("record_id", words.alias("words"), related_parties("grantors", "grantees").alias("possible_related"))


@query(f"WITH {FACTS} SELECT record_id, pool_category, {r('price_per_sqft', 'price_per_sqft')}, in_reference_pool FROM facts")
def val_reference_pool(spark, sf_dir):
    return _facts(spark, sf_dir).select("record_id", "pool_category", "price_per_sqft", "in_reference_pool")


@query(f"WITH {FACTS} SELECT record_id, group_n, {r('z_log_price', 'z_log_price')}, {r('z_log_ppsf', 'z_log_ppsf')}, is_price_outlier FROM judged")
def val_group_z(spark, sf_dir):
    return validity.group_z(_facts(spark, sf_dir)).select("record_id", "group_n", "z_log_price", "z_log_ppsf", "is_price_outlier")


@query(f"WITH {FACTS} SELECT record_id, {REASONS} AS reasons FROM judged")
def val_reasons(spark, sf_dir):
    return validity.group_z(_facts(spark, sf_dir)).select("record_id", F.array_join(validity.reasons(), ",").alias("reasons"))


@query(f"WITH {FACTS} SELECT validity_status, count(*) AS n, {r('avg(sale_price)', 'mean_price', 2)} FROM stated GROUP BY ALL")
def val_status(spark, sf_dir):
    out = validity.group_z(_facts(spark, sf_dir)).withColumn("validity_status", validity.status())
    return out.groupBy("validity_status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sale_price"), 2).alias("mean_price"))


@query(
    f"""WITH {FACTS} SELECT record_id AS sale_id, opa_account_num AS parcel_id, CAST(sale_date AS VARCHAR) AS sale_date, {r("sale_price", "sale_price")}, deed_kind,
    validity_status, {REASONS} AS validity_reasons,
    CASE WHEN validity_status = 'arms_length' THEN CASE WHEN non_person_seller OR non_person_buyer OR possible_related THEN 0.75 ELSE 0.9 END
      WHEN validity_status = 'suspect' THEN 0.5 ELSE 0.95 END::DOUBLE AS confidence,
    zip5, category_code_description, pool_category, sale_year, {r("price_per_sqft", "price_per_sqft")}, {r("z_log_price", "z_log_price")},
    {r("z_log_ppsf", "z_log_ppsf")}, group_n, days_since_prev, non_person_seller, non_person_buyer, possible_related, in_reference_pool FROM stated"""
)
def val_classify_sales(spark, sf_dir):
    out = validity.classify_sales(deeds(spark, sf_dir), roll(spark, sf_dir))
    return out.withColumns({"validity_reasons": F.array_join("validity_reasons", ","), "sale_date": F.col("sale_date").cast("string")})
