"""Queries over the test tables: adapters, DataFrame plans and their SQL twins."""

from . import catalog, crossfit_queries, extract_queries, feature_queries, model_queries, ratio_queries, ratio_study_queries, screen_queries, signal_queries, staging_queries, study_queries, validity_queries, mart_queries  # noqa: F401


def all_queries() -> dict:
    return catalog.QUERIES


def all_sql() -> dict:
    return catalog.SQL
