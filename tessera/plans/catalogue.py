"""The registered queries of the engine's own operators, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audit_plans, chain_plans, finding_plans, format_plans, relational_plans, section_plans, text_plans

PLANS = (text_plans, section_plans, finding_plans, format_plans, relational_plans, audit_plans, chain_plans)
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: query for plans in PLANS for name, query in plans.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plans in PLANS for name, sql in plans.SQL.items()}
