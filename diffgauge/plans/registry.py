"""The catalogue of queries: a Spark plan and, where SQL can say it, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diffgauge.session import ship, tune

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its operator id, with the SQL it must agree with."""
    def add(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(ship(tune(spark)), folder)
        PLANS[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return plan
    return add


def load() -> tuple[dict[str, Plan], dict[str, str]]:
    from diffgauge.plans import (q_aggregates, q_chain, q_changes, q_features, q_joins,  # noqa: F401
                                 q_metrics, q_text)
    return PLANS, ORACLES
