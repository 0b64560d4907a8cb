"""All queries over the spatial operators, by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plotwise.plans import appearance, decisions, evidence, geodesy, placement, polygons

_PLANS = (geodesy, polygons, decisions, placement, appearance, evidence)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run for plan in _PLANS for name, run in plan.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}

flagship = decisions.flagship
