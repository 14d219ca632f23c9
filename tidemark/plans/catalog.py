"""All queries of the time-series library by name, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import features
from tidemark.plans import checks, flows, ledgers, logs, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**series.QUERIES, **ledgers.QUERIES, **logs.QUERIES, **flows.QUERIES, **checks.QUERIES}
ORACLES: dict[str, str] = {**series.ORACLES, **ledgers.ORACLES, **logs.ORACLES, **flows.ORACLES, **checks.ORACLES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen features and the bracket label of every six-hour bar that has enough bars around it."""
    return features.observations(series.hourly(spark, sf_dir, 6 * 3600))
