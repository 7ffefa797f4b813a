"""The registered queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classify, composites, dual_signals, effects, linking, market_discovery, measures, modelling, price_models, quality, ranking, releases
from .registry import QUERIES, SQL

FLAGSHIP = "market_metrics"
MODULES = (classify, composites, dual_signals, effects, linking, market_discovery, measures, modelling, price_models, quality, ranking, releases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
