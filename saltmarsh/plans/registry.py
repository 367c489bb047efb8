"""Registered queries: name -> (callable on (spark, sf_dir), SQL twin or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to hourly bars, session volatility, first-touch labels, and metrics by symbol."""
    from pyspark.sql import functions as F

    from saltmarsh.operators import features, labels, metrics
    from saltmarsh.plans.views import Views

    bars = features.realized_vol_bps(features.running_vwap(Views(spark, sf_dir).bars, features.SESSION), 6)
    out = labels.percent_barriers(bars, ["symbol", "trade_date"], "bar_ts", 6, 0.4, 0.3).where("outcome <> 'excluded'")
    return metrics.outcome_table(out.withColumn("net_bps", F.col("gross_bps") - 3.5), ["symbol"], "outcome", "net_bps", ["target", "stop", "timeout"])
