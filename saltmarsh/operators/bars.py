"""Ticks and finer bars to bars of a fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar_start(time: str, unit: str | int) -> Column:
    """Start of the bar that a time lies in: a calendar unit, or a number of minutes counted from midnight."""
    if isinstance(unit, str):
        return F.date_trunc(unit, time).cast("timestamp_ntz")
    if not 0 < unit <= 24 * 60:
        raise ValueError("a bar has from one minute to a day")
    minute = F.hour(time) * 60 + F.minute(time)
    return F.to_date(time).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.floor(minute / unit) * unit).cast("int"))


def resample(ticks: DataFrame, unit: str | int, extra: list[Column] = ()) -> DataFrame:
    """Open, high, low, close, volume for each symbol and bar (see ``bar_start``); ticks of one time count in id order."""
    order = F.struct("ts", "event_id")
    return ticks.groupBy("symbol", bar_start("ts", unit).alias("bar_ts")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("n_ticks"), *extra,
    )


def complete_buckets(bars: DataFrame, per_bucket: int, slots: int) -> DataFrame:
    """Buckets of ``slots`` slots of a session that have all of their ``per_bucket`` bars, with their last bar's time."""
    bucket = F.floor(F.col("slot") / slots).alias("bucket")
    return (
        bars.groupBy("symbol", "trade_date", bucket)
        .agg(
            F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_ts").alias("close"),
            F.sum("volume").alias("volume"), F.count("*").alias("n"), F.max("slot").alias("last_slot"), F.max("bar_ts").alias("decision_ts"),
        )
        .where((F.col("n") == per_bucket) & (F.col("last_slot") % slots == slots - 1))
    )
