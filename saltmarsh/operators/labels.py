"""Outcomes along the forward path of a row.

A row's path is the array of the next ``horizon`` rows of its keys, built by one
window; barriers depend on the row's own entry, so the first touch is found by
higher-order functions over that array, inside the JVM.  Frames are bounded by
``horizon``.  Where stop and target lie in one bar the stop wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_path(df: DataFrame, keys: list[str], order: str, horizon: int) -> DataFrame:
    """``path``: array of (open, high, low, close) of the next rows."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, horizon)
    return df.withColumn("path", F.collect_list(F.struct("open", "high", "low", "close")).over(w))


def first_touch(df: DataFrame, entry: Column, target: Column, stop: Column, side: int = 1) -> DataFrame:
    """Outcome, bars to exit, exit price, gross bps, best and worst excursion in bps, ambiguity flag.

    ``target`` and ``stop`` are prices; ``side`` is 1 for long and -1 for short.
    Rows without a path are excluded with outcome ``excluded``.
    """
    df = df.withColumn("entry", entry).withColumn("target_px", target).withColumn("stop_px", stop)
    if side > 0:
        hit_target, hit_stop = lambda b: b["high"] >= F.col("target_px"), lambda b: b["low"] <= F.col("stop_px")
        best, worst = "high", "low"
    else:
        hit_target, hit_stop = lambda b: b["low"] <= F.col("target_px"), lambda b: b["high"] >= F.col("stop_px")
        best, worst = "low", "high"
    touches = F.filter(F.transform("path", lambda b, i: F.struct((i + 1).alias("k"), hit_target(b).alias("t"), hit_stop(b).alias("s"))), lambda x: x["t"] | x["s"])
    df = df.withColumn("touch", F.get(touches, F.lit(0)))
    df = df.withColumn("outcome", F.when((F.size("path") == 0) | F.col("entry").isNull(), "excluded").when(F.col("touch").isNull(), "timeout").when(F.col("touch.s"), "stop").otherwise("target"))
    df = df.withColumn("bars_held", F.when(F.col("outcome") != "excluded", F.coalesce("touch.k", F.size("path"))).cast("long"))
    last = F.element_at("path", -1)["close"]
    df = df.withColumn("exit_px", F.when(F.col("outcome") == "stop", F.col("stop_px")).when(F.col("outcome") == "target", F.col("target_px")).when(F.col("outcome") == "timeout", F.when(F.size("path") > 0, last)))
    seen = F.slice("path", 1, F.greatest(F.coalesce("bars_held", F.lit(0)), F.lit(0)).cast("int"))
    bps = lambda px: (px / F.col("entry") - 1) * 10_000 * side
    up, down = (F.array_max, F.array_min) if side > 0 else (F.array_min, F.array_max)
    df = df.withColumn("gross_bps", bps(F.col("exit_px"))).withColumn("mfe_bps", bps(up(F.transform(seen, lambda b: b[best])))).withColumn("mae_bps", bps(down(F.transform(seen, lambda b: b[worst]))))
    return df.withColumn("ambiguous", F.coalesce(F.col("touch.s") & F.col("touch.t"), F.lit(False))).drop("touch")


def percent_barriers(df: DataFrame, keys: list[str], order: str, horizon: int, up: float, down: float, side: int = 1, next_open: bool = True) -> DataFrame:
    """First touch of percent barriers from the next open (or the current close)."""
    df = forward_path(df, keys, order, horizon)
    entry = F.get("path", F.lit(0))["open"] if next_open else F.col("close")
    return first_touch(df, entry, entry * (1 + side * up), entry * (1 - side * down), side)


def atr_barriers(df: DataFrame, keys: list[str], order: str, horizon: int, atr: str, k_target: float, k_stop: float, side: int = 1, cost_bps: float = 0.0) -> DataFrame:
    df = forward_path(df, keys, order, horizon)
    entry = F.get("path", F.lit(0))["open"]
    df = first_touch(df, entry, entry + side * k_target * F.col(atr), entry - side * k_stop * F.col(atr), side)
    risk, reward = k_stop * F.col(atr) / F.col("entry") * 10_000, k_target * F.col(atr) / F.col("entry") * 10_000
    return df.withColumn("net_bps", F.col("gross_bps") - cost_bps).withColumn("breakeven", F.try_divide(risk + cost_bps, risk + reward))


def close_parity(df: DataFrame, keys: list[str], order: str, horizon: int, up: float, down: float) -> DataFrame:
    """Labels from closes only: 1 where the target is reached strictly before the stop."""
    df = forward_path(df, keys, order, horizon)
    reached = lambda test: F.coalesce(F.get(F.filter(F.transform("path", lambda b, i: F.struct(i.alias("i"), b["close"].alias("c"))), lambda x: test(x["c"])), F.lit(0))["i"], F.lit(1 << 30))
    c = F.col("close")
    long_t, long_s = reached(lambda x: x >= c * (1 + up)), reached(lambda x: x <= c * (1 - down))
    short_t, short_s = reached(lambda x: x <= c * (1 - up)), reached(lambda x: x >= c * (1 + down))
    return df.withColumn("long_label", (long_t < long_s).cast("long")).withColumn("short_label", (short_t < short_s).cast("long"))


def _in_order(df: DataFrame, keys: list[str], order: list[Column], returned: str, state: Callable[[], object], step: Callable[[object, tuple], tuple[object, bool]]) -> DataFrame:
    """(keys, returned) of the rows that ``step`` keeps, walking each key's rows in order.

    A task walks its keys' sorted rows with one state at a time, which is all it
    holds; a key of any length passes through, as its choices depend on each other.
    ``step`` gets the state and the values of ``order``.
    """
    n, kind = len(keys), df.schema[returned].dataType.simpleString()
    names = [*[f"k{i}" for i in range(n)], *[f"o{i}" for i in range(len(order))], "r"]
    rows = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)], *[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(returned).alias("r"))
    rows = rows.repartition(*names[:n]).sortWithinPartitions(*names[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, None
        for b in batches:
            kept = []
            for row in zip(*[c.to_pylist() for c in b.columns[:-1]], strict=True):
                if at is None or row[:n] != now:
                    now, at = row[:n], state()
                at, keep = step(at, row[n:])
                kept.append(keep)
            mask = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (*b.columns[:n], b.columns[-1])], [*names[:n], "r"])

    schema = ", ".join([*[f"k{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keys)], f"r {kind}"])
    return rows.select(*names).mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("r").alias(returned))


def keep_disjoint(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows kept in order of start, each only if it starts after the end of the one kept before."""

    def step(until: int, row: tuple) -> tuple[int, bool]:
        return (row[1], True) if row[0] > until else (until, False)

    return _in_order(df, keys, [F.col(start).cast("long"), F.col(end).cast("long")], start, lambda: -1, step)


def daily_admission(df: DataFrame, keys: list[str], order: str, pnl: str, most: int, halt: float) -> DataFrame:
    """At most ``most`` trades of a day in order, and none once the realised sum is at or below ``halt``; a null result counts as 0."""

    def step(at: tuple[int, float], row: tuple) -> tuple[tuple[int, float], bool]:
        n, total = at
        return ((n + 1, total + (row[1] or 0.0)), True) if n < most and total > halt else (at, False)

    return _in_order(df, keys, [F.col(order).cast("long"), F.col(pnl).cast("double")], order, lambda: (0, 0.0), step)


def viability(df: DataFrame, keys: list[str], order: str, horizon: int, geometries: list[tuple[float, float]], cost_bps: float) -> DataFrame:
    """Hit, stop and timeout counts of each (target, stop) geometry in bps, from the close, full horizon only."""
    g = df.sparkSession.createDataFrame([(float(t), float(s)) for t, s in geometries], "target_bps double, stop_bps double")
    paths = forward_path(df, keys, order, horizon).where(F.size("path") == horizon).crossJoin(F.broadcast(g))
    c = F.col("close")
    t = first_touch(paths, c, c * (1 + F.col("target_bps") / 10_000), c * (1 - F.col("stop_bps") / 10_000))
    out = t.groupBy("target_bps", "stop_bps").agg(F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("target", "stop", "timeout")])
    even = F.when(F.col("target_bps") <= cost_bps, 1.0).otherwise((F.col("stop_bps") + cost_bps) / (F.col("target_bps") + F.col("stop_bps")))
    return out.withColumn("hit_rate", F.col("n_target") / F.col("n")).withColumn("breakeven", even)


def best_contract(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """The group with the best mean, ties to the smallest keys; one row."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean_net"), F.count(value).alias("n")).orderBy(F.round("mean_net", 9).desc(), *by).limit(1)
