"""Exact order statistics without a task that holds or sorts all values.

The values at given ranks are found by narrowing brackets: a pass counts the values
of each bracket in equal cells, with the least and greatest value that each cell
really has; the cell that holds the rank is the next bracket, until its ends are
equal.  Cells are equal in value and, every other pass, in logarithm.  A pass has
partial counts of CELLS rows a target and nothing else, so a billion distinct values
take three or four passes, and repeated values cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.streaming.jobs import scratch

CELLS = 1024
#: Passes at most; doubles of any size need fewer than a dozen.
PASSES = 64


def at_ranks(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, target, value) for each row of ``wanted`` (keys, target, rank), ranks from 0 among the key's values that are not null or NaN; ranks past the last have no row.

    Groups and targets are reports' rows: their brackets are written and joined, and
    AQE splits a group that has most of the values.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__v"))
    k = [f"__k{i}" for i in range(len(keys))]
    named = lambda d, *more: d.select(*[F.col(c).alias(n) for c, n in zip(keys, k, strict=True)], *more)
    ends = named(rows.groupBy(*keys).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count("*").alias("n")), "lo", "hi", "n")
    asked = wanted.select(*keys, "target", F.col("rank").cast("long").alias("rank"))
    open_ = asked.join(ends, _same(keys, k)) if keys else asked.crossJoin(F.broadcast(ends))
    open_ = named(open_.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))), "target", "rank", "lo", "hi")
    folder, done = scratch(df.sparkSession), None
    for turn in range(PASSES):
        # The rank counts within the bracket.
        open_.write.parquet(f"{folder}/{turn}")
        open_ = df.sparkSession.read.parquet(f"{folder}/{turn}")
        found = open_.where("lo = hi").select(*k, "target", F.col("lo").alias("found"))
        done = found if done is None else done.unionByName(found)
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            break
        met = rows.join(open_, (_same(keys, k) if keys else F.lit(True)) & F.col("__v").between(F.col("lo"), F.col("hi")))
        low, at, high = (_scaled(F.col(c), turn) for c in ("lo", "__v", "hi"))
        share = F.when(high > low, (at - low) / (high - low)).otherwise((F.col("__v") > F.col("lo")).cast("double"))
        cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
        cells = met.groupBy(*k, "target", "rank", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*k, "target").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = cells.withColumn("before", before).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        open_ = inside.select(*k, "target", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keys, k, strict=True)], "target", F.col("found").alias(value))


def _scaled(c: Column, turn: int) -> Column:
    """The value on the scale of this pass: halved (the width of all doubles would not be finite), or every other time its logarithm with its sign."""
    if turn % 2 == 0:
        return c / 2
    size = F.log(F.greatest(F.abs(c), F.lit(1e-307))) + 708.0
    return F.when(c < 0, -size).otherwise(size)


def _same(keys: list[str], names: list[str]) -> Column:
    out = F.lit(True)
    for c, n in zip(keys, names, strict=True):
        out = out & F.col(c).eqNullSafe(F.col(n))
    return out


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One column for each share: the value at the rank nearest to share (n - 1), a half up."""
    return _by_share(df, keys, value, {n: [(p, lambda at: F.floor(at + 0.5))] for n, p in shares.items()})


def interpolated(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One column for each share: between the two values around share (n - 1), as ``percentile`` and ``quantile_cont`` have it."""
    return _by_share(df, keys, value, {n: [(p, F.floor), (p, F.ceil)] for n, p in shares.items()})


def _by_share(df: DataFrame, keys: list[str], value: str, shares: dict[str, list]) -> DataFrame:
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg((F.count("*") - 1).alias("last"))
    targets = [F.struct(F.lit(f"{name} {i}").alias("target"), rank(F.col("last") * p).cast("long").alias("rank")) for name, ranks in shares.items() for i, (p, rank) in enumerate(ranks)]
    wanted = counts.select(*keys, F.explode(F.array(*targets)).alias("t")).select(*keys, "t.*")
    found = at_ranks(df, keys, value, wanted)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == f"{name} {i}", F.col(value))).alias(f"{name} {i}") for name, ranks in shares.items() for i in range(len(ranks))])
    sizes = counts.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(keys)], "last")
    wide = wide.join(sizes, _same(keys, [f"__c{i}" for i in range(len(keys))])) if keys else wide.crossJoin(F.broadcast(sizes))
    out = []
    for name, ranks in shares.items():
        low = F.col(f"`{name} 0`")
        part = F.col("last") * ranks[0][0] - F.floor(F.col("last") * ranks[0][0])
        out.append((low if len(ranks) == 1 else low + part * (F.col(f"`{name} 1`") - low)).alias(name))
    return wide.select(*keys, *out)
