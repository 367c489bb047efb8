"""A study of score families: candidates by thresholds on validation days, a sealed choice, one evaluation of the sealed days, and its gates.

Rows are scored decisions: family, symbol, day, a probability, an expected edge and a
net outcome for either side.  A row's action at a pair of thresholds follows from two
small numbers (how many thresholds each probability reaches) and from which edge is
greater, so rows are summed by those first and only the sums meet the grid.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDES = ("long", "short")
KEY = ["family", "long_threshold", "short_threshold"]


@dataclass(frozen=True)
class Robust:
    """What a candidate needs on the validation days, in all and on each side that it trades."""

    # The promotion thresholds.
    trades: int = 300
    days: int = 100
    symbol_share: float = 0.2
    symbols: int = 20
    profit_factor: float = 1.05


def _cells(rows: DataFrame, long_thresholds: list[float], short_thresholds: list[float]) -> DataFrame:
    """Sums by family, symbol, day, thresholds reached and greater edge; a side without a positive edge reaches none."""
    def reached(side: str, thresholds: list[float]) -> Column:
        level = sum((F.col(f"{side}_p") >= t).cast("int") for t in sorted(thresholds))
        return F.coalesce(F.when(F.col(f"{side}_edge") > 0, level), F.lit(0))

    first = F.coalesce(F.col("long_edge") >= F.col("short_edge"), F.lit(False))
    sums = []
    for s in SIDES:
        v = F.coalesce(F.col(f"{s}_net").cast("double"), F.lit(0.0))
        sums += [F.sum(v).alias(f"{s}_sum"), F.sum(F.greatest(v, F.lit(0.0))).alias(f"{s}_gain"), F.sum(F.greatest(-v, F.lit(0.0))).alias(f"{s}_loss")]
    levels = {"__l": reached("long", long_thresholds), "__s": reached("short", short_thresholds), "__first": first}
    return rows.withColumns(levels).where("__l + __s > 0").groupBy("family", "symbol", "day", *levels).agg(F.count("*").alias("n"), *sums)


def candidates(rows: DataFrame, long_thresholds: list[float], short_thresholds: list[float]) -> DataFrame:
    """One row a family, pair of thresholds and side (all, long, short) that trades: trades, days, symbols, ev, ci_low, profit_factor, symbol_share.

    A row is a long where its probability reaches the threshold, its edge is positive
    and not less than that of a short that could be; else a short by the same rule.
    ``ci_low`` is the lower end of a 95 % interval with days as clusters.  Null
    probabilities and edges reach nothing; a null outcome counts as 0.
    """
    pairs = [F.struct(F.lit(i + 1).alias("i"), F.lit(float(a)).alias("long_threshold"), F.lit(j + 1).alias("j"), F.lit(float(b)).alias("short_threshold")) for i, a in enumerate(sorted(long_thresholds)) for j, b in enumerate(sorted(short_thresholds))]
    met = _cells(rows, long_thresholds, short_thresholds).withColumn("g", F.explode(F.array(*pairs)))
    long, short = F.col("__l") >= F.col("g.i"), F.col("__s") >= F.col("g.j")
    is_long = long & (F.col("__first") | ~short)
    met = met.where(long | short).withColumn("__side", F.when(is_long, "long").otherwise("short"))
    take = lambda m: F.sum(F.when(F.col("__side") == "long", F.col(f"long_{m}")).otherwise(F.col(f"short_{m}"))).alias(m)
    met = met.select("*", F.col("g.long_threshold").alias("long_threshold"), F.col("g.short_threshold").alias("short_threshold"))
    by = met.withColumn("side", F.explode(F.array(F.lit("all"), F.col("__side")))).groupBy(*KEY, "side", "symbol", "day")
    by = by.agg(F.sum("n").alias("n"), take("sum"), take("gain"), take("loss"))
    key = [*KEY, "side"]
    days = by.groupBy(*key, "day").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "gain", "loss")])
    totals = days.groupBy(*key).agg(
        F.sum("n").alias("trades"), F.count("*").alias("days"), F.sum("sum").alias("s"), F.sum("gain").alias("gain"), F.sum("loss").alias("loss"),
        F.sum(F.col("sum") * F.col("sum")).alias("ss"), F.sum(F.col("sum") * F.col("n")).alias("sn"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"),
    )
    names = by.groupBy(*key, "symbol").agg(F.sum("n").alias("n")).groupBy(*key).agg(F.count("*").alias("symbols"), F.max("n").alias("most"))
    ev = F.col("s") / F.col("trades")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("ss") - 2 * ev * F.col("sn") + ev * ev * F.col("nn"))) / F.col("trades")
    return totals.join(names, key).select(
        *key, "trades", "days", "symbols", ev.alias("ev"), (ev - 1.96 * spread).alias("ci_low"), F.when(F.col("loss") > 0, F.col("gain") / F.col("loss")).otherwise(F.col("gain")).alias("profit_factor"), (F.col("most") / F.col("trades")).alias("symbol_share"),
    )


def robust_candidates(table: DataFrame, families: DataFrame, long_thresholds: list[float], short_thresholds: list[float], need: Robust = Robust()) -> DataFrame:
    """One row for every family (table with ``family``) and pair of thresholds: the figures of all its trades, and ``reasons``, the names of what it fails.

    Each side that a candidate trades has to pass by itself.  A candidate without
    trades fails on ``all_trades`` and has no figures.
    """
    checks = {
        "trades": F.col("trades") >= need.trades, "days": F.col("days") >= need.days, "ev": F.col("ev") > 0, "ci": F.col("ci_low") > 0, "profit_factor": F.col("profit_factor") >= need.profit_factor,
        "share": F.col("symbol_share") <= need.symbol_share, "symbols": F.col("symbols") >= need.symbols,
    }
    failed = F.concat_ws(",", *[F.when(~c, F.concat_ws("_", "side", F.lit(n))) for n, c in checks.items()])
    figures = ["trades", "days", "symbols", "ev", "ci_low", "profit_factor", "symbol_share"]
    t = table.withColumn("__failed", F.nullif(failed, F.lit("")))
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = t.groupBy(*KEY).agg(*[of("all", c).alias(c) for c in figures], F.concat_ws(",", *[of(s, "__failed") for s in ("all", *SIDES)]).alias("reasons"))
    pairs = F.array(*[F.struct(F.lit(float(a)).alias("long_threshold"), F.lit(float(b)).alias("short_threshold")) for a in long_thresholds for b in short_thresholds])
    every = families.select("family").distinct().select("family", F.explode(pairs).alias("g")).select("family", "g.*")
    out = every.join(wide, KEY, "left").withColumn("reasons", F.coalesce("reasons", F.lit("all_trades")))
    return out.withColumn("eligible", F.col("reasons") == "")


def choose(table: DataFrame) -> DataFrame:
    """The best eligible candidate of ``robust_candidates`` as one row; no row means that none is tradable.

    By lower end of the interval, profit factor, expected value, trades, least share of
    one symbol, then name and thresholds.
    """
    return table.where("eligible").orderBy(F.col("ci_low").desc(), F.col("profit_factor").desc(), F.col("ev").desc(), F.col("trades").desc(), "symbol_share", "family", "long_threshold", "short_threshold").limit(1)


def identity(rows: DataFrame) -> DataFrame:
    """One row: an order-free digest of a table that counts repeated rows."""
    columns = sorted(rows.columns)
    digest = F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).cast("string")
    return rows.agg(F.concat_ws(":", F.count("*").cast("string"), digest, F.lit(",".join(columns))).alias("identity"))


def seal(rows: DataFrame, table: DataFrame, path: str) -> None:
    """Write the choice beside the identity of the rows that the study may see, once: a sealed path is never written again."""
    chosen = choose(table).select(*KEY, "trades", "ev", "ci_low")
    identity(rows).join(chosen, F.lit(True), "left").write.mode("errorifexists").parquet(path)


def evaluate(spark: SparkSession, sealed: str, rows: DataFrame, is_test: Column, result: str) -> DataFrame:
    """Figures by side of the sealed choice on the rows of the test days, written to ``result``; that path is spent once.

    Refused are a seal without a choice, rows other than those sealed, and a result
    that is there already.  The result is written by its own job before it is read.
    """
    seal_row = spark.read.parquet(sealed).first()
    if seal_row is None or seal_row["family"] is None:
        raise ValueError("nothing was chosen: the test days must not be spent")
    if identity(rows).first()["identity"] != seal_row["identity"]:
        raise ValueError("these are not the rows that were sealed")
    test = rows.where(is_test & (F.col("family") == seal_row["family"]))
    out = candidates(test, [seal_row["long_threshold"]], [seal_row["short_threshold"]]).withColumn("identity", F.lit(seal_row["identity"]))
    try:
        out.write.mode("errorifexists").parquet(result)
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        raise ValueError("the test days were spent before") from e
    return spark.read.parquet(result)


# What the sealed trades need.
SEALED_TRADES, SEALED_DAYS = 250, 60


def acceptance(sealed: DataFrame, result: DataFrame, trades: int = SEALED_TRADES, days: int = SEALED_DAYS) -> DataFrame:
    """One row a gate of a sealed result: position, gate, passed; a result without trades fails all but the identities."""
    r = result.where("side = 'all'").agg(*[F.max(c).alias(c) for c in ("trades", "days", "ci_low", "profit_factor")])
    same = sealed.select(F.col("identity").alias("__sealed")).join(result.agg(F.max("identity").alias("__result"), F.count_distinct("identity").alias("__n")), F.lit(True), "left")
    row = r.join(same, F.lit(True), "left")
    gates = {
        "identity_present": F.col("__sealed").isNotNull(), "result_matches_seal": (F.col("__n") == 1) & (F.col("__sealed") == F.col("__result")), "has_trades": F.col("trades") > 0,
        "trade_count": F.col("trades") >= trades, "trading_days": F.col("days") >= days, "positive_interval": F.col("ci_low") > 0, "profit_factor_above_one": F.col("profit_factor") > 1,
    }
    listed = F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(n).alias("gate"), F.coalesce(g, F.lit(False)).alias("passed")) for i, (n, g) in enumerate(gates.items())])
    return row.select(F.explode(listed).alias("g")).select("g.*").withColumn("tradable", F.min("passed").over(Window.partitionBy(F.lit(0))))
