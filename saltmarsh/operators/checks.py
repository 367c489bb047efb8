"""Checks that name what is wrong: day files against a contract calendar, samples against splits, trades by nine dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.functions.normalise import route
from saltmarsh.operators import ranks
from saltmarsh.operators.matrix import SPECIAL_SESSIONS
from saltmarsh.streaming.jobs import scratch

# Bars of a whole session, the session's closing window and end, and the tolerances of the three comparisons.
BARS = (345, 380)
CLOSING_FROM, WHOLE_UNTIL = "15:00:00", "15:25:00"
TOLERANCE = {"close": 0.001, "volume": 0.05, "oi": 0.05}


def _listed(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def day_validation(bars: DataFrame, calendar: DataFrame, keys: list[str], at: str = "bar_ts", oi_bounds: tuple[float, float] | None = None, special: tuple[date, ...] = SPECIAL_SESSIONS) -> DataFrame:
    """One row for each calendar row (keys, trade_date, front_close, front_volume, lot, front_oi): what its bars show and how they fail.

    The close is the volume-weighted one of the last half hour, volume counts in lots,
    open interest is the last that is not zero.  A day of too few or too many bars, or
    one that ends early, fails; of a day that ends early nothing else is held against
    the calendar.  Where ``oi_bounds`` are given, an open interest off the calendar's
    by a ratio within them is noted as drift.  Values that the calendar lacks are not
    compared; special sessions are skipped.
    """
    time = F.date_format(at, "HH:mm:ss")
    closing = (time >= CLOSING_FROM) & (F.col("volume") > 0) & F.col("close").isNotNull()
    traded = F.coalesce(F.col("oi") != 0, F.lit(False))
    days = bars.groupBy(*keys, F.to_date(at).alias("trade_date")).agg(
        F.count("*").alias("bar_count"), F.max(time).alias("last_time"), F.max_by("close", at).alias("last_close"),
        (F.sum(F.when(closing, F.col("close") * F.col("volume"))) / F.nullif(F.sum(F.when(closing, F.col("volume"))), F.lit(0))).alias("close_vwap"), F.coalesce(F.sum("volume"), F.lit(0)).cast("double").alias("volume"),
        F.coalesce(F.max_by(F.when(traded, F.col("oi")), F.when(traded, F.col(at))), F.max_by("oi", at)).cast("double").alias("close_oi"), F.max(F.when(traded, time)).alias("oi_time"),
    )
    on = [*keys, "trade_date"]
    named = days.select(*[F.col(c).alias(f"d_{c}") for c in on], *[c for c in days.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"d_{c}"))
    df = calendar.select(*on, "front_close", "front_volume", "lot", "front_oi").join(named, match, "left")
    skipped, missing = F.col("trade_date").isin(*special), F.col("bar_count").isNull()
    truncated = F.col("last_time") < WHOLE_UNTIL
    actual = {"close": F.col("close_vwap"), "volume": F.col("volume"), "oi": F.col("close_oi")}
    expected = {"close": F.col("front_close"), "volume": F.col("front_volume") * F.col("lot"), "oi": F.col("front_oi")}

    def off(name: str) -> Column:
        a, e = actual[name].cast("double"), expected[name].cast("double")
        return e.isNotNull() & ~F.coalesce(F.when(e == 0, a == 0).otherwise(F.abs(a - e) / F.abs(e) <= TOLERANCE[name]), F.lit(False))

    drift = F.lit(False)
    if oi_bounds is not None:
        ratio = F.try_divide(expected["oi"].cast("double"), F.nullif(actual["oi"], F.lit(0.0)))
        drift = off("oi") & F.coalesce(ratio.between(*oi_bounds), F.lit(False))
    bad = {"close": off("close"), "volume": off("volume"), "oi": off("oi") & ~drift}
    failures = F.when(skipped, F.array().cast("array<string>")).when(missing, F.array(F.lit("missing_file"))).otherwise(_listed(
        F.when(~F.col("bar_count").between(*BARS), F.lit("bar_count")), F.when(truncated, F.lit("session_truncated")), *[F.when(b & ~truncated, F.lit(n)) for n, b in bad.items()],
    ))
    early = F.when(F.col("oi_time") < F.col("last_time"), F.concat(F.lit("oi_from_"), F.substring(F.replace(F.col("oi_time"), F.lit(":"), F.lit("")), 1, 4), F.lit("_bar")))
    notes = F.when(skipped, F.array(F.lit("special_session"))).when(missing, F.array().cast("array<string>")).otherwise(_listed(F.when(truncated, F.lit("truncated_day")), early, F.when(drift & ~truncated, F.lit("oi_timing_drift"))))
    return df.select(*on, "bar_count", "last_close", "close_vwap", "volume", "close_oi", F.array_join(failures, ",").alias("failures"), F.array_join(notes, ",").alias("notes"), (F.size(failures) == 0).alias("ok"))


def split_violations(samples: DataFrame, splits: DataFrame, name: str, split: str, day: str, embargo_days: int) -> DataFrame:
    """What is wrong with samples (name, split or null, day) and splits (name, split, position, from_day, to_day): kind, name, detail.

    ``overlap``: a name in several splits.  ``embargo``: a split's window begins
    within the embargo after that of the position before.  ``unassigned``: a sample of
    no split's name.  ``declared``: a sample that says it is of another split than its
    name's.  ``before`` and ``after``: a sample outside its split's window; an open
    end of a window is null.  Samples are counted by name and day before they meet.
    """
    s = splits.select(F.col(name).alias("s_name"), F.col(split).alias("s_split"), "position", "from_day", "to_day")
    overlap = s.groupBy("s_name").agg(F.array_sort(F.collect_set("s_split")).alias("in")).where(F.size("in") > 1).select(F.lit("overlap").alias("kind"), F.col("s_name").cast("string").alias("name"), F.array_join("in", ",").alias("detail"), F.lit(1).cast("long").alias("n"))
    windows = s.groupBy("s_split", "position").agg(F.min("from_day").alias("a"), F.max("to_day").alias("b"))  # as many rows as splits
    order = Window.partitionBy(F.lit(0)).orderBy("position")
    early = windows.withColumn("last", F.lag("b").over(order)).where(F.col("a") < F.date_add("last", embargo_days + 1))
    embargo = early.select(F.lit("embargo").alias("kind"), F.col("s_split").alias("name"), F.concat_ws(" ", F.col("a").cast("string"), F.col("last").cast("string")).alias("detail"), F.lit(1).cast("long").alias("n"))
    counts = samples.groupBy(F.col(name).alias("name"), F.col(split).alias("declared"), F.col(day).alias("day")).agg(F.count("*").alias("n"))
    first = s.groupBy("s_name").agg(F.min_by(F.struct("s_split", "from_day", "to_day"), "position").alias("w"))
    met = counts.join(first, F.col("name") == F.col("s_name"), "left")
    kind = F.when(F.col("w").isNull(), "unassigned").when(F.col("declared") != F.col("w.s_split"), "declared").when(F.col("day") < F.col("w.from_day"), "before").when(F.col("day") > F.col("w.to_day"), "after")
    detail = F.when(F.col("w").isNull(), F.lit("")).when(F.col("declared") != F.col("w.s_split"), F.concat_ws(" ", "declared", "w.s_split")).otherwise(F.col("w.s_split"))
    wrong = met.select(kind.alias("kind"), F.col("name").cast("string").alias("name"), detail.alias("detail"), "n").where("kind IS NOT NULL").groupBy("kind", "name", "detail").agg(F.sum("n").alias("n"))
    return overlap.unionByName(embargo).unionByName(wrong)


def no_leakage(samples: DataFrame, splits: DataFrame, name: str, split: str, day: str, embargo_days: int) -> None:
    """Raise with up to five violations where there are any."""
    found = split_violations(samples, splits, name, split, day, embargo_days).orderBy("kind", "name").limit(5).collect()
    if found:
        raise AssertionError("; ".join(f"{r['kind']} {r['name']} {r['detail']}".strip() for r in found))


#: Dimensions of ``nine_ways``.
DIMENSIONS = ("side", "symbol", "sector", "month", "rolling_20_sessions", "trend_regime", "volatility_regime", "gap_regime", "session_phase")


def nine_ways(rows: DataFrame, at: str = "bar_ts", block: int = 20) -> DataFrame:
    """dim, level, n, trades (rows with a side), mean net and hit rate of trades, by nine dimensions in one pass.

    ``rows`` has side, symbol, sector, net_bps, return_1 and return_3; a missing return
    counts as 0, a missing sector as unknown.  Blocks of 20 sessions are numbered over
    the table's days, one row a day.
    """
    r1, r3 = F.coalesce("return_1", F.lit(0.0)), F.coalesce("return_3", "return_1", F.lit(0.0))
    day, time = F.to_date(at), F.date_format(at, "HH:mm")
    days = rows.select(day.alias("b_day")).distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("b_day")) - 1).withColumn("n_days", F.count("*").over(Window.partitionBy(F.lit(0))))
    start = F.floor(F.col("i") / block) * block
    days = days.select("b_day", F.concat(start + 1, F.lit("-"), F.least(start + block, F.col("n_days"))).alias("rolling_20_sessions"))
    df = rows.withColumns({
        "__day": day, "sector": F.coalesce("sector", F.lit("unknown")), "month": F.date_format(at, "yyyy-MM"), "trend_regime": F.when(r3 > 0, "up").otherwise("down_or_flat"),
        "volatility_regime": F.when(F.abs(r1) >= 0.01, "high").otherwise("low"), "gap_regime": F.when(F.abs(r1) >= 0.005, "gap").otherwise("no_gap"),
        "session_phase": F.when(time < "10:00", "open").when(time < "14:30", "mid").otherwise("close"),
    }).join(days, F.col("__day") == F.col("b_day"))
    net = F.when(F.col("side") != "NO_TRADE", F.col("net_bps"))
    g = df.groupingSets([[F.col(d)] for d in DIMENSIONS], *DIMENSIONS).agg(F.count("*").alias("n"), F.count(net).alias("trades"), F.avg(net).alias("net"), F.avg((net > 0).cast("double")).alias("hit_rate"), *[F.grouping(d).alias(f"__g_{d}") for d in DIMENSIONS])
    pick = lambda f: F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, f(d)) for d in DIMENSIONS])
    return g.select(pick(F.lit).alias("dim"), pick(lambda d: F.col(d).cast("string")).alias("level"), "n", "trades", "net", "hit_rate")


def futures_feed(df: DataFrame, is_future: Column, at: str = "bar_ts", order: tuple[str, ...] = ("bar_ts",), require_volume: bool = True, stale_after: int = 5, stale_fails: bool = False) -> DataFrame:
    """``df`` with ``failures`` and ``warnings`` (arrays) of a futures feed's rows.

    ``df`` has symbol, tradingsymbol, instrument_token, expiry, continuous (a rolled
    series needs none of the three), volume and oi.  Open interest is stale from the
    ``stale_after``-th repetition on of one positive value of the symbol; rows without
    positive open interest neither repeat nor end such a run.
    """
    positive = F.col("oi") > 0
    seen = Window.partitionBy("symbol").orderBy(*order)
    before = F.last(F.when(positive, F.col("oi")), ignorenulls=True).over(seen.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("__new", F.when(positive & ~F.coalesce(F.col("oi") == before, F.lit(False)), 1).otherwise(0))
    df = df.withColumn("__run", F.sum("__new").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    repeated = F.sum(F.when(positive, 1).otherwise(0)).over(Window.partitionBy("symbol", "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - 1
    df = df.withColumn("__stale", positive & (F.lit(stale_after) > 0) & (repeated >= stale_after))
    rolled, blank = F.coalesce("continuous", F.lit(False)), lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    bad_oi, bad_volume = F.coalesce(F.col("oi") < 0, F.lit(True)), F.coalesce(F.col("volume") < 0, F.lit(True))
    failures = _listed(
        F.when(~F.coalesce(is_future, F.lit(False)), F.lit("index_proxy_or_missing_futures_symbol")), F.when(F.col(at).isNull(), F.lit("missing_timestamp")),
        *[F.when(~rolled & blank(c), F.lit(f"missing_{c}")) for c in ("expiry", "tradingsymbol", "instrument_token")],
        F.when(bad_oi, F.lit("missing_or_negative_oi")), F.when(F.col("__stale") & F.lit(stale_fails), F.lit("stale_oi")), F.when(bad_volume & F.lit(require_volume), F.lit("missing_or_negative_volume")),
    )
    warnings = _listed(F.when(F.col("oi") == 0, F.lit("zero_oi")), F.when(F.col("__stale") & ~F.lit(stale_fails), F.lit("stale_oi")), F.when(F.col("volume") == 0, F.lit("zero_volume")))
    return df.withColumns({"failures": failures, "warnings": warnings}).drop("__new", "__run", "__stale")


def feed_summary(checked: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows, shares of zero open interest and volume, rows with failures and with warnings, and whether the feed passes."""
    g = checked.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg((F.coalesce(F.col("oi"), F.lit(-1)) == 0).cast("double")).alias("zero_oi_share"), F.avg((F.coalesce(F.col("volume"), F.lit(-1)) == 0).cast("double")).alias("zero_volume_share"),
        F.count_if(F.size("failures") > 0).alias("failed"), F.count_if(F.size("warnings") > 0).alias("warned"),
    )
    return g.withColumn("validated", (F.col("rows") > 0) & (F.col("failed") == 0))


# Bounds of the ratio of expected to observed open interest.
NEAR_ONE, X100_FROM, X100 = (0.5, 2.0), 10.0, 100


def oi_regimes(bars: DataFrame, calendar: DataFrame, keys: list[str], at: str = "bar_ts") -> DataFrame:
    """One row a key and day of ``bars``: expected over last non-zero open interest, and the regime of its scale.

    ``calendar`` has the keys, trade_date and front_oi.
    """
    traded = F.coalesce(F.col("oi") != 0, F.lit(False))
    days = bars.groupBy(*keys, F.to_date(at).alias("trade_date")).agg(F.max_by(F.when(traded, F.col("oi")), F.when(traded, F.col(at))).cast("double").alias("raw_oi"))
    on = [*keys, "trade_date"]
    df = days.join(calendar.select(*on, F.col("front_oi").cast("double").alias("expected_oi")), on, "left").withColumn("ratio", F.col("expected_oi") / F.col("raw_oi"))
    regime = F.when(F.col("ratio").isNull(), "unknown").when(F.col("ratio").between(*NEAR_ONE), "near_one").when(F.col("ratio") >= X100_FROM, "x100_raw_oi").otherwise("ambiguous")
    return df.withColumn("regime", regime)


def oi_boundaries(regimes: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: the first day off by a hundred, the last day near one before it, and the days of each regime."""
    first = regimes.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(F.when(F.col("regime") == "x100_raw_oi", F.col("trade_date"))).alias("first_x100"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    near = (F.col("regime") == "near_one") & (F.col("trade_date") < F.col("first_x100"))
    return regimes.join(first, on).groupBy(*keys, "first_x100").agg(
        F.max(F.when(near, F.col("trade_date"))).alias("last_near_one_before"), *[F.count_if(F.col("regime") == r).alias(f"n_{r}") for r in ("near_one", "x100_raw_oi", "ambiguous", "unknown")],
    )


def rescaled_oi(bars: DataFrame, regimes: DataFrame, keys: list[str], at: str = "bar_ts") -> DataFrame:
    """``bars`` with open interest times 100 on the days that are off by a hundred; other days as they are."""
    off = regimes.where("regime = 'x100_raw_oi'").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("trade_date").alias("__day"))
    on = F.to_date(at) == F.col("__day")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = bars.join(off, on, "left")
    return met.withColumn("oi", F.when(F.col("__day").isNotNull(), F.col("oi") * X100).otherwise(F.col("oi"))).select(*bars.columns)


# Scaled deviations and, where the deviation of half the returns is nothing, the plain one from which a return is an outlier; returns that a source needs.
OUTLIER, OUTLIER_FLAT, OUTLIER_LEAST = 8.0, 0.05, 5


def session_outliers(rows: DataFrame, source: list[str], at: str, order: str, price: str) -> DataFrame:
    """``rows`` with ret (from the row before it on the same day) and outlier, by the source's median return and median deviation.

    Both medians are exact and found by narrowing brackets, so no task holds a source's
    returns.  A first row of a day has no return and is no outlier; a source with too
    few returns has none.  The returns are written once, as several passes read them.
    """
    before = F.lag(price).over(Window.partitionBy(*source, F.to_date(at)).orderBy(at, order))
    folder = f"{scratch(rows.sparkSession)}/returns"
    rows.withColumn("ret", F.try_divide(F.col(price), before.cast("double")) - 1).write.parquet(folder)
    r = rows.sparkSession.read.parquet(folder)
    counts = r.groupBy(*source).agg(F.count("ret").alias("__n"))
    d = r.join(ranks.interpolated(r, source, "ret", {"__med": 0.5}), source, "left").withColumn("__dev", F.abs(F.col("ret") - F.col("__med")))
    d = d.join(ranks.interpolated(d, source, "__dev", {"__mad": 0.5}), source, "left").join(counts, source, "left")
    far = F.when(F.col("__mad") == 0, F.col("__dev") > OUTLIER_FLAT).otherwise(F.col("__dev") / (1.4826 * F.col("__mad")) > OUTLIER)
    return d.withColumn("outlier", F.coalesce((F.col("__n") >= OUTLIER_LEAST) & far, F.lit(False))).select(*rows.columns, "ret", "outlier")


def reject_router(df: DataFrame, tests: dict[str, Column], source: list[str], keys: list[str], at: str, order: str, price: str) -> DataFrame:
    """Every row with its reject_reason: the first failing test, then a repeated key, then a return far from its source's.

    Returns are those of the rows that nothing else rejects; null is silver.
    """
    routed = route(df, tests, keys, order)
    kept = session_outliers(routed.where("reject_reason IS NULL"), source, at, order, price)
    kept = kept.withColumn("reject_reason", F.when(F.col("outlier"), F.lit("outlier_return"))).drop("ret", "outlier")
    return routed.where("reject_reason IS NOT NULL").unionByName(kept)
