"""Causal features of a symbol's rows: every frame ends at or before the current row.

``keys`` partition the rows and ``order`` sorts them; callers pass (symbol) for
features that run across sessions and (symbol, trade_date) for those that start
anew each session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from saltmarsh.operators.ranks import interpolated

SYMBOL, SESSION = ("symbol",), ("symbol", "trade_date")


def rows(keys, order="bar_ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(keys, n: int, order="bar_ts", current: bool = True) -> WindowSpec:
    """The last n rows, with the current one or before it."""
    return rows(keys, order).rowsBetween(-(n - 1) if current else -n, 0 if current else -1)


def so_far(keys, order="bar_ts") -> WindowSpec:
    return rows(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def ratio(a: Column, b: Column, other=0.0) -> Column:
    """a / b - 1, or ``other`` where either is missing or b is zero."""
    return F.when(a.isNotNull() & b.isNotNull() & (b != 0), a / b - 1).otherwise(F.lit(other))


def full(value: Column, w: WindowSpec, n: int) -> Column:
    """``value`` where the frame has n rows."""
    return F.when(F.count(F.lit(1)).over(w) >= n, value)


def price_returns(df: DataFrame, windows=(1, 3, 6, 12)) -> DataFrame:
    w = rows(SYMBOL)
    return df.withColumns({f"return_{n}": ratio(F.col("close"), F.lag("close", n).over(w)) for n in windows})


def opening_gap(df: DataFrame) -> DataFrame:
    """Open against the last close before it that is not zero."""
    before = F.last(F.when(F.col("close") != 0, F.col("close")), ignorenulls=True).over(rows(SYMBOL).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("gap", ratio(F.col("open"), before))


def liquidity(df: DataFrame, n: int = 20) -> DataFrame:
    """Traded value, its mean over the n rows before (the current one where there are none), and a bucket."""
    df = df.withColumn("traded_value", F.col("close") * F.col("volume"))
    adv = F.coalesce(F.avg("traded_value").over(trailing(SYMBOL, n, current=False)), F.col("traded_value"))
    return df.withColumn("adv", adv).withColumn("liquidity_bucket", F.when(F.col("adv") >= 50_000, "high").when(F.col("adv") >= 5_000, "medium").otherwise("low"))


def volatility(df: DataFrame, n: int = 20) -> DataFrame:
    """Range, range in bps of the close, and the population deviation of the n returns before the row."""
    r = F.lag("close").over(rows(SYMBOL))
    df = df.withColumn("bar_range", F.col("high") - F.col("low")).withColumn("range_bps", F.when(F.col("close") != 0, F.col("bar_range") / F.col("close") * 10_000).otherwise(0.0))
    return df.withColumn("r1", F.when(r != 0, F.col("close") / r - 1)).withColumn("volatility", F.coalesce(F.stddev_pop("r1").over(trailing(SYMBOL, n, current=False)), F.lit(0.0)))


def volume_ratio(df: DataFrame, n: int = 20) -> DataFrame:
    mean = F.avg("volume").over(trailing(SYMBOL, n, current=False))
    return df.withColumn("volume_ratio", F.when(mean > 0, F.col("volume") / mean).otherwise(1.0)).withColumn("volume_shock", F.col("volume_ratio") - 1)


def running_vwap(df: DataFrame, keys=SYMBOL, price: str = "close") -> DataFrame:
    w = so_far(keys)
    df = df.withColumn("vwap", F.coalesce(F.try_divide(F.sum(F.col(price) * F.col("volume")).over(w), F.sum("volume").over(w)), F.col("close")))
    return df.withColumn("vwap_distance", ratio(F.col("close"), F.col("vwap"))).withColumn("vwap_bps", F.col("vwap_distance") * 10_000)


def cross_section_rank(df: DataFrame, score: str, at: str = "bar_ts", name: str = "symbol") -> DataFrame:
    """Ordinal rank / (n - 1) within a time, ties by name."""
    w = Window.partitionBy(at)
    return df.withColumn("cs_rank", (F.row_number().over(w.orderBy(score, name)) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1)))


def five_minute_block(df: DataFrame) -> DataFrame:
    """Returns with the session's first close as fallback base, typical-price VWAP, mean range of 14, deviation of 20, volume ratio, gap, open-to-now, scaled return, phase."""
    w, day = rows(SYMBOL), rows(SESSION)
    first = F.first("close").over(so_far(SYMBOL))
    for n in (1, 3, 6, 12):
        df = df.withColumn(f"ret_{n}", ratio(F.col("close"), F.coalesce(F.lag("close", n).over(w), first)))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = df.withColumn("typical", typical)
    df = running_vwap(df, SESSION, "typical")
    df = df.withColumn("atr_14", F.avg(F.col("high") - F.col("low")).over(trailing(SYMBOL, 14))).withColumn("vol_20", F.coalesce(F.stddev_pop("ret_1").over(trailing(SYMBOL, 20)), F.lit(0.0)))
    mean = F.avg("volume").over(trailing(SYMBOL, 20))
    df = df.withColumn("vol_ratio", F.when(mean > 0, F.col("volume") / mean).otherwise(1.0))
    df = df.withColumn("seq", F.row_number().over(day)).withColumn("session_gap", F.when(F.col("seq") == 1, ratio(F.col("open"), F.lag("close").over(w))).otherwise(0.0))
    df = df.withColumn("open_to_now", ratio(F.col("close"), F.first("open").over(so_far(SESSION))))
    df = df.withColumn("scaled_return", F.when(F.col("vol_20") > 0, F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col("ret_1") / F.col("vol_20")))).otherwise(0.0))
    return df.withColumn("phase", F.when(F.col("slot") < 8, "open").when(F.col("slot") < 16, "middle").otherwise("close"))


def sector_signal(df: DataFrame, sector: Column, value: str = "return_1") -> DataFrame:
    df = df.withColumn("sector", sector).withColumn("sector_return", F.avg(value).over(Window.partitionBy("bar_ts", "sector")))
    return df.withColumn("vs_sector", F.col(value) - F.col("sector_return"))


def momentum_bps(df: DataFrame, n: int, keys=SESSION) -> DataFrame:
    before = F.lag("close", n).over(rows(keys))
    return df.withColumn("momentum_bps", F.when(before != 0, (F.col("close") / before - 1) * 10_000))


def breakouts(df: DataFrame, n: int, keys=SESSION) -> DataFrame:
    w = trailing(keys, n, current=False)
    high, low = full(F.max("high").over(w), w, n), full(F.min("low").over(w), w, n)
    return df.withColumn("breakout", F.coalesce(F.col("close") > high, F.lit(False))).withColumn("breakdown", F.coalesce(F.col("close") < low, F.lit(False)))


def realized_vol_bps(df: DataFrame, n: int, keys=SESSION) -> DataFrame:
    before = F.lag("close").over(rows(keys))
    return df.withColumn("r_bps", F.when(before != 0, (F.col("close") / before - 1) * 10_000)).withColumn("realized_vol_bps", F.coalesce(F.stddev_samp("r_bps").over(trailing(keys, n)), F.lit(0.0)))


def signal_gate(df: DataFrame, n: int = 4, min_vol_bps: float = 1.0, first_slot: int = 2, last_slot: int = 20) -> DataFrame:
    """Long or short where momentum and breakout agree, inside the session hours, with enough volatility."""
    df = realized_vol_bps(breakouts(momentum_bps(df, n), n), n)
    open_ = F.col("slot").between(first_slot, last_slot) & (F.col("realized_vol_bps") >= min_vol_bps)
    side = F.when(open_ & F.col("breakout") & (F.col("momentum_bps") > 0), 1).when(open_ & F.col("breakdown") & (F.col("momentum_bps") < 0), -1).otherwise(0)
    return df.withColumn("gate", side.cast("long"))


def opening_range(df: DataFrame, k: int = 3, buffer_bps: float = 5.0, volume_window: int = 5, last_slot: int = 20) -> DataFrame:
    """Break of the first k bars' range by more than a buffer, with volume above the median of the bars before."""
    day = Window.partitionBy(*SESSION)
    df = df.withColumn("seq", F.row_number().over(rows(SESSION)))
    df = df.withColumn("or_high", F.max(F.when(F.col("seq") <= k, F.col("high"))).over(day)).withColumn("or_low", F.min(F.when(F.col("seq") <= k, F.col("low"))).over(day))
    df = df.withColumn("median_volume", F.percentile("volume", 0.5).over(trailing(SESSION, volume_window, current=False)))
    ok = (F.col("seq") > k) & (F.col("slot") <= last_slot) & (F.col("volume") > F.col("median_volume"))
    up, down = F.col("close") > F.col("or_high") * (1 + buffer_bps / 10_000), F.col("close") < F.col("or_low") * (1 - buffer_bps / 10_000)
    return df.withColumn("or_signal", F.when(ok & up, 1).when(ok & down, -1).otherwise(0).cast("long"))


def basis_zscore(df: DataFrame, value: str, reset: Column, n: int) -> DataFrame:
    """z-score of the last n values since the last reset, where n are there."""
    df = df.withColumn("epoch", F.sum(F.when(reset, 1).otherwise(0)).over(so_far(SYMBOL)))
    w = trailing(("symbol", "epoch"), n)
    sd = full(F.stddev_samp(value).over(w), w, n)
    return df.withColumn("basis_z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def roll_flag(df: DataFrame, share: float = 0.2, days: int = 20) -> DataFrame:
    """1 from the bar on whose oi jumps by more than a share, or by twice the median of the daily medians before."""
    prev = F.lag("oi").over(rows(SESSION))
    df = df.withColumn("oi_jump", F.when((F.col("oi") > 0) & (prev > 0), F.abs(F.col("oi") - prev))).withColumn("oi_prev", prev)
    per_day = df.groupBy(*SESSION).agg(F.percentile("oi_jump", 0.5).alias("day_median"))
    history = per_day.withColumn("history", F.percentile("day_median", 0.5).over(Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-days, -1))).select(F.col("symbol").alias("h_symbol"), F.col("trade_date").alias("h_date"), "history")
    df = df.join(history, (F.col("symbol") == F.col("h_symbol")) & (F.col("trade_date") == F.col("h_date")), "left")
    hit = (F.col("oi_jump") > share * F.col("oi_prev")) | (F.col("oi_jump") > 2 * F.col("history"))
    return df.withColumn("rolled", F.max(F.when(hit, 1).otherwise(0)).over(so_far(SESSION)).cast("long"))


def prior_session_close(df: DataFrame) -> DataFrame:
    """Last close of the session before, by way of one row a session."""
    days = df.groupBy(*SESSION).agg(F.max_by("close", "bar_ts").alias("day_close"))
    before = days.withColumn("prior_close", F.lag("day_close").over(Window.partitionBy("symbol").orderBy("trade_date"))).select(F.col("symbol").alias("p_symbol"), F.col("trade_date").alias("p_date"), "prior_close")
    return df.join(before, (F.col("symbol") == F.col("p_symbol")) & (F.col("trade_date") == F.col("p_date"))).drop("p_symbol", "p_date").withColumn("true_gap", F.when(F.col("prior_close") != 0, F.first("open").over(so_far(SESSION)) / F.col("prior_close") - 1))


def router_rows(df: DataFrame, n: int = 30) -> DataFrame:
    w = rows(SYMBOL)
    r = F.lag("close").over(w)
    df = df.withColumn("return_bps", F.when(r != 0, (F.col("close") / r - 1) * 10_000).otherwise(0.0))
    df = df.withColumn("vol_bps", F.coalesce(F.stddev_samp("return_bps").over(trailing(SYMBOL, n)), F.lit(0.0)))
    df = df.withColumn("volume_change", F.coalesce(F.col("volume") - F.lag("volume").over(w), F.lit(0))).withColumn("oi_change", F.coalesce(F.col("oi") - F.lag("oi").over(w), F.lit(0)))
    return df.withColumn("volume_oi", F.when(F.col("oi") != 0, F.col("volume") / F.col("oi")).otherwise(0.0))


def session_returns(df: DataFrame, lags=(1, 3, 6)) -> DataFrame:
    for n in lags:
        before = F.lag("close", n).over(rows(SESSION))
        df = df.withColumn(f"ret_{n}", F.when(before > 0, F.col("close") / before - 1)).withColumn(f"log_ret_{n}", F.when((before > 0) & (F.col("close") > 0), F.log(F.col("close") / before)))
    return df


def atr(df: DataFrame, windows=(3, 6), least: int = 3) -> DataFrame:
    before = F.lag("close").over(rows(SESSION))
    df = df.withColumn("true_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return df.withColumns({f"atr_{n}": full(F.avg("true_range").over(trailing(SESSION, n)), trailing(SESSION, n), least) for n in windows})


def annual_vol(df: DataFrame, n: int = 6, per_year: int = 375 * 252, least: int = 3) -> DataFrame:
    before = F.lag("close").over(rows(SESSION))
    df = df.withColumn("lr", F.when((before > 0) & (F.col("close") > 0), F.log(F.col("close") / before)))
    w = trailing(SESSION, n)
    return df.withColumn("annual_vol", F.when(F.count("lr").over(w) >= least, F.stddev_samp("lr").over(w) * math.sqrt(per_year)))


def vwap_slope(df: DataFrame, n: int = 5) -> DataFrame:
    df = running_vwap(df, SESSION)
    return df.withColumn("vwap_slope", F.col("vwap") - F.lag("vwap", n).over(rows(SESSION)))


def opening_range_distance(df: DataFrame, before_slot: int = 3) -> DataFrame:
    """High and low of the slots before ``before_slot``; null until that time, so nothing leaks."""
    day = Window.partitionBy(*SESSION)
    high, low = F.max(F.when(F.col("slot") < before_slot, F.col("high"))).over(day), F.min(F.when(F.col("slot") < before_slot, F.col("low"))).over(day)
    known = F.col("slot") >= before_slot
    df = df.withColumn("or_high", F.when(known, high)).withColumn("or_low", F.when(known, low))
    return df.withColumn("above_or", (F.col("close") > F.col("or_high")).cast("long")).withColumn("below_or", (F.col("close") < F.col("or_low")).cast("long")).withColumn("or_location", F.try_divide(F.col("close") - F.col("or_low"), F.col("or_high") - F.col("or_low")))


def oi_features(df: DataFrame) -> DataFrame:
    w = rows(SESSION)
    d_oi, d_px = F.col("oi") - F.lag("oi").over(w), F.col("close") - F.lag("close").over(w)
    df = df.withColumn("oi_change_1", d_oi).withColumn("oi_change_5", F.col("oi") - F.lag("oi", 5).over(w))
    quadrant = F.when((d_px > 0) & (d_oi > 0), "long_buildup").when((d_px < 0) & (d_oi > 0), "short_buildup").when((d_px > 0) & (d_oi < 0), "short_covering").when((d_px < 0) & (d_oi < 0), "long_unwinding").otherwise("flat")
    return df.withColumn("oi_quadrant", quadrant)


def time_features(df: DataFrame, slots: int = 24) -> DataFrame:
    return df.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("slot") / (slots - 1)))).withColumn("weekday", F.weekday("trade_date").cast("long")).withColumn("progress_sin", F.sin(2 * math.pi * F.col("progress"))).withColumn("progress_cos", F.cos(2 * math.pi * F.col("progress")))


def streak(df: DataFrame, equal_resets: bool = False) -> DataFrame:
    """Length of the run of rising (positive) or falling closes; an equal close falls, or with ``equal_resets`` opens a run at 0."""
    w = rows(SESSION)
    change = F.col("close") - F.lag("close").over(w)
    sign = F.when(change > 0, 1).when(change < 0, -1).when(change == 0, 0 if equal_resets else -1)
    df = df.withColumn("dir", sign)
    df = df.withColumn("new_run", F.when(F.col("dir").isNull() | (F.col("dir") != F.coalesce(F.lag("dir").over(w), F.lit(9))), 1).otherwise(0)).withColumn("run", F.sum("new_run").over(so_far(SESSION)))
    n = F.row_number().over(rows((*SESSION, "run")))
    return df.withColumn("streak", F.coalesce(n * F.col("dir"), F.lit(0)).cast("long"))


def ema(df: DataFrame, value: str, span: int, out: str, keys=SESSION, order: str = "bar_ts") -> DataFrame:
    """Exponential mean e = e + a (x - e), a = 2 / (span + 1), from the first row of the keys on.

    A row is an affine map of e.  Within a block of rows the maps compose to a
    running sum of the values over powers of 1 - a; between blocks the last two
    carry over, as what is older has a weight below 1e-150.  So a key's rows are
    walked once, and nothing is collected.
    """
    a, w = 2.0 / (span + 1), rows(keys, order)
    if span == 1:
        return df.withColumn(out, F.col(value))
    keep = 1 - a
    block = max(2, int(-150 * math.log(10) / math.log(keep)))
    names = {n: f"{out}__{n}" for n in ("at", "k", "block", "own", "carry")}
    at = F.col(names["at"])
    df = df.withColumn(names["at"], F.row_number().over(w) - 1).withColumn(names["k"], F.pmod(at, F.lit(block))).withColumn(names["block"], F.floor(at / block))
    k = F.col(names["k"])
    term = F.when(at == 0, F.col(value)).otherwise(F.col(value) * a) * F.pow(F.lit(keep), -k)
    df = df.withColumn(names["own"], F.pow(F.lit(keep), k) * F.sum(term).over(so_far((*keys, names["block"]), order)))
    last = lambda n: F.max_by(names["own"], names["at"]).over(Window.partitionBy(*keys).orderBy(names["block"]).rangeBetween(-n, -n))
    carry = F.coalesce(last(1), F.lit(0.0)) + keep**block * F.coalesce(last(2), F.lit(0.0))
    return df.withColumn(names["carry"], carry).withColumn(out, F.col(names["own"]) + F.pow(F.lit(keep), k + 1) * F.col(names["carry"])).drop(*names.values())


def ema_slope(df: DataFrame, spans=(9, 21)) -> DataFrame:
    """Fast less slow exponential mean of the session's closes."""
    df = ema(ema(df, "close", spans[0], "ema_fast"), "close", spans[1], "ema_slow")
    return df.withColumn("ema_slope", F.col("ema_fast") - F.col("ema_slow"))


def volume_z(df: DataFrame, n: int = 30, least: int = 5) -> DataFrame:
    w = trailing(SESSION, n)
    sd = full(F.stddev_samp("volume").over(w), w, least)
    return df.withColumn("volume_z", F.when(sd > 0, (F.col("volume") - F.avg("volume").over(w)) / sd))


def flow_means(df: DataFrame, value: str, n: int = 5, order: str = "date") -> DataFrame:
    """Trailing mean of a daily series; the series has one row a day, so one task holds it."""
    return df.withColumn("flow_mean", F.avg(value).over(Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(-(n - 1), 0)))


def with_session_index(df: DataFrame) -> DataFrame:
    """Dense index of each symbol's sessions, by way of one row a session."""
    days = df.select(*SESSION).distinct()
    index = days.withColumn("session_idx", F.row_number().over(Window.partitionBy("symbol").orderBy("trade_date")).cast("long")).select(F.col("symbol").alias("i_symbol"), F.col("trade_date").alias("i_date"), "session_idx")
    return df.join(index, (F.col("symbol") == F.col("i_symbol")) & (F.col("trade_date") == F.col("i_date"))).drop("i_symbol", "i_date")


def same_slot(df: DataFrame, value: str, sessions: int = 60, least: int = 20) -> DataFrame:
    """Mean, population deviation and median of the value at the same slot in the sessions before, by session position."""
    w = Window.partitionBy("symbol", "slot").orderBy("session_idx").rangeBetween(-sessions, -1)
    n = F.count(value).over(w)
    guard = lambda c: F.when(n >= least, c)
    return df.withColumn("base_mean", guard(F.avg(value).over(w))).withColumn("base_sd", guard(F.stddev_pop(value).over(w))).withColumn("base_median", guard(F.percentile(value, 0.5).over(w))).withColumn(
        "slot_z", F.when(F.col("base_sd") > 0, (F.col(value) - F.col("base_mean")) / F.col("base_sd"))
    ).withColumn("median_ratio", F.when(F.col("base_median") > 0, F.col(value) / F.col("base_median")))


def volume_surprise(df: DataFrame, sessions: int = 60, least: int = 20) -> DataFrame:
    df = same_slot(df, "volume", sessions, least)
    return df.withColumn("volume_surprise", F.when((F.col("base_median") > 0) & (F.col("volume") > 0), F.log(F.col("volume") / F.col("base_median"))))



def causal_regime(df: DataFrame, value: str, trend: str, sessions: int = 60, least: int = 20) -> DataFrame:
    """Regime from the value's quartiles at the same slot in the sessions before; null while fewer than ``least`` are there."""
    w = Window.partitionBy("symbol", "slot").orderBy("session_idx").rangeBetween(-sessions, -1)
    n = F.count(value).over(w)
    df = df.withColumns({f"q{int(q * 100)}": F.when(n >= least, F.percentile(value, q).over(w)) for q in (0.25, 0.75, 0.9)})
    v, t = F.col(value), F.col(trend)
    regime = F.when(v >= F.col("q90"), "shock").when(v >= F.col("q75"), "high_vol").when(v <= F.col("q25"), "compression").when(t > 0, "trend_up").when(t < 0, "trend_down").otherwise("range")
    return df.withColumn("regime", F.when(F.col("q25").isNotNull() & v.isNotNull(), regime))


def full_frame_regime(df: DataFrame, value: str, trend: str) -> DataFrame:
    """The same labels from quantiles of the whole frame (not causal; for reports)."""
    q = interpolated(df, [], value, {"q25": 0.25, "q75": 0.75, "q90": 0.9})
    v, t = F.col(value), F.col(trend)
    regime = F.when(v >= F.col("q90"), "shock").when(v >= F.col("q75"), "high_vol").when(v <= F.col("q25"), "compression").when(t > 0, "trend_up").when(t < 0, "trend_down").otherwise("range")
    return df.crossJoin(F.broadcast(q)).withColumn("regime", regime)


def session_zscore(df: DataFrame, daily_value: Column, sessions: int = 60, least: int = 20) -> DataFrame:
    """z-score of one value a session against the sessions before."""
    days = df.groupBy(*SESSION).agg(daily_value.alias("session_value"))
    w = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(-sessions, -1)
    n = F.count("session_value").over(w)
    sd = F.when(n >= least, F.stddev_pop("session_value").over(w))
    return days.withColumn("session_z", F.when(sd > 0, (F.col("session_value") - F.avg("session_value").over(w)) / sd))


def path_features(df: DataFrame, n: int = 5) -> DataFrame:
    """Trend efficiency, pullback depth, range expansion, gap fill; null until the window is full."""
    w, one = trailing(SESSION, n), rows(SESSION)
    df = df.withColumn("step", F.abs(F.col("close") - F.lag("close").over(one)))
    path = F.sum("step").over(w)
    df = df.withColumn("efficiency", full(F.try_divide(F.abs(F.col("close") - F.lag("close", n - 1).over(one)), F.sum("step").over(trailing(SESSION, n - 1))), w, n))
    high, low = F.max("high").over(w), F.min("low").over(w)
    df = df.withColumn("pullback", full(F.try_divide(high - F.col("close"), high - low), w, n)).withColumn("path", full(path, w, n))
    before = F.avg(F.col("high") - F.col("low")).over(trailing(SESSION, n, current=False))
    return df.withColumn("range_expansion", F.when((F.count(F.lit(1)).over(trailing(SESSION, n, current=False)) == n) & (before > 0), (F.col("high") - F.col("low")) / before))


def scaled_returns(df: DataFrame, lags=(1, 3, 6), slots: int = 24, n: int = 6) -> DataFrame:
    df = annual_vol(session_returns(df, lags), n)
    for k in lags:
        unit = F.col("annual_vol") * math.sqrt(k / slots)
        df = df.withColumn(f"scaled_{k}", F.when(unit > 0, F.col(f"ret_{k}") / unit))
    return df


def eligibility(df: DataFrame, horizon: int, first_slot: int, last_slot: int) -> DataFrame:
    """Label-side guard: within the hours, and the next ``horizon`` slots of the session are all there."""
    ahead = F.lead("slot", horizon).over(rows(SESSION))
    return df.withColumn("eligible", (F.col("slot").between(first_slot, last_slot) & F.coalesce(ahead == F.col("slot") + horizon, F.lit(False))))


def forward_returns(df: DataFrame, horizons=(1, 3), name: str = "name", date: str = "date", value: str = "value") -> DataFrame:
    """Labels: forward returns in bps by rows of the name; rank (descending) and percentile within a date."""
    w = Window.partitionBy(name).orderBy(date)
    for h in horizons:
        df = df.withColumn(f"fwd_{h}", F.when(F.col(value) != 0, (F.lead(value, h).over(w) / F.col(value) - 1) * 10_000))
    first = f"fwd_{horizons[0]}"
    known = df.where(F.col(first).isNotNull())
    d = Window.partitionBy(date)
    known = known.withColumn("rank", F.row_number().over(d.orderBy(F.col(first).desc(), name)).cast("long"))
    return known.withColumn("pct", 1 - (F.col("rank") - 1) / F.greatest(F.count("*").over(d) - 1, F.lit(1)))
