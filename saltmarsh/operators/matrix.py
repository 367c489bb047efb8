"""The registered feature matrices of minute bars: a wide one of 33 inputs and one of 23 path inputs.

A bar is known by symbol and bar_ts, a local time without a zone; zoned times are
refused.  Three layers make a row:

- ``intraday``: what the session itself says up to the bar, by windows over (symbol, trade_date);
- ``session_history``: one row a session, with its number, the prior close, and the
  width of its opening range against the 60 sessions before;
- ``minute_baselines``: the same minute of the 60 sessions before, by session number,
  so that a session without that minute counts as one that is missing.

``streaming.jobs.matrix_stream`` computes the last two from keyed state, session by
session, with the same first and last step.  Values that would not be finite (a
division by zero, the logarithm of zero) are null.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.operators.features import SESSION, ema, full, rows, so_far, streak, trailing

#: First minute of a session, its minutes, and those of the opening range.
FIRST, MINUTES, OPENING = 9 * 60 + 15, 375, 15
BASELINE, LEAST, HORIZON = 60, 20, 60
TINY = 1e-8
# Columns of the two matrices in their registered order.
KEYS = ("symbol", "session_date", "bar_ts")
WIDE = (
    "ret_1m", "ret_5m", "ret_15m", "ret_30m", "ret_60m", "log_ret_1m", "log_ret_5m", "log_ret_15m", "log_ret_30m", "natr_5m", "natr_15m", "natr_30m",
    "realized_vol_5m", "realized_vol_15m", "realized_vol_30m", "vwap_dev", "vwap_slope_5m", "or_dist_high", "or_dist_low", "or_breakout_up", "or_breakout_dn",
    "minute_of_day", "hour_of_day", "session_progress", "day_of_week", "true_gap_pct", "consec_bars", "ema_slope", "volume_surprise_60d", "days_to_expiry",
    "expiry_week", "vix_t1_z252", "vix_t1_return",
)
PATH = (
    "vol_normalized_ret_5m", "vol_normalized_ret_15m", "vol_normalized_ret_30m", "realized_vol_5m", "realized_vol_15m", "realized_vol_30m", "vwap_dev_z60",
    "vwap_slope_5m", "opening_range_location", "opening_range_width_z60", "trend_efficiency_15m", "trend_efficiency_30m", "pullback_depth_15m",
    "range_expansion_15m", "range_expansion_30m", "true_gap_pct", "gap_fill_fraction", "session_time_sin", "session_time_cos", "days_to_expiry", "expiry_week",
    "vix_t1_z252", "vix_t1_return",
)
ELIGIBILITY = ("is_session_eligible", "is_time_eligible", "has_contiguous_horizon_60m", "is_decision_eligible")
# Special sessions that the matrices leave out.
SPECIAL_SESSIONS = (date(2020, 11, 14), date(2021, 2, 24), date(2021, 11, 4), date(2022, 10, 24), date(2023, 11, 12), date(2025, 9, 26), date(2026, 6, 3))
#: Values of a bar that later sessions compare with the same minute.
COMPARED = ("volume", "vwap_dev", "rr_15", "rr_30")


def _positive(c: Column) -> Column:
    return F.when(c > 0, c)


def _clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _unit(c: Column) -> Column:
    """Clipped to [0, 1]; null stays null, which greatest and least would skip."""
    return F.when(c.isNotNull(), _clip(c))


def regular_bars(bars: DataFrame, special=SPECIAL_SESSIONS) -> DataFrame:
    """Bars of 09:15 to 15:29 outside the special sessions, with trade_date and minute_of_day; volume 1 and oi 0 where the feed has none."""
    missing = {"symbol", "bar_ts", "open", "high", "low", "close"} - set(bars.columns)
    if missing:
        raise ValueError(f"bars lack {sorted(missing)}")
    kind = bars.schema["bar_ts"].dataType
    if not isinstance(kind, T.TimestampNTZType):
        raise ValueError(f"bar_ts must be a local time without a zone, not {kind.simpleString()}")
    minute = F.hour("bar_ts") * 60 + F.minute("bar_ts")
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    more = [F.col(c).cast("double").alias(c) if c in bars.columns else F.lit(v).alias(c) for c, v in (("volume", 1.0), ("oi", 0.0))]
    df = bars.select("symbol", "bar_ts", F.to_date("bar_ts").alias("trade_date"), minute.alias("minute_of_day"), *prices, *more)
    return df.where(F.col("minute_of_day").between(FIRST, FIRST + MINUTES - 1) & ~F.col("trade_date").isin(*special))


def _mean_of(value: str, n: int, least: int) -> Column:
    w = trailing(SESSION, n)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def intraday(df: DataFrame) -> DataFrame:
    """What the session's own bars say: returns, ranges, volatility, VWAP, opening range, streak, trend, path and eligibility."""
    w, day = rows(SESSION), Window.partitionBy(*SESSION)
    before = lambda n, c="close": F.lag(c, n).over(w)
    out = {f"ret_{n}m": F.when(before(n) != 0, F.col("close") / before(n) - 1) for n in (1, 5, 15, 30, 60)}
    out |= {f"log_ret_{n}m": F.when((before(n) > 0) & (F.col("close") > 0), F.log(F.col("close") / before(n))) for n in (1, 5, 15, 30)}
    out["tr"] = F.when(before(1).isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before(1)), F.abs(F.col("low") - before(1))))
    out["step"] = F.abs(F.col("close") - before(1))
    out["vwap"] = F.sum(F.col("close") * F.col("volume")).over(so_far(SESSION)) / F.nullif(F.sum("volume").over(so_far(SESSION)), F.lit(0.0))
    opening = F.col("minute_of_day") < FIRST + OPENING
    for name, top in (("high", F.max), ("low", F.min)):
        out[f"or_{name}"] = F.coalesce(top(F.when(opening, F.col(name))).over(day), F.first(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out["first_open"], out["day_close"] = F.first("open").over(everything), F.last("close").over(everything)
    for n in (15, 30):
        t = trailing(SESSION, n)
        out[f"rr_{n}"] = full(F.max("high").over(t) - F.min("low").over(t), t, n)
    out["high_15"], out["low_15"] = (full(f(c).over(trailing(SESSION, 15)), trailing(SESSION, 15), 15) for f, c in ((F.max, "high"), (F.min, "low")))
    df = df.withColumns(out)

    late = F.col("minute_of_day") >= FIRST + OPENING
    or_range = F.greatest(F.col("or_high") - F.col("or_low"), F.lit(TINY))
    out = {f"natr_{n}m": _mean_of("tr", n, 3) / F.nullif(F.col("close"), F.lit(0.0)) for n in (5, 15, 30)}
    for n in (5, 15, 30):
        t = trailing(SESSION, n)
        out[f"realized_vol_{n}m"] = F.when(F.count("log_ret_1m").over(t) >= 3, F.stddev_samp("log_ret_1m").over(t) * math.sqrt(MINUTES * 252))
    out["vwap_dev"] = (F.col("close") - F.col("vwap")) / F.nullif(F.col("vwap"), F.lit(0.0))
    out["vwap_slope_5m"] = (F.col("vwap") - before(5, "vwap")) / F.nullif(before(5, "vwap"), F.lit(0.0))
    out["or_dist_high"], out["or_dist_low"] = (F.when(late, (F.col("close") - F.col(c)) / or_range) for c in ("or_high", "or_low"))
    out["or_breakout_up"] = F.when(late, (F.col("close") > F.col("or_high")).cast("double"))
    out["or_breakout_dn"] = F.when(late, (F.col("close") < F.col("or_low")).cast("double"))
    out["hour_of_day"], out["day_of_week"] = F.hour("bar_ts"), F.weekday("bar_ts")
    out["session_progress"] = _clip((F.col("minute_of_day") - FIRST) / MINUTES)
    out["width"] = (F.col("or_high") - F.col("or_low")) / F.nullif(F.col("first_open"), F.lit(0.0))
    for n in (15, 30):
        t = trailing(SESSION, n)
        travel = F.when(F.count("step").over(t) >= n, F.sum("step").over(t))
        out[f"trend_efficiency_{n}m"] = _unit(F.abs(F.col("close") - before(n)) / _positive(travel))
    out["pullback_depth_15m"] = _unit((F.col("high_15") - F.col("close")) / _positive(F.col("high_15") - F.col("low_15")))
    out["opening_range_location"] = F.when(late, _unit((F.col("close") - F.col("or_low")) / _positive(F.col("or_high") - F.col("or_low"))))
    ahead = F.lead("bar_ts", HORIZON).over(w)
    out["has_contiguous_horizon_60m"] = F.coalesce(ahead == F.col("bar_ts") + F.make_dt_interval(mins=F.lit(HORIZON)), F.lit(False)).cast("int")
    df = df.withColumns(out)

    m = F.col("minute_of_day")
    df = streak(df, equal_resets=True)
    df = ema(ema(df, "close", 9, "ema_9", SESSION), "close", 21, "ema_21", SESSION)
    angle = 2 * math.pi * F.col("session_progress")
    in_time = m.between(9 * 60 + 45, 14 * 60 + 29) & ~m.between(11 * 60, 11 * 60 + 59)
    return df.withColumns({
        "consec_bars": F.col("streak"), "ema_slope": (F.col("ema_9") - F.col("ema_21")) / F.nullif(F.col("ema_21"), F.lit(0.0)),
        **{f"vol_normalized_ret_{n}m": F.col(f"ret_{n}m") / _positive(F.col("realized_vol_30m") * math.sqrt(n / MINUTES)) for n in (5, 15, 30)},
        "session_time_sin": F.sin(angle), "session_time_cos": F.cos(angle),
        "is_session_eligible": F.lit(1), "is_time_eligible": in_time.cast("int"), "is_decision_eligible": (in_time & (F.col("has_contiguous_horizon_60m") == 1)).cast("int"),
    })


def session_history(df: DataFrame) -> DataFrame:
    """One row a session of ``intraday`` rows: symbol, trade_date, session_idx (from 1), prior_close, opening_range_width_z60."""
    days = df.groupBy(*SESSION).agg(F.first("width").alias("width"), F.first("day_close").alias("day_close"))
    order = Window.partitionBy("symbol").orderBy("trade_date")
    w = order.rowsBetween(-BASELINE, -1)
    sd = F.when(F.count("width").over(w) >= LEAST, F.stddev_pop("width").over(w))
    return days.select(
        *SESSION, F.row_number().over(order).cast("long").alias("session_idx"), F.lag("day_close").over(order).alias("prior_close"),
        ((F.col("width") - F.avg("width").over(w)) / _positive(sd)).alias("opening_range_width_z60"),
    )


def minute_baselines(df: DataFrame) -> DataFrame:
    """Adds volume_base, rr_15_base, rr_30_base (medians) and vwap_dev_mean, vwap_dev_sd of the minute's earlier sessions; ``df`` has session_idx."""
    w = Window.partitionBy("symbol", "minute_of_day").orderBy("session_idx").rangeBetween(-BASELINE, -1)
    enough = lambda c, value: F.when(F.count(c).over(w) >= LEAST, value)
    return df.withColumns({
        **{f"{c}_base": enough(c, F.percentile(c, 0.5).over(w)) for c in ("volume", "rr_15", "rr_30")},
        "vwap_dev_mean": enough("vwap_dev", F.avg("vwap_dev").over(w)), "vwap_dev_sd": enough("vwap_dev", F.stddev_pop("vwap_dev").over(w)),
    })


def calendar_columns(dates: DataFrame, trading_dates: DataFrame, expiries: DataFrame | None = None, calendar: DataFrame | None = None, vix: DataFrame | None = None) -> DataFrame:
    """One row for each of ``dates.trade_date``: days_to_expiry, expiry_week, vix_t1_z252, vix_t1_return.

    ``trading_dates`` has date, ``expiries`` expiry (added to those derived from the
    trading dates), ``calendar`` trade_date and front_expiry (which win), ``vix``
    date and close.  These tables have one row a day and are ordered in one task.
    The index of a session is that of the trading day before it; an older one is
    not used instead.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("date")
    days = trading_dates.select("date").union(dates.select("trade_date")).distinct().withColumn("at", F.row_number().over(one).cast("long"))
    found = derived_expiries(days)
    if expiries is not None:
        found = found.unionByName(expiries.select(F.col("expiry").cast("date").alias("expiry"))).distinct()
    both = days.select("date", F.lit(None).cast("date").alias("expiry")).unionByName(found.select(F.col("expiry").alias("date"), "expiry"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("date").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    front = both.withColumn("front", F.min("expiry").over(ahead)).where("expiry IS NULL").select(F.col("date").alias("f_date"), "front")
    if calendar is not None:
        known = calendar.groupBy(F.col("trade_date").alias("k_date")).agg(F.max("front_expiry").alias("known"))
        front = front.join(known, F.col("f_date") == F.col("k_date"), "left").select("f_date", F.when(F.col("k_date").isNotNull(), F.col("known")).otherwise(F.col("front")).alias("front"))
    ends = days.select(F.col("date").alias("e_date"), F.col("at").alias("e_at"))
    out = days.join(front, F.col("date") == F.col("f_date")).join(ends, F.col("front") == F.col("e_date"), "left")
    out = out.withColumn("days_to_expiry", F.col("e_at") - F.col("at") + 1).withColumn("expiry_week", (F.col("days_to_expiry") <= 4).cast("double"))
    out = out.withColumn("t1_date", F.lag("date").over(one))
    if vix is None:
        out = out.withColumns({"vix_t1_z252": F.lit(None).cast("double"), "vix_t1_return": F.lit(None).cast("double")})
    else:
        v = vix.groupBy(F.col("date").alias("v_date")).agg(F.max("close").cast("double").alias("v"))
        order = Window.partitionBy(F.lit(0)).orderBy("v_date")
        year = order.rowsBetween(-251, 0)
        sd = full(F.stddev_pop("v").over(year), year, 252)
        prior = F.lag("v").over(order)
        v = v.select("v_date", ((F.col("v") - F.avg("v").over(year)) / _positive(sd)).alias("vix_t1_z252"), F.when((F.col("v") > 0) & (prior > 0), F.log(F.col("v") / prior)).alias("vix_t1_return"))
        out = out.join(v, F.col("t1_date") == F.col("v_date"), "left")
    wanted = dates.select(F.col("trade_date").alias("w_date")).distinct()
    return out.join(wanted, F.col("date") == F.col("w_date"), "left_semi").select(F.col("date").alias("c_date"), "days_to_expiry", "expiry_week", "vix_t1_z252", "vix_t1_return")


def derived_expiries(days: DataFrame) -> DataFrame:
    """Monthly expiries of the months of ``days.date``: the last Thursday, from October 2025 the last Tuesday, both in September 2025; moved back to a day of the table in the month."""
    last = F.last_day("date")
    weekday = F.explode(F.when(F.col("month") < F.lit(date(2025, 9, 1)), F.array(F.lit(3))).when(F.col("month") == F.lit(date(2025, 9, 1)), F.array(F.lit(3), F.lit(1))).otherwise(F.array(F.lit(1))))
    d = days.select("date", F.trunc("date", "month").alias("month"), last.alias("last")).select("date", "month", "last", weekday.alias("weekday"))
    target = F.date_sub("last", F.pmod(F.weekday("last") - F.col("weekday"), F.lit(7)))
    return d.where(F.col("date") <= target).groupBy("month", "weekday").agg(F.max("date").alias("expiry")).select("expiry").distinct()


def finish(df: DataFrame) -> DataFrame:
    """Values that need the session's history and the minute's baselines, in the columns of both matrices."""
    gap = F.col("first_open") - F.col("prior_close")
    return df.withColumns({
        "true_gap_pct": gap / F.nullif(F.col("prior_close"), F.lit(0.0)),
        "gap_fill_fraction": _unit((F.col("first_open") - F.col("close")) / F.nullif(gap, F.lit(0.0))),
        "volume_surprise_60d": F.when((F.col("volume_base") > 0) & (F.col("volume") > 0), F.log(F.col("volume") / F.col("volume_base"))),
        "vwap_dev_z60": (F.col("vwap_dev") - F.col("vwap_dev_mean")) / _positive(F.col("vwap_dev_sd")),
        **{f"range_expansion_{n}m": F.col(f"rr_{n}") / _positive(F.col(f"rr_{n}_base")) for n in (15, 30)},
    }).withColumnRenamed("trade_date", "session_date").select(*KEYS, *dict.fromkeys((*WIDE, *PATH)), *ELIGIBILITY)


def feature_matrix(
    bars: DataFrame, trading_dates: DataFrame | None = None, expiries: DataFrame | None = None, calendar: DataFrame | None = None, vix: DataFrame | None = None, special=SPECIAL_SESSIONS,
) -> DataFrame:
    """All columns of both matrices; ``wide`` and ``path`` select from them."""
    df = intraday(regular_bars(bars, special))
    history = session_history(df).withColumnsRenamed({"symbol": "h_symbol", "trade_date": "h_date"})
    dates = df.select("trade_date").distinct()
    observed = (bars.select(F.to_date("bar_ts").alias("date")).distinct() if trading_dates is None else trading_dates)
    named = calendar_columns(dates, observed, expiries, calendar, vix)
    df = df.join(history, (F.col("symbol") == F.col("h_symbol")) & (F.col("trade_date") == F.col("h_date"))).join(named, F.col("trade_date") == F.col("c_date"), "left")
    return finish(minute_baselines(df))


def wide(matrix: DataFrame) -> DataFrame:
    return matrix.select(*KEYS, *WIDE, *ELIGIBILITY)


def path(matrix: DataFrame) -> DataFrame:
    return matrix.select(*KEYS, *PATH, *ELIGIBILITY)
