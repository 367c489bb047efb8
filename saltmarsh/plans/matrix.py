"""The registered feature matrices over minute bars, in batch and session by session."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import matrix as X
from saltmarsh.plans.views import reg
from saltmarsh.streaming import jobs as S
from saltmarsh.streaming import sessions

_S, _B = "PARTITION BY symbol, d ORDER BY bar_ts", "PARTITION BY symbol, m ORDER BY i RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING"
_L = lambda n: f"{_S} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
_DAY = "PARTITION BY symbol, d"
_ALL = f"{_S} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_UNIT = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(0, least(1, {x})) END"
_POS = lambda x: f"CASE WHEN {x} > 0 THEN {x} END"
_BASE = lambda f, c: f"CASE WHEN count({c}) OVER b >= 20 THEN {f} OVER b END"
_SESSION_SQL = f"""
r AS (SELECT *, CAST(bar_ts AS DATE) AS d, hour(bar_ts) * 60 + minute(bar_ts) AS m FROM minutes WHERE hour(bar_ts) * 60 + minute(bar_ts) BETWEEN 555 AND 929),
n AS (SELECT symbol, d, bar_ts, close, row_number() OVER ({_S}) AS seq FROM r),
e AS (SELECT symbol, d, seq, close AS f, close AS s FROM n WHERE seq = 1 UNION ALL
  SELECT n.symbol, n.d, n.seq, e.f + 0.2 * (n.close - e.f), e.s + (2.0::DOUBLE / 22) * (n.close - e.s) FROM e JOIN n ON n.symbol = e.symbol AND n.d = e.d AND n.seq = e.seq + 1),
a AS (SELECT r.*, {", ".join(f"CASE WHEN lag(close, {k}) OVER w <> 0 THEN close / lag(close, {k}) OVER w - 1 END AS ret_{k}m" for k in (1, 5, 15, 30, 60))},
  {", ".join(f"CASE WHEN lag(close, {k}) OVER w > 0 AND close > 0 THEN ln(close / lag(close, {k}) OVER w) END AS log_ret_{k}m" for k in (1, 5, 15, 30))},
  CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, abs(close - lag(close) OVER w) AS step,
  sum(close * volume) OVER w / nullif(sum(volume) OVER w, 0) AS vwap,
  coalesce(max(CASE WHEN m < 570 THEN high END) OVER ({_DAY}), first_value(high) OVER ({_ALL})) AS or_high, coalesce(min(CASE WHEN m < 570 THEN low END) OVER ({_DAY}), first_value(low) OVER ({_ALL})) AS or_low,
  first_value(open) OVER ({_ALL}) AS first_open, last_value(close) OVER ({_ALL}) AS day_close, row_number() OVER w AS seq,
  {", ".join(f"CASE WHEN count(*) OVER ({_L(k)}) >= {k} THEN max(high) OVER ({_L(k)}) - min(low) OVER ({_L(k)}) END AS rr_{k}" for k in (15, 30))},
  CASE WHEN count(*) OVER ({_L(15)}) >= 15 THEN max(high) OVER ({_L(15)}) END AS high_15, CASE WHEN count(*) OVER ({_L(15)}) >= 15 THEN min(low) OVER ({_L(15)}) END AS low_15,
  sign(close - lag(close) OVER w) AS dir FROM r WINDOW w AS ({_S})),
s AS (SELECT a.*, (close - vwap) / nullif(vwap, 0) AS vwap_dev, (or_high - or_low) / nullif(first_open, 0) AS width,
  (vwap - lag(vwap, 5) OVER w) / nullif(lag(vwap, 5) OVER w, 0) AS vwap_slope_5m,
  {", ".join(f"CASE WHEN count(tr) OVER ({_L(k)}) >= 3 THEN avg(tr) OVER ({_L(k)}) END / nullif(close, 0) AS natr_{k}m" for k in (5, 15, 30))},
  {", ".join(f"CASE WHEN count(log_ret_1m) OVER ({_L(k)}) >= 3 THEN stddev_samp(log_ret_1m) OVER ({_L(k)}) * sqrt(375 * 252) END AS realized_vol_{k}m" for k in (5, 15, 30))},
  {", ".join(f"CASE WHEN count(step) OVER ({_L(k)}) >= {k} AND sum(step) OVER ({_L(k)}) > 0 THEN abs(close - lag(close, {k}) OVER w) / sum(step) OVER ({_L(k)}) END AS eff_{k}" for k in (15, 30))},
  CASE WHEN dir IS DISTINCT FROM lag(dir) OVER w THEN 1 ELSE 0 END AS turns, coalesce(lead(bar_ts, 60) OVER w = bar_ts + INTERVAL 60 MINUTE, false) AS ahead FROM a WINDOW w AS ({_S})),
g AS (SELECT s.*, sum(turns) OVER ({_S}) AS run FROM s),
t AS (SELECT g.*, coalesce(row_number() OVER (PARTITION BY symbol, d, run ORDER BY bar_ts) * dir, 0) AS consec, (f - s_) / nullif(s_, 0) AS ema_slope FROM g JOIN (SELECT symbol AS y, d AS z, seq AS q, f, s AS s_ FROM e) ON y = symbol AND z = d AND q = seq),
days AS (SELECT symbol, d, first(width) AS width, first(day_close) AS day_close FROM s GROUP BY 1, 2),
h AS (SELECT symbol AS hs, d AS hd, row_number() OVER w AS i, lag(day_close) OVER w AS prior_close,
  CASE WHEN count(width) OVER v >= 20 AND stddev_pop(width) OVER v > 0 THEN (width - avg(width) OVER v) / stddev_pop(width) OVER v END AS width_z FROM days WINDOW w AS (PARTITION BY symbol ORDER BY d), v AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
cal AS (SELECT d, row_number() OVER (ORDER BY d) AS k, lag(d) OVER (ORDER BY d) AS t1 FROM (SELECT DISTINCT CAST(bar_ts AS DATE) AS d FROM minutes)),
ex AS (SELECT max(d) AS expiry FROM cal WHERE d <= last_day(d) - CAST(((dayofweek(last_day(d)) + 6) % 7 - 3 + 7) % 7 AS INTEGER) GROUP BY date_trunc('month', d)),
c AS (SELECT x.d AS cd, y.k - x.k + 1 AS dte, x.t1 FROM cal x LEFT JOIN cal y ON y.d = (SELECT min(expiry) FROM ex WHERE expiry >= x.d)),
v AS (SELECT date AS vd, CASE WHEN count(*) OVER y >= 252 AND stddev_pop(close) OVER y > 0 THEN (close - avg(close) OVER y) / stddev_pop(close) OVER y END AS vz, CASE WHEN close > 0 AND lag(close) OVER o > 0 THEN ln(close / lag(close) OVER o) END AS vr
  FROM index_values WINDOW o AS (ORDER BY date), y AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
k AS (SELECT t.*, h.i, prior_close, width_z, dte, vz, vr, first_open - prior_close AS gap FROM t JOIN h ON hs = symbol AND hd = d LEFT JOIN c ON cd = d LEFT JOIN v ON vd = t1),
j AS (SELECT *, {_BASE("quantile_cont(volume, 0.5)", "volume")} AS volume_base, {_BASE("quantile_cont(rr_15, 0.5)", "rr_15")} AS rr_15_base, {_BASE("quantile_cont(rr_30, 0.5)", "rr_30")} AS rr_30_base,
  {_BASE("avg(vwap_dev)", "vwap_dev")} AS dev_mean, {_BASE("stddev_pop(vwap_dev)", "vwap_dev")} AS dev_sd FROM k WINDOW b AS ({_B}))
"""
_LATE = lambda x: f"CASE WHEN m >= 570 THEN {x} END"
_OR = "greatest(or_high - or_low, 1e-8)"
_VALUES = {
    **{c: c for c in (*[f"ret_{k}m" for k in (1, 5, 15, 30, 60)], *[f"log_ret_{k}m" for k in (1, 5, 15, 30)], *[f"{x}_{k}m" for x in ("natr", "realized_vol") for k in (5, 15, 30)], "vwap_dev", "vwap_slope_5m", "ema_slope")},
    "or_dist_high": _LATE(f"(close - or_high) / {_OR}"), "or_dist_low": _LATE(f"(close - or_low) / {_OR}"),
    "or_breakout_up": _LATE("CASE WHEN close > or_high THEN 1.0 ELSE 0.0 END"), "or_breakout_dn": _LATE("CASE WHEN close < or_low THEN 1.0 ELSE 0.0 END"),
    "minute_of_day": "m", "hour_of_day": "hour(bar_ts)", "session_progress": "greatest(0, least(1, (m - 555) / 375))", "day_of_week": "(dayofweek(d) + 6) % 7",
    "true_gap_pct": "gap / nullif(prior_close, 0)", "consec_bars": "consec", "volume_surprise_60d": "CASE WHEN volume_base > 0 AND volume > 0 THEN ln(volume / volume_base) END",
    "days_to_expiry": "dte", "expiry_week": "CASE WHEN dte <= 4 THEN 1.0 WHEN dte > 4 THEN 0.0 END", "vix_t1_z252": "vz", "vix_t1_return": "vr",
    **{f"vol_normalized_ret_{k}m": f"ret_{k}m / {_POS(f'(realized_vol_30m * sqrt({k} / 375))')}" for k in (5, 15, 30)},
    "vwap_dev_z60": "CASE WHEN dev_sd > 0 THEN (vwap_dev - dev_mean) / dev_sd END", "opening_range_location": _LATE(_UNIT(f"((close - or_low) / {_POS('(or_high - or_low)')})")),
    "opening_range_width_z60": "width_z", **{f"trend_efficiency_{k}m": _UNIT(f"eff_{k}") for k in (15, 30)}, "pullback_depth_15m": _UNIT(f"((high_15 - close) / {_POS('(high_15 - low_15)')})"),
    **{f"range_expansion_{k}m": f"CASE WHEN rr_{k}_base > 0 THEN rr_{k} / rr_{k}_base END" for k in (15, 30)}, "gap_fill_fraction": _UNIT("((first_open - close) / nullif(gap, 0))"),
    "session_time_sin": "sin(2 * pi() * (m - 555) / 375)", "session_time_cos": "cos(2 * pi() * (m - 555) / 375)",
}
_TIME = "m BETWEEN 585 AND 869 AND NOT m BETWEEN 660 AND 719"
_FLAGS = {"is_session_eligible": "1", "is_time_eligible": f"CAST({_TIME} AS INTEGER)", "has_contiguous_horizon_60m": "CAST(ahead AS INTEGER)", "is_decision_eligible": f"CAST({_TIME} AND ahead AS INTEGER)"}


def _body(columns) -> str:
    named = ", ".join(f"{x} AS {c}" for c, x in (_VALUES | _FLAGS).items() if c in columns or c in _FLAGS)
    return f"WITH RECURSIVE {_SESSION_SQL.strip()} SELECT symbol, d AS session_date, bar_ts, {named} FROM j"


def matrix(v):
    return X.feature_matrix(v.minutes, vix=v.index_values)


_KEYS = f"{' '.join(X.KEYS)} {' '.join(X.ELIGIBILITY)}"
reg("e41_wide_matrix", lambda v: X.wide(matrix(v)), _body(X.WIDE), _KEYS, " ".join(X.WIDE))
reg("e41_path_matrix", lambda v: X.path(matrix(v)), _body(X.PATH), _KEYS, " ".join(X.PATH))


def by_session(v):
    """The matrix from bars that land in three parts, each picked up by a restart of the stream."""
    folder = S.scratch(v.spark)
    day, dates = F.to_date("bar_ts"), X.regular_bars(v.minutes).select("trade_date").distinct()
    named = X.calendar_columns(dates, v.minutes.select(day.alias("date")).distinct(), vix=v.index_values)
    kept, part = v.minutes.schema, F.when(F.dayofmonth("bar_ts") <= 12, 1).when(F.dayofmonth("bar_ts") <= 24, 2).otherwise(3)
    for n in (1, 2, 3):
        v.minutes.where(part == n).write.mode("append").parquet(f"{folder}/bars")
        out = sessions.run_sessions(v.spark, v.spark.readStream.schema(kept).parquet(f"{folder}/bars"), folder, named)
    return out


_ALL_COLUMNS = tuple(dict.fromkeys((*X.WIDE, *X.PATH)))
reg("s05_matrix_by_session", by_session, _body(_ALL_COLUMNS), _KEYS, " ".join(_ALL_COLUMNS))
