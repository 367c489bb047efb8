"""Queries of order statistics, checks, folds, and functions of the caller."""

from __future__ import annotations

from datetime import date

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from saltmarsh.functions import costs as C
from saltmarsh.operators import asof as J
from saltmarsh.operators import bars as B
from saltmarsh.operators import callers, checks, crossfit, meta, ranks
from saltmarsh.operators import features as E
from saltmarsh.operators import metrics as M
from saltmarsh.plans.views import reg
from saltmarsh.sources import tables as T
from saltmarsh.streaming import jobs as S

reg(
    "d01_five_minute_bars", lambda v: B.resample(v.ticks.withColumn("symbol", F.concat_ws("-", "symbol", F.col("oi_step") % 5)), 5),
    "SELECT symbol || '-' || (oi_step % 5) AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS bar_ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks FROM ticks GROUP BY 1, 2",
    "symbol bar_ts volume n_ticks", "open high low close",
)
_NEAR = "list_sort(list({x}))[CAST(floor({p} * (count(*) - 1) + 0.5) AS BIGINT) + 1]"


def _breadth(v):
    per_bar = v.minutes.groupBy("bar_ts").agg(F.count_distinct("symbol").alias("x")).select(F.lit("symbols_per_bar").alias("what"), "x")
    per_day = v.minutes.groupBy(F.to_date("bar_ts")).agg(F.count("*").alias("x")).select(F.lit("rows_per_day").alias("what"), "x")
    volume = v.minutes.select(F.lit("volume").alias("what"), F.col("volume").alias("x"))
    return ranks.nearest_rank(per_bar.unionByName(per_day).unionByName(volume), ["what"], "x", {"p50": 0.5, "p95": 0.95})


reg(
    "d31_nearest_ranks", _breadth,
    f"SELECT what, CAST({_NEAR.format(x='x', p=0.5)} AS DOUBLE) AS p50, CAST({_NEAR.format(x='x', p=0.95)} AS DOUBLE) AS p95 FROM (SELECT 'symbols_per_bar' AS what, count(DISTINCT symbol) AS x FROM minutes GROUP BY bar_ts UNION ALL SELECT 'rows_per_day', count(*) FROM minutes GROUP BY CAST(bar_ts AS DATE) UNION ALL SELECT 'volume', volume FROM minutes) GROUP BY what",
    "what", "p50 p95",
)


def _longest_win(key: dict, frame: pd.DataFrame) -> dict:
    """Longest run of wins, and the loss after which the running sum was lowest; fold 1995 refuses every seventh supplier."""
    if key["fold"] == 1995 and key["config"] % 7 == 0:
        raise ArithmeticError("no such fold")
    best = run = 0
    for g in frame["gross_bps"]:
        run = run + 1 if g > 0 else 0
        best = max(best, run)
    return {"longest": best, "lowest": float(frame["gross_bps"].cumsum().min())}


_T = "PARTITION BY config, fold ORDER BY date, order_key, line"
reg(
    "m13_caller_function", lambda v: callers.evaluate(v.trades, ["config", "fold"], ["gross_bps"], _longest_win, "longest long, lowest double", ["date", "order_key", "line"]),
    f"""SELECT config, fold, CASE WHEN bad THEN NULL ELSE longest END AS longest, CASE WHEN bad THEN NULL ELSE lowest END AS lowest, n_rows, CASE WHEN bad THEN 'ArithmeticError: no such fold' END AS error FROM (
      SELECT config, fold, fold = 1995 AND config % 7 = 0 AS bad, coalesce(max(len) FILTER (win), 0) AS longest, min(low) AS lowest, sum(len) AS n_rows FROM (
        SELECT config, fold, win, island, count(*) AS len, min(total) AS low FROM (SELECT *, row_number() OVER ({_T}) - row_number() OVER (PARTITION BY config, fold, win ORDER BY date, order_key, line) AS island FROM (
          SELECT *, gross_bps > 0 AS win, sum(gross_bps) OVER ({_T} ROWS UNBOUNDED PRECEDING) AS total FROM trades)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2)""",
    "config fold longest n_rows error", "lowest",
)
reg(
    "m05_out_of_fold", lambda v: crossfit.out_of_fold(v.scores, "ts", ["p"], "y", 86_400, 3),
    """WITH o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS r, count(*) OVER () AS n FROM scores), b AS (SELECT k, ts AS t FROM o, (SELECT unnest([1, 2, 3]) AS k) WHERE r = CAST(floor(1 + (n - 2) * k / 3.0) AS BIGINT)),
      f AS (SELECT row_number() OVER (ORDER BY k) AS fold, t AS lo, lead(t) OVER (ORDER BY k) AS hi FROM b),
      g AS (SELECT fold, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS s0, sum(p) AS s1, sum(p * p) + 1 AS s2, sum(y) AS t0, sum(p * y) AS t1 FROM f JOIN scores s ON s.ts < lo - INTERVAL 1 DAY WHERE hi IS NOT NULL GROUP BY fold),
      w AS (SELECT fold, lo, hi, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1, s0, s1, t0 FROM g)
    SELECT event_id, fold, (t0 - b1 * s1) / s0 + b1 * p AS oof_score FROM scores JOIN w ON ts >= lo AND ts < hi""",
    "event_id fold", "oof_score",
)
_FOLD = "SELECT {k} AS kind, {f} AS fold, side, count(*) AS n, count(*) FILTER (gross_bps > 0) AS wins, count(*) FILTER (gross_bps < 0) AS losses, avg(gross_bps) AS ev, sum(gross_bps) AS total, count(DISTINCT date) AS days FROM t GROUP BY side, {f}"
_TABLES = "WITH t AS (SELECT t.*, CAST(r // 5 AS BIGINT) AS b FROM trades t JOIN (SELECT side AS s, date AS d, row_number() OVER (PARTITION BY side ORDER BY date) - 1 AS r FROM (SELECT DISTINCT side, date FROM trades)) ON s = side AND d = date), a AS (" + " UNION ALL ".join(_FOLD.format(k=f"'{k}'", f=f"CAST({f} AS VARCHAR)") for k, f in (("bucket", "b"), ("day", "date"), ("year", "year(date)"))) + ")"
reg("d12_fold_tables", lambda v: M.fold_tables(v.trades, ["side"], "gross_bps"), f"{_TABLES} SELECT * FROM a", "side kind fold n wins losses days", "ev total")


# Orders ship on one to seven days, so that each kind of fold is chosen for some.
reg(
    "d12_selection_folds", lambda v: M.selection_folds(v.trades, ["order_key"], "gross_bps"),
    f"""WITH t AS (SELECT q.*, CAST(r // 5 AS BIGINT) AS b FROM trades q JOIN (SELECT order_key AS s, date AS d, row_number() OVER (PARTITION BY order_key ORDER BY date) - 1 AS r FROM (SELECT DISTINCT order_key, date FROM trades)) ON s = order_key AND d = date),
      a AS ({" UNION ALL ".join(_FOLD.replace("side", "order_key").format(k=f"'{k}'", f=f"CAST({f} AS VARCHAR)") for k, f in (("bucket", "b"), ("day", "date"), ("year", "year(date)")))}),
      c AS (SELECT order_key AS cc, CASE WHEN count(*) FILTER (kind = 'bucket') >= 2 THEN 'bucket' WHEN count(*) FILTER (kind = 'day') >= 2 THEN 'day' ELSE 'year' END AS chosen FROM a GROUP BY 1) SELECT a.* FROM a JOIN c ON cc = order_key AND kind = chosen""",
    "order_key kind fold n wins losses days", "ev total",
)


def _scored(v):
    w = Window.partitionBy("symbol", F.to_date("bar_ts")).orderBy("bar_ts")
    r = lambda n: F.col("close") / F.nullif(F.lag("close", n).over(w), F.lit(0.0)) - 1
    side = F.when(F.col("volume") % 3 == 0, "LONG").when(F.col("volume") % 3 == 1, "SHORT").otherwise("NO_TRADE")
    return v.minutes.select("symbol", "bar_ts", side.alias("side"), F.when(F.col("volume") % 2 == 0, "even").alias("sector"), r(1).alias("return_1"), r(3).alias("return_3"), (F.col("oi") - 20).alias("net_bps"))


_NINE = {
    "side": "side", "symbol": "symbol", "sector": "coalesce(sector, 'unknown')", "month": "strftime(bar_ts, '%Y-%m')", "rolling_20_sessions": "block", "trend_regime": "CASE WHEN coalesce(r3, r1, 0) > 0 THEN 'up' ELSE 'down_or_flat' END",
    "volatility_regime": "CASE WHEN abs(coalesce(r1, 0)) >= 0.01 THEN 'high' ELSE 'low' END", "gap_regime": "CASE WHEN abs(coalesce(r1, 0)) >= 0.005 THEN 'gap' ELSE 'no_gap' END",
    "session_phase": "CASE WHEN strftime(bar_ts, '%H:%M') < '10:00' THEN 'open' WHEN strftime(bar_ts, '%H:%M') < '14:30' THEN 'mid' ELSE 'close' END",
}
reg(
    "d16_nine_ways", lambda v: checks.nine_ways(_scored(v)),
    """WITH s AS (SELECT symbol, bar_ts, CASE volume % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'SHORT' ELSE 'NO_TRADE' END AS side, CASE WHEN volume % 2 = 0 THEN 'even' END AS sector, close / nullif(lag(close, 1) OVER w, 0) - 1 AS r1, close / nullif(lag(close, 3) OVER w, 0) - 1 AS r3, oi - 20 AS net_bps,
      CAST(bar_ts AS DATE) AS d FROM minutes WINDOW w AS (PARTITION BY symbol, CAST(bar_ts AS DATE) ORDER BY bar_ts)), k AS (SELECT d AS kd, i // 20 * 20 + 1 || '-' || least(i // 20 * 20 + 20, n) AS block FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT d FROM s))),
      x AS (SELECT * FROM s JOIN k ON kd = d) """ + " UNION ALL ".join(f"SELECT '{d}' AS dim, {e} AS level, count(*) AS n, count(*) FILTER (side <> 'NO_TRADE') AS trades, avg(net_bps) FILTER (side <> 'NO_TRADE') AS net, avg(CAST(net_bps > 0 AS DOUBLE)) FILTER (side <> 'NO_TRADE') AS hit_rate FROM x GROUP BY {e}" for d, e in _NINE.items()),
    "dim level n trades", "net hit_rate",
)


def _late_bars(v):
    """Minute bars moved on by three quarters of an hour, so that sessions reach their end."""
    return v.minutes.withColumn("bar_ts", F.col("bar_ts") + F.make_dt_interval(mins=F.lit(45)))


def _calendar(v):
    """What the exchange would say of each day: the day's own sums, off by more or less according to the day."""
    d = F.dayofmonth("trade_date")
    own = _late_bars(v).groupBy("symbol", F.to_date("bar_ts").alias("trade_date")).agg(F.sum("volume").alias("s"), F.avg(F.when(F.hour("bar_ts") >= 15, F.col("close"))).alias("c"), F.max("oi").alias("o"))
    return own.select(
        "symbol", F.when(d % 10 == 0, F.date_add("trade_date", 60)).otherwise(F.col("trade_date")).alias("trade_date"), F.when(d % 4 != 0, F.col("c")).alias("front_close"),
        (F.col("s") / 25 * (1 + (d % 3) * 0.03)).alias("front_volume"), F.lit(25).alias("lot"), F.when(d % 5 != 0, F.col("o") * F.when(d % 2 == 0, 1.0).otherwise(0.5)).alias("front_oi"),
    )


_D25 = """WITH m AS (SELECT symbol, bar_ts + INTERVAL 45 MINUTE AS ts, close, volume, oi FROM minutes), n AS (SELECT *, CAST(ts AS DATE) AS d, strftime(ts, '%H:%M:%S') AS t FROM m),
  a AS (SELECT symbol, d, count(*) AS bar_count, max(t) AS last_time, last(close ORDER BY ts) AS last_close, sum(close * volume) FILTER (t >= '15:00:00' AND volume > 0) / nullif(sum(volume) FILTER (t >= '15:00:00' AND volume > 0), 0) AS close_vwap,
    sum(volume) AS volume, coalesce(last(oi ORDER BY ts) FILTER (oi <> 0), last(oi ORDER BY ts)) AS close_oi, max(t) FILTER (oi <> 0) AS oi_time, avg(close) FILTER (t >= '15:00:00') AS c, max(oi) AS o FROM n GROUP BY 1, 2),
  k AS (SELECT symbol AS ks, CASE WHEN day(d) % 10 = 0 THEN d + 60 ELSE d END AS kd, CASE WHEN day(d) % 4 <> 0 THEN c END AS e_close, volume / 25 * (1 + (day(d) % 3) * 0.03) * 25 AS e_volume, CASE WHEN day(d) % 5 <> 0 THEN o * CASE WHEN day(d) % 2 = 0 THEN 1.0 ELSE 0.5 END END AS e_oi FROM a),
  j AS (SELECT ks AS symbol, kd AS trade_date, bar_count, last_close, close_vwap, volume, close_oi, last_time < '15:25:00' AS short, oi_time < last_time AS early, oi_time,
    e_close IS NOT NULL AND NOT coalesce(CASE WHEN e_close = 0 THEN close_vwap = 0 ELSE abs(close_vwap - e_close) / abs(e_close) <= 0.001 END, false) AS x_close, e_volume IS NOT NULL AND NOT coalesce(CASE WHEN e_volume = 0 THEN volume = 0 ELSE abs(volume - e_volume) / abs(e_volume) <= 0.05 END, false) AS x_volume,
    e_oi IS NOT NULL AND NOT coalesce(CASE WHEN e_oi = 0 THEN close_oi = 0 ELSE abs(close_oi - e_oi) / abs(e_oi) <= 0.05 END, false) AS y_oi, coalesce(e_oi / nullif(close_oi, 0) BETWEEN 0.8 AND 1.25, false) AS near FROM k LEFT JOIN a ON a.symbol = ks AND a.d = kd)
  SELECT symbol, trade_date, bar_count, last_close, close_vwap, volume, close_oi, CASE WHEN bar_count IS NULL THEN 'missing_file' ELSE f END AS failures, CASE WHEN bar_count IS NULL THEN '' ELSE concat_ws(',', CASE WHEN short THEN 'truncated_day' END, CASE WHEN early THEN 'oi_from_' || replace(oi_time, ':', '')[:4] || '_bar' END, CASE WHEN y_oi AND near AND NOT short THEN 'oi_timing_drift' END) END AS notes, bar_count IS NOT NULL AND f = '' AS ok
  FROM (SELECT *, concat_ws(',', CASE WHEN NOT bar_count BETWEEN 345 AND 380 THEN 'bar_count' END, CASE WHEN short THEN 'session_truncated' END, CASE WHEN x_close AND NOT short THEN 'close' END, CASE WHEN x_volume AND NOT short THEN 'volume' END, CASE WHEN y_oi AND NOT near AND NOT short THEN 'oi' END) AS f FROM j)"""
reg("d25_day_files", lambda v: checks.day_validation(_late_bars(v), _calendar(v), ["symbol"], oi_bounds=(0.8, 1.25)), _D25, "symbol trade_date bar_count failures notes ok", "last_close close_vwap volume close_oi")


def _splits(v):
    """Suppliers over four splits, some in two; windows by ship year, one of them too near."""
    s = v.table("supplier").select(F.col("s_suppkey").alias("config"))
    place = F.when(F.col("config") % 13 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array((F.col("config") % 4).cast("int")))
    s = s.where(F.col("config") % 11 != 0).select("config", F.explode(place).alias("position"))
    named = F.element_at(F.array(*[F.lit(n) for n in ("train", "val", "test", "blind")]), F.col("position") + 1)
    first = F.element_at(F.array(*[F.lit(d).cast("date") for d in ("1995-01-01", "1997-01-03", "1999-02-01", "2000-02-01")]), F.col("position") + 1)
    last = F.element_at(F.array(*[F.lit(d).cast("date") for d in ("1996-12-31", "1998-12-31", "1999-12-31", None)]), F.col("position") + 1)
    return s.select("config", named.alias("split"), "position", first.alias("from_day"), last.alias("to_day"))


def _samples(v):
    return v.trades.select("config", F.when(F.col("order_key") % 50 == 0, "test").alias("split"), "date")


reg(
    "h03_split_violations", lambda v: checks.split_violations(_samples(v), _splits(v), "config", "split", "date", 5),
    """WITH s AS (SELECT config, unnest(CASE WHEN config % 13 = 0 THEN [0, 2] ELSE [config % 4] END) AS pos FROM (SELECT s_suppkey AS config FROM supplier WHERE s_suppkey % 11 <> 0)),
      w AS (SELECT config, pos, ['train', 'val', 'test', 'blind'][pos + 1] AS split, CAST(['1995-01-01', '1997-01-03', '1999-02-01', '2000-02-01'][pos + 1] AS DATE) AS a, CAST(['1996-12-31', '1998-12-31', '1999-12-31', NULL][pos + 1] AS DATE) AS b FROM s),
      f AS (SELECT config AS c, first(split ORDER BY pos) AS split, first(a ORDER BY pos) AS a, first(b ORDER BY pos) AS b FROM w GROUP BY 1),
      m AS (SELECT CASE WHEN c IS NULL THEN 'unassigned' WHEN declared <> split THEN 'declared' WHEN date < a THEN 'before' WHEN date > b THEN 'after' END AS kind, config, CASE WHEN c IS NULL THEN '' WHEN declared <> split THEN declared || ' ' || split ELSE split END AS detail FROM (SELECT config, date, CASE WHEN order_key % 50 = 0 THEN 'test' END AS declared FROM trades) LEFT JOIN f ON c = config),
      e AS (SELECT split, pos, min(a) AS a, max(b) AS b FROM w GROUP BY 1, 2)
    SELECT 'overlap' AS kind, CAST(config AS VARCHAR) AS name, string_agg(split, ',' ORDER BY split) AS detail, 1 AS n FROM (SELECT DISTINCT config, split FROM w) GROUP BY config HAVING count(*) > 1
    UNION ALL SELECT 'embargo', split, a || ' ' || p, 1 FROM (SELECT *, lag(b) OVER (ORDER BY pos) AS p FROM e) WHERE a < p + 6
    UNION ALL SELECT kind, CAST(config AS VARCHAR), detail, count(*) FROM m WHERE kind IS NOT NULL GROUP BY 1, 2, 3""",
    "kind name detail n",
)


_FEED = """f AS (SELECT CASE WHEN n % 31 = 0 THEN 'NIFTY 50' ELSE symbol END AS symbol, bar_ts, n % 13 = 0 AS no_name, n % 17 = 0 AS no_token, n % 19 = 0 AS no_expiry, n % 7 = 0 AS continuous, CASE WHEN n % 23 <> 0 THEN floor(oi / 25) * 100 END AS oi, CASE WHEN n % 29 = 0 THEN -1.0 WHEN n % 11 <> 0 THEN volume - 2 END AS volume, symbol AS own, close
  FROM (SELECT *, CAST(volume AS BIGINT) AS n FROM minutes)),
g AS (SELECT *, CASE WHEN oi > 0 AND NOT coalesce(oi = last_value(CASE WHEN oi > 0 THEN oi END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_ts, own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 1 ELSE 0 END AS fresh FROM f),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY bar_ts, own ROWS UNBOUNDED PRECEDING) AS run FROM g),
k AS (SELECT *, oi > 0 AND sum(CASE WHEN oi > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, run ORDER BY bar_ts, own ROWS UNBOUNDED PRECEDING) - 1 >= 5 AS stale FROM h),
c AS (SELECT symbol, own, bar_ts, oi, volume, concat_ws(',', CASE WHEN symbol = 'NIFTY 50' THEN 'index_proxy_or_missing_futures_symbol' END, CASE WHEN NOT continuous AND no_expiry THEN 'missing_expiry' END, CASE WHEN NOT continuous AND no_name THEN 'missing_tradingsymbol' END, CASE WHEN NOT continuous AND no_token THEN 'missing_instrument_token' END,
  CASE WHEN oi IS NULL OR oi < 0 THEN 'missing_or_negative_oi' END, CASE WHEN volume IS NULL OR volume < 0 THEN 'missing_or_negative_volume' END) AS failures, concat_ws(',', CASE WHEN oi = 0 THEN 'zero_oi' END, CASE WHEN stale THEN 'stale_oi' END, CASE WHEN volume = 0 THEN 'zero_volume' END) AS warnings FROM k)"""


def _feed(v):
    """Minute bars as a futures feed with what such feeds lack now and then."""
    n = F.col("volume").cast("long")
    return v.minutes.select(
        F.col("symbol").alias("own"), F.when(n % 31 == 0, "NIFTY 50").otherwise(F.col("symbol")).alias("symbol"), "bar_ts", F.when(n % 13 != 0, F.col("symbol")).alias("tradingsymbol"), F.when(n % 17 != 0, n).alias("instrument_token"),
        F.when(n % 19 != 0, F.lit("2024-02-01")).alias("expiry"), (n % 7 == 0).alias("continuous"), F.when(n % 23 != 0, F.floor(F.col("oi") / 25) * 100).cast("double").alias("oi"), F.when(n % 29 == 0, -1.0).when(n % 11 != 0, F.col("volume") - 2).alias("volume"),
    )


def _checked(v):
    return checks.futures_feed(_feed(v), F.col("symbol") != "NIFTY 50", order=("bar_ts", "own"))


reg(
    "b10_feed_rows", lambda v: _checked(v).where((F.size("failures") > 0) | (F.size("warnings") > 0)).select("symbol", "own", "bar_ts", F.array_join("failures", ",").alias("failures"), F.array_join("warnings", ",").alias("warnings")),
    f"WITH {_FEED} SELECT symbol, own, bar_ts, failures, warnings FROM c WHERE failures <> '' OR warnings <> ''", "symbol own bar_ts failures warnings",
)
reg(
    "b10_feed_summary", lambda v: checks.feed_summary(_checked(v), ["symbol"]),
    f"WITH {_FEED} SELECT symbol, count(*) AS rows, avg(CASE WHEN oi = 0 THEN 1.0 ELSE 0.0 END) AS zero_oi_share, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) AS zero_volume_share, count(*) FILTER (failures <> '') AS failed, count(*) FILTER (warnings <> '') AS warned, count(*) FILTER (failures <> '') = 0 AS validated FROM c GROUP BY symbol",
    "symbol rows failed warned validated", "zero_oi_share zero_volume_share",
)


def _expected_oi(v):
    """What the exchange would publish: the day's last open interest, from the tenth day on in units a hundred times finer."""
    d = F.dayofmonth("trade_date")
    own = v.minutes.where("oi <> 0").groupBy("symbol", F.to_date("bar_ts").alias("trade_date")).agg(F.max_by("oi", "bar_ts").alias("o"))
    return own.select("symbol", "trade_date", F.when(d % 7 == 0, F.lit(None).cast("double")).when(d % 5 == 0, F.col("o") * 4).when(d >= 10, F.col("o") * 90).otherwise(F.col("o") * 1.5).alias("front_oi")).where(d % 11 != 0)


def _regimes(v):
    return checks.oi_regimes(v.minutes, _expected_oi(v), ["symbol"])


_OI = """d AS (SELECT symbol, CAST(bar_ts AS DATE) AS trade_date, last(oi ORDER BY bar_ts) FILTER (oi <> 0) AS raw_oi FROM minutes GROUP BY 1, 2),
r AS (SELECT symbol, trade_date, raw_oi, CASE WHEN day(trade_date) % 11 = 0 OR day(trade_date) % 7 = 0 THEN NULL WHEN day(trade_date) % 5 = 0 THEN raw_oi * 4 WHEN day(trade_date) >= 10 THEN raw_oi * 90 ELSE raw_oi * 1.5 END AS expected_oi FROM d),
g AS (SELECT *, expected_oi / raw_oi AS ratio, CASE WHEN expected_oi / raw_oi IS NULL THEN 'unknown' WHEN expected_oi / raw_oi BETWEEN 0.5 AND 2 THEN 'near_one' WHEN expected_oi / raw_oi >= 10 THEN 'x100_raw_oi' ELSE 'ambiguous' END AS regime FROM r)"""
reg("d26_oi_scale", _regimes, f"WITH {_OI} SELECT symbol, trade_date, raw_oi, expected_oi, ratio, regime FROM g", "symbol trade_date regime", "raw_oi expected_oi ratio")
reg(
    "d26_oi_boundaries", lambda v: checks.oi_boundaries(_regimes(v), ["symbol"]),
    f"""WITH {_OI}, b AS (SELECT symbol AS s, min(trade_date) FILTER (regime = 'x100_raw_oi') AS first_x100 FROM g GROUP BY 1) SELECT symbol, first_x100, max(trade_date) FILTER (regime = 'near_one' AND trade_date < first_x100) AS last_near_one_before,
      {", ".join(f"count(*) FILTER (regime = '{r}') AS n_{r}" for r in ("near_one", "x100_raw_oi", "ambiguous", "unknown"))} FROM g JOIN b ON s = symbol GROUP BY 1, 2""",
    "symbol first_x100 last_near_one_before n_near_one n_x100_raw_oi n_ambiguous n_unknown",
)
reg("d26_rescaled_oi", lambda v: checks.rescaled_oi(v.minutes, _regimes(v), ["symbol"]), f"WITH {_OI} SELECT m.symbol, bar_ts, CASE WHEN regime = 'x100_raw_oi' THEN oi * 100 ELSE oi END AS oi FROM minutes m JOIN g ON g.symbol = m.symbol AND trade_date = CAST(bar_ts AS DATE)", "symbol bar_ts", "oi")


def _decided(v):
    s = v.scores.withColumn("side", F.when(F.col("p") >= 0.5, "LONG").otherwise("SHORT"))
    win = (F.col("y") == 1) == (F.col("side") == "LONG")
    held = F.make_dt_interval(mins=F.col("event_id") % 300)
    return s.withColumns({"win": win, "exit_ts": F.when(F.col("event_id") % 17 != 0, F.col("ts") + held)})


_RATES = """s AS (SELECT event_id, symbol, ts, p, CASE WHEN p >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS side, (y = 1) = (p >= 0.5) AS win, CASE WHEN event_id % 17 <> 0 THEN ts + to_minutes(event_id % 300) END AS exit_ts FROM scores),
o AS (SELECT symbol, side, exit_ts, event_id, avg(CAST(win AS DOUBLE)) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate, count(*) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 20 AS maturity FROM s WHERE exit_ts IS NOT NULL WINDOW w AS (PARTITION BY symbol, side ORDER BY exit_ts, event_id)),
q AS (SELECT symbol, side, exit_ts, max_by(rate, event_id) AS rate, max_by(maturity, event_id) AS maturity FROM o GROUP BY 1, 2, 3),
t AS (SELECT s.event_id, s.side, coalesce(q.rate, 0.5) AS win_rate, coalesce(q.maturity, 0) AS maturity FROM s ASOF LEFT JOIN q ON s.symbol = q.symbol AND s.side = q.side AND s.ts > q.exit_ts)"""
reg(
    "m04_resolved_rates", lambda v: meta.filtered_actions(meta.resolved_rates(_decided(v), ["symbol", "side"], "ts", "exit_ts", "win", "event_id").withColumnRenamed("side", "action"), "action", "win_rate", 0.45),
    f"WITH {_RATES} SELECT event_id, CASE WHEN win_rate >= 0.45 THEN side ELSE 'NO_TRADE' END AS action, win_rate, maturity FROM t", "event_id action", "win_rate maturity",
)
_W = "PARTITION BY symbol ORDER BY bar_ts"
_RETURN = lambda n: f"CASE WHEN lag(close, {n}) OVER w <> 0 THEN coalesce(close / lag(close, {n}) OVER w - 1, 0) ELSE 0 END"


def _family_f(v):
    df = E.time_features(E.volatility(v.bars))
    return df.withColumn("trend", F.when(F.col("r1") > 0, "up").when(F.col("r1") < 0, "down").otherwise("flat"))


def _family_m(v):
    return E.running_vwap(E.volume_ratio(E.price_returns(v.bars, (1, 3))))


def _family_x(v):
    df = E.price_returns(v.bars, (1, 3))
    market = df.groupBy("bar_ts").agg(F.avg("return_1").alias("return_1"))
    return E.cross_section_rank(J.relative_strength(df, market, "bar_ts", "return_1"), "relative")


_PRICES = f"p AS (SELECT *, {_RETURN(1)} AS return_1, {_RETURN(3)} AS return_3 FROM bars WINDOW w AS ({_W}))"
reg(
    "e48_volatility_calendar_regime", _family_f,
    f"""SELECT symbol, bar_ts, (dayofweek(trade_date) + 6) % 7 AS weekday, slot / 23.0 AS progress, high - low AS bar_range, range_bps, coalesce(stddev_pop(r1) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS volatility, CASE WHEN r1 > 0 THEN 'up' WHEN r1 < 0 THEN 'down' ELSE 'flat' END AS trend
      FROM (SELECT *, CASE WHEN close <> 0 THEN (high - low) / close * 10000 ELSE 0 END AS range_bps, CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END AS r1 FROM bars WINDOW w AS ({_W}))""",
    "symbol bar_ts weekday trend", "progress bar_range range_bps volatility",
)
reg(
    "e48_price_volume_vwap", _family_m,
    f"""WITH {_PRICES} SELECT symbol, bar_ts, return_1, return_3, CASE WHEN m > 0 THEN volume / m ELSE 1 END AS volume_ratio, CASE WHEN vwap <> 0 THEN close / vwap - 1 ELSE 0 END AS vwap_distance FROM (SELECT *, avg(volume) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m,
      coalesce(sum(close * volume) OVER ({_W} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0), close) AS vwap FROM p)""",
    "symbol bar_ts", "return_1 return_3 volume_ratio vwap_distance",
)
reg(
    "e48_price_relative_rank", _family_x,
    f"""WITH {_PRICES} SELECT symbol, bar_ts, return_1, return_3, relative, (row_number() OVER (PARTITION BY bar_ts ORDER BY relative, symbol) - 1) / greatest(count(*) OVER (PARTITION BY bar_ts) - 1, 1) AS cs_rank FROM (SELECT *, return_1 - avg(return_1) OVER (PARTITION BY bar_ts) AS relative FROM p)""",
    "symbol bar_ts", "return_1 return_3 relative",
)


def _bars_log(v):
    """Minute bars as an unbroken log of each symbol, in which some bars come late."""
    seq = F.row_number().over(Window.partitionBy("symbol").orderBy("bar_ts"))
    log = v.minutes.withColumn("seq", seq).withColumn("bar_id", F.when(F.col("seq") % 50 == 0, F.col("seq") - 2).otherwise(F.col("seq"))).withColumn("content", F.concat_ws("|", "symbol", "seq"))
    return log.withColumn("stored", F.sha2("content", 256)).withColumn("previous", F.coalesce(F.lag("stored").over(Window.partitionBy("symbol").orderBy("seq")), F.lit("GENESIS")))


reg(
    "s08_rising_bars", lambda v: S.chain_violations(_bars_log(v), "symbol", "seq", "content", "stored", "previous", (["symbol"], "bar_id")),
    "SELECT symbol, seq, 'order' AS violations FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS seq FROM minutes) WHERE seq % 50 = 0", "symbol seq violations",
)


def _lake(v) -> str:
    path = S.scratch(v.spark) + "/silver"
    T.write_partitions(v.bars.select("symbol", "trade_date", "bar_ts", "close"), path, "trade_date", "symbol")
    return path


reg(
    "a03_date_range_scan", lambda v: T.scan(v.spark, _lake(v), ["symbol", "bar_ts", "trade_date", "close"], {"trade_date": (date(2024, 1, 5), date(2024, 1, 9))}, symbol=["click", "view"]),
    "SELECT symbol, bar_ts, trade_date, close FROM bars WHERE symbol IN ('click', 'view') AND trade_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'", "symbol bar_ts trade_date", "close",
)
reg(
    "i08_thirty_day_chunks", lambda v: C.day_chunks(v.table("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")), "a", "b"),
    "SELECT o_custkey, CAST(a + CAST(k * 30 AS INTEGER) AS DATE) AS chunk_from, CAST(least(b, a + CAST(k * 30 + 29 AS INTEGER)) AS DATE) AS chunk_to FROM (SELECT *, unnest(range(0, (b - a) // 30 + 1)) AS k FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1))",
    "o_custkey chunk_from chunk_to",
)
