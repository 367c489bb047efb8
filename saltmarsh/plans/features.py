"""Queries of the feature operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import features as E
from saltmarsh.operators.bars import complete_buckets
from saltmarsh.plans.views import reg

KEY = "symbol bar_ts"
W = "PARTITION BY symbol ORDER BY bar_ts"
D = "PARTITION BY symbol, trade_date ORDER BY bar_ts"


def ratio(a: str, b: str, other: str = "0.0") -> str:
    return f"CASE WHEN ({a}) IS NOT NULL AND ({b}) IS NOT NULL AND ({b}) <> 0 THEN ({a}) / ({b}) - 1 ELSE {other} END"


reg("d01_resample", lambda v: v.bars, "SELECT * FROM bars", "symbol bar_ts volume n_ticks oi", "open high low close")
reg(
    "d02_complete_buckets", lambda v: complete_buckets(v.bars, 4, 4).select("*", F.col("n").alias("n_bars")),
    "SELECT symbol, trade_date, CAST(floor(slot / 4) AS BIGINT) AS bucket, first(open ORDER BY bar_ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY bar_ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n_bars, max(slot) AS last_slot, max(bar_ts) AS decision_ts FROM bars GROUP BY 1, 2, 3 HAVING count(*) = 4 AND max(slot) % 4 = 3",
    "symbol trade_date bucket volume n_bars last_slot decision_ts", "open high low close",
)
reg(
    "e01_price_returns", lambda v: E.price_returns(v.bars),
    "SELECT symbol, bar_ts, " + ", ".join(f"{ratio('close', f'lag(close, {n}) OVER w')} AS return_{n}" for n in (1, 3, 6, 12)) + f" FROM bars WINDOW w AS ({W})",
    KEY, "return_1 return_3 return_6 return_12",
)
reg(
    "e02_opening_gap", lambda v: E.opening_gap(v.bars),
    f"SELECT symbol, bar_ts, {ratio('open', 'p')} AS gap FROM (SELECT *, last_value(CASE WHEN close <> 0 THEN close END IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM bars)",
    KEY, "gap",
)
reg(
    "e03_liquidity", lambda v: E.liquidity(v.bars),
    f"""SELECT *, CASE WHEN adv >= 50000 THEN 'high' WHEN adv >= 5000 THEN 'medium' ELSE 'low' END AS liquidity_bucket FROM (
        SELECT symbol, bar_ts, close * volume AS traded_value, coalesce(avg(close * volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), close * volume) AS adv FROM bars)""",
    f"{KEY} liquidity_bucket", "traded_value adv",
)
reg(
    "e04_volatility", lambda v: E.volatility(v.bars),
    f"""SELECT symbol, bar_ts, high - low AS bar_range, CASE WHEN close <> 0 THEN (high - low) / close * 10000 ELSE 0.0 END AS range_bps,
        coalesce(stddev_pop(r1) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0.0) AS volatility
        FROM (SELECT *, CASE WHEN lag(close) OVER ({W}) <> 0 THEN close / lag(close) OVER ({W}) - 1 END AS r1 FROM bars)""",
    KEY, "bar_range range_bps volatility",
)
reg(
    "e05_volume_ratio", lambda v: E.volume_ratio(v.bars),
    f"SELECT *, volume_ratio - 1 AS volume_shock FROM (SELECT symbol, bar_ts, CASE WHEN m > 0 THEN volume / m ELSE 1.0 END AS volume_ratio FROM (SELECT *, avg(volume) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM bars))",
    KEY, "volume_ratio volume_shock",
)


def _vwap(part: str, price: str = "close", src: str = "bars") -> str:
    return f"(SELECT *, coalesce(sum({price} * volume) OVER ({part} ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER ({part} ROWS UNBOUNDED PRECEDING), 0), close) AS vwap FROM {src})"


reg("e06_running_vwap", lambda v: E.running_vwap(v.bars), f"SELECT *, {ratio('close', 'vwap')} AS vwap_distance FROM {_vwap(W)}", KEY, "vwap vwap_distance")
reg(
    "e07_cross_section_rank", lambda v: E.cross_section_rank(E.price_returns(v.bars), "return_1"),
    f"SELECT symbol, bar_ts, (row_number() OVER (PARTITION BY bar_ts ORDER BY r, symbol) - 1) / greatest(count(*) OVER (PARTITION BY bar_ts) - 1, 1) AS cs_rank FROM (SELECT *, {ratio('close', 'lag(close) OVER w')} AS r FROM bars WINDOW w AS ({W}))",
    KEY, "cs_rank",
)
_FIVE = f"""SELECT symbol, bar_ts, ret_1, ret_6, vwap, atr_14, vol_20, vol_ratio, CASE WHEN seq = 1 THEN {ratio('open', 'prev')} ELSE 0.0 END AS session_gap, {ratio('close', 'day_open')} AS open_to_now,
    CASE WHEN vol_20 > 0 THEN greatest(-8.0, least(8.0, ret_1 / vol_20)) ELSE 0.0 END AS scaled_return, CASE WHEN slot < 8 THEN 'open' WHEN slot < 16 THEN 'middle' ELSE 'close' END AS phase FROM (
  SELECT *, coalesce(stddev_pop(ret_1) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0.0) AS vol_20 FROM (
    SELECT *, {ratio('close', 'coalesce(lag(close, 1) OVER w, first_value(close) OVER w)')} AS ret_1, {ratio('close', 'coalesce(lag(close, 6) OVER w, first_value(close) OVER w)')} AS ret_6,
      avg(high - low) OVER ({W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr_14, CASE WHEN avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) > 0 THEN volume / avg(volume) OVER ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) ELSE 1.0 END AS vol_ratio,
      row_number() OVER ({D}) AS seq, lag(close) OVER w AS prev, first_value(open) OVER ({D}) AS day_open
    FROM {_vwap(D, '((high + low + close) / 3)')} WINDOW w AS ({W})))"""
reg("e08_five_minute_block", lambda v: E.five_minute_block(v.bars), _FIVE, f"{KEY} phase", "ret_1 ret_6 vwap atr_14 vol_20 vol_ratio session_gap open_to_now scaled_return")
reg(
    "e09_sector_signal", lambda v: E.sector_signal(E.price_returns(v.bars), F.substring("symbol", 1, 1)),
    f"SELECT symbol, bar_ts, sector, sector_return, r - sector_return AS vs_sector FROM (SELECT *, avg(r) OVER (PARTITION BY bar_ts, sector) AS sector_return FROM (SELECT *, substr(symbol, 1, 1) AS sector, {ratio('close', 'lag(close) OVER w')} AS r FROM bars WINDOW w AS ({W})))",
    f"{KEY} sector", "sector_return vs_sector",
)
_MOM = f"SELECT *, CASE WHEN lag(close, 4) OVER w <> 0 THEN (close / lag(close, 4) OVER w - 1) * 10000 END AS momentum_bps FROM bars WINDOW w AS ({D})"
reg("e10_momentum", lambda v: E.momentum_bps(v.bars, 4), _MOM, KEY, "momentum_bps")


def _full(expr: str, n: int, frame: str) -> str:
    return f"CASE WHEN count(*) OVER ({frame}) >= {n} THEN {expr} OVER ({frame}) END"


_F4 = f"{D} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING"
_BRK = f"SELECT *, coalesce(close > {_full('max(high)', 4, _F4)}, false) AS breakout, coalesce(close < {_full('min(low)', 4, _F4)}, false) AS breakdown FROM ({_MOM})"
reg("e11_breakouts", lambda v: E.breakouts(v.bars, 4), _BRK, f"{KEY} breakout breakdown")
reg("e12_vwap_deviation", lambda v: E.running_vwap(v.bars, E.SESSION), f"SELECT *, ({ratio('close', 'vwap')}) * 10000 AS vwap_bps FROM {_vwap(D)}", KEY, "vwap vwap_bps")
_RV = f"SELECT *, coalesce(stddev_samp(r_bps) OVER ({D} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0.0) AS realized_vol_bps FROM (SELECT *, CASE WHEN lag(close) OVER ({D}) <> 0 THEN (close / lag(close) OVER ({D}) - 1) * 10000 END AS r_bps FROM ({_BRK}))"
reg("e13_realized_vol", lambda v: E.realized_vol_bps(v.bars, 4), _RV, KEY, "realized_vol_bps")
_GATE = f"SELECT *, CAST(CASE WHEN slot BETWEEN 2 AND 20 AND realized_vol_bps >= 1 AND breakout AND momentum_bps > 0 THEN 1 WHEN slot BETWEEN 2 AND 20 AND realized_vol_bps >= 1 AND breakdown AND momentum_bps < 0 THEN -1 ELSE 0 END AS BIGINT) AS gate FROM ({_RV})"
reg("e14_signal_gate", lambda v: E.signal_gate(v.bars), _GATE, f"{KEY} gate")
reg(
    "e15_opening_range", lambda v: E.opening_range(v.bars),
    f"""SELECT *, CAST(CASE WHEN seq > 3 AND slot <= 20 AND volume > mv AND close > or_high * (1 + 5 / 10000.0) THEN 1 WHEN seq > 3 AND slot <= 20 AND volume > mv AND close < or_low * (1 - 5 / 10000.0) THEN -1 ELSE 0 END AS BIGINT) AS or_signal FROM (
      SELECT *, max(CASE WHEN seq <= 3 THEN high END) OVER (PARTITION BY symbol, trade_date) AS or_high, min(CASE WHEN seq <= 3 THEN low END) OVER (PARTITION BY symbol, trade_date) AS or_low,
        quantile_cont(volume, 0.5) OVER ({D} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mv FROM (SELECT *, row_number() OVER ({D}) AS seq FROM bars))""",
    f"{KEY} or_signal", "or_high or_low",
)
reg(
    "e16_basis_zscore", lambda v: E.basis_zscore(E.prior_session_close(v.bars).withColumn("basis", F.col("close") - F.col("open")), "basis", F.col("slot") == 0, 6),
    f"""SELECT *, CASE WHEN {_full('stddev_samp(basis)', 6, 'PARTITION BY symbol, epoch ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW')} > 0 THEN (basis - avg(basis) OVER (PARTITION BY symbol, epoch ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) / stddev_samp(basis) OVER (PARTITION BY symbol, epoch ORDER BY bar_ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END AS basis_z FROM (
      SELECT *, close - open AS basis, CAST(sum(CASE WHEN slot = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM bars)""",
    f"{KEY} epoch", "basis basis_z",
)
reg(
    "e17_roll_flag", lambda v: E.roll_flag(v.bars),
    f"""SELECT symbol, bar_ts, CAST(max(CASE WHEN oi_jump > 0.2 * oi_prev OR oi_jump > 2 * history THEN 1 ELSE 0 END) OVER ({D} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rolled FROM (
      SELECT j.*, h.history FROM (SELECT *, lag(oi) OVER ({D}) AS oi_prev, CASE WHEN oi > 0 AND lag(oi) OVER ({D}) > 0 THEN abs(oi - lag(oi) OVER ({D})) END AS oi_jump FROM bars) j
      LEFT JOIN (SELECT symbol, trade_date, quantile_cont(m, 0.5) OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS history FROM (
        SELECT symbol, trade_date, quantile_cont(oi_jump, 0.5) AS m FROM (SELECT *, CASE WHEN oi > 0 AND lag(oi) OVER ({D}) > 0 THEN abs(oi - lag(oi) OVER ({D})) END AS oi_jump FROM bars) GROUP BY 1, 2)) h USING (symbol, trade_date))""",
    f"{KEY} rolled",
)
_PRIOR = """SELECT b.*, prior_close FROM bars b JOIN (SELECT symbol, trade_date, lag(c) OVER (PARTITION BY symbol ORDER BY trade_date) AS prior_close FROM (SELECT symbol, trade_date, last(close ORDER BY bar_ts) AS c FROM bars GROUP BY 1, 2)) USING (symbol, trade_date)"""
reg("e18_prior_session_close", lambda v: E.prior_session_close(v.bars), _PRIOR, KEY, "prior_close")
reg(
    "e19_router_rows", lambda v: E.router_rows(v.bars),
    f"""SELECT *, coalesce(stddev_samp(return_bps) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 0.0) AS vol_bps FROM (SELECT symbol, bar_ts, CASE WHEN lag(close) OVER w <> 0 THEN (close / lag(close) OVER w - 1) * 10000 ELSE 0.0 END AS return_bps,
      coalesce(volume - lag(volume) OVER w, 0) AS volume_change, coalesce(oi - lag(oi) OVER w, 0) AS oi_change, CASE WHEN oi <> 0 THEN volume / oi ELSE 0.0 END AS volume_oi FROM bars WINDOW w AS ({W}))""",
    f"{KEY} volume_change oi_change", "return_bps vol_bps volume_oi",
)
reg(
    "e20_session_returns", lambda v: E.session_returns(v.bars),
    "SELECT symbol, bar_ts, " + ", ".join(f"CASE WHEN lag(close, {n}) OVER w > 0 THEN close / lag(close, {n}) OVER w - 1 END AS ret_{n}, CASE WHEN lag(close, {n}) OVER w > 0 AND close > 0 THEN ln(close / lag(close, {n}) OVER w) END AS log_ret_{n}" for n in (1, 3, 6)) + f" FROM bars WINDOW w AS ({D})",
    KEY, "ret_1 ret_3 ret_6 log_ret_1 log_ret_3 log_ret_6",
)
_TR = f"SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range FROM bars WINDOW w AS ({D})"
reg("e21_atr", lambda v: E.atr(v.bars), f"SELECT *, {', '.join(_full('avg(true_range)', 3, f'{D} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW') + f' AS atr_{n}' for n in (3, 6))} FROM ({_TR})", KEY, "true_range atr_3 atr_6")
_LR = f"SELECT *, CASE WHEN lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) END AS lr FROM bars WINDOW w AS ({D})"
_F6 = f"{D} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW"
_AV = f"SELECT *, CASE WHEN count(lr) OVER ({_F6}) >= 3 THEN stddev_samp(lr) OVER ({_F6}) * sqrt(375 * 252) END AS annual_vol FROM ({_LR})"
reg("e22_annual_vol", lambda v: E.annual_vol(v.bars), _AV, KEY, "annual_vol")
reg("e23_vwap_slope", lambda v: E.vwap_slope(v.bars), f"SELECT *, {ratio('close', 'vwap')} AS vwap_distance, vwap - lag(vwap, 5) OVER ({D}) AS vwap_slope FROM {_vwap(D)}", KEY, "vwap vwap_distance vwap_slope")
reg(
    "e24_opening_range_distance", lambda v: E.opening_range_distance(v.bars),
    """SELECT *, CAST(close > or_high AS BIGINT) AS above_or, CAST(close < or_low AS BIGINT) AS below_or, (close - or_low) / nullif(or_high - or_low, 0) AS or_location FROM (SELECT *, CASE WHEN slot >= 3 THEN max(CASE WHEN slot < 3 THEN high END) OVER (PARTITION BY symbol, trade_date) END AS or_high,
      CASE WHEN slot >= 3 THEN min(CASE WHEN slot < 3 THEN low END) OVER (PARTITION BY symbol, trade_date) END AS or_low FROM bars)""",
    f"{KEY} above_or below_or", "or_high or_low or_location",
)
reg(
    "e25_oi_features", lambda v: E.oi_features(v.bars),
    f"""SELECT symbol, bar_ts, oi_change_1, oi_change_5, CASE WHEN p > 0 AND oi_change_1 > 0 THEN 'long_buildup' WHEN p < 0 AND oi_change_1 > 0 THEN 'short_buildup' WHEN p > 0 AND oi_change_1 < 0 THEN 'short_covering' WHEN p < 0 AND oi_change_1 < 0 THEN 'long_unwinding' ELSE 'flat' END AS oi_quadrant
      FROM (SELECT *, oi - lag(oi) OVER w AS oi_change_1, oi - lag(oi, 5) OVER w AS oi_change_5, close - lag(close) OVER w AS p FROM bars WINDOW w AS ({D}))""",
    f"{KEY} oi_change_1 oi_change_5 oi_quadrant",
)
reg(
    "e26_time_features", lambda v: E.time_features(v.bars),
    "SELECT *, sin(2 * pi() * progress) AS progress_sin, cos(2 * pi() * progress) AS progress_cos FROM (SELECT symbol, bar_ts, greatest(0.0, least(1.0, slot / 23.0)) AS progress, CAST((dayofweek(trade_date) + 6) % 7 AS BIGINT) AS weekday FROM bars)",
    f"{KEY} weekday", "progress progress_sin progress_cos",
)


def _streak(equal: int) -> str:
    return f"""SELECT symbol, bar_ts, coalesce(row_number() OVER (PARTITION BY symbol, trade_date, run ORDER BY bar_ts) * dir, 0) AS streak FROM (SELECT *, sum(new_run) OVER ({D} ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN dir IS NULL OR dir <> coalesce(lag(dir) OVER ({D}), 9) THEN 1 ELSE 0 END AS new_run FROM (
        SELECT *, CASE WHEN c > 0 THEN 1 WHEN c < 0 THEN -1 WHEN c = 0 THEN {equal} END AS dir FROM (SELECT *, close - lag(close) OVER ({D}) AS c FROM bars))))"""


reg("e27_streak", lambda v: E.streak(v.bars), _streak(-1), f"{KEY} streak")
reg("e34_zero_reset_streak", lambda v: E.streak(v.bars, True), _streak(0), f"{KEY} streak")
reg(
    "e28_ema_slope", lambda v: E.ema_slope(v.bars),
    """SELECT b.symbol, b.bar_ts, f AS ema_fast, s AS ema_slow, f - s AS ema_slope FROM (WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY bar_ts) AS seq FROM bars),
      e AS (SELECT symbol, trade_date, bar_ts, seq, close AS f, close AS s FROM n WHERE seq = 1 UNION ALL SELECT n.symbol, n.trade_date, n.bar_ts, n.seq, e.f + 0.2 * (n.close - e.f), e.s + (2.0::DOUBLE / 22) * (n.close - e.s) FROM e JOIN n ON n.symbol = e.symbol AND n.trade_date = e.trade_date AND n.seq = e.seq + 1) SELECT * FROM e) b""",
    KEY, "ema_fast ema_slow ema_slope",
)
_F30 = f"{D} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW"
reg("e29_volume_z", lambda v: E.volume_z(v.bars), f"SELECT *, CASE WHEN count(*) OVER ({_F30}) >= 5 AND stddev_samp(volume) OVER ({_F30}) > 0 THEN (volume - avg(volume) OVER ({_F30})) / stddev_samp(volume) OVER ({_F30}) END AS volume_z FROM bars", KEY, "volume_z")
_REG = "CASE WHEN v >= q90 THEN 'shock' WHEN v >= q75 THEN 'high_vol' WHEN v <= q25 THEN 'compression' WHEN t > 0 THEN 'trend_up' WHEN t < 0 THEN 'trend_down' ELSE 'range' END"
_VT = "(SELECT *, high - low AS v, close - open AS t FROM bars)"


def _with_vt(v):
    return v.bars.withColumn("v", F.col("high") - F.col("low")).withColumn("t", F.col("close") - F.col("open"))


reg(
    "e30_full_frame_regime", lambda v: E.full_frame_regime(_with_vt(v), "v", "t"),
    f"SELECT b.*, {_REG} AS regime FROM {_VT} b, (SELECT quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.9) AS q90 FROM {_VT})",
    f"{KEY} regime",
)
_IDX = "(SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY trade_date) AS session_idx, high - low AS v, close - open AS t FROM bars)"
_S60 = "PARTITION BY symbol, slot ORDER BY session_idx RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING"
reg(
    "e31_causal_regime", lambda v: E.causal_regime(E.with_session_index(_with_vt(v)), "v", "t"),
    f"SELECT *, CASE WHEN q25 IS NOT NULL THEN {_REG} END AS regime FROM (SELECT *, " + ", ".join(f"CASE WHEN count(v) OVER ({_S60}) >= 20 THEN quantile_cont(v, {q}) OVER ({_S60}) END AS q{int(q * 100)}" for q in (0.25, 0.75, 0.9)) + f" FROM {_IDX})",
    f"{KEY} session_idx regime", "q25 q75 q90",
)
reg(
    "e32_full_sessions", lambda v: E.price_returns(v.bars.withColumn("n_bars", F.count("*").over(E.Window.partitionBy(*E.SESSION))).where("n_bars >= 20"), (1,)),
    f"SELECT *, {ratio('close', 'lag(close) OVER w')} AS return_1 FROM (SELECT *, count(*) OVER (PARTITION BY symbol, trade_date) AS n_bars FROM bars QUALIFY n_bars >= 20) WINDOW w AS ({W})",
    f"{KEY} n_bars", "return_1",
)
reg("e33_true_gap", lambda v: E.prior_session_close(v.bars), f"SELECT *, CASE WHEN prior_close <> 0 THEN first_value(open) OVER ({D}) / prior_close - 1 END AS true_gap FROM ({_PRIOR})", KEY, "true_gap")
_SAME = "SELECT *, " + ", ".join(f"CASE WHEN count({{x}}) OVER ({_S60}) >= 20 THEN {f} OVER ({_S60}) END AS {n}" for f, n in (("avg({x})", "base_mean"), ("stddev_pop({x})", "base_sd"), ("quantile_cont({x}, 0.5)", "base_median"))) + f" FROM {_IDX}"
reg(
    "e35_volume_surprise", lambda v: E.volume_surprise(E.with_session_index(v.bars)),
    f"SELECT *, CASE WHEN base_median > 0 AND volume > 0 THEN ln(volume / base_median) END AS volume_surprise FROM ({_SAME.format(x='volume')})",
    f"{KEY} session_idx", "base_median volume_surprise",
)
_SR = "SELECT *, " + ", ".join(f"CASE WHEN lag(close, {n}) OVER w > 0 THEN close / lag(close, {n}) OVER w - 1 END AS ret_{n}" for n in (1, 3, 6)) + f" FROM ({_AV}) WINDOW w AS ({D})"
reg("e36_scaled_returns", lambda v: E.scaled_returns(v.bars), "SELECT *, " + ", ".join(f"CASE WHEN annual_vol > 0 THEN ret_{n} / (annual_vol * sqrt({n} / 24.0)) END AS scaled_{n}" for n in (1, 3, 6)) + f" FROM ({_SR})", KEY, "scaled_1 scaled_3 scaled_6")
reg(
    "e37_same_slot", lambda v: E.same_slot(E.with_session_index(_with_vt(v)), "v"),
    f"SELECT *, CASE WHEN base_sd > 0 THEN (v - base_mean) / base_sd END AS slot_z, CASE WHEN base_median > 0 THEN v / base_median END AS median_ratio FROM ({_SAME.format(x='v')})",
    f"{KEY} session_idx", "base_mean base_sd base_median slot_z median_ratio",
)
_D60 = "PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING"
reg(
    "e38_session_zscore", lambda v: E.session_zscore(v.bars, F.max(F.when(F.col("slot") < 3, F.col("high"))) - F.min(F.when(F.col("slot") < 3, F.col("low")))),
    f"SELECT *, CASE WHEN count(session_value) OVER ({_D60}) >= 20 AND stddev_pop(session_value) OVER ({_D60}) > 0 THEN (session_value - avg(session_value) OVER ({_D60})) / stddev_pop(session_value) OVER ({_D60}) END AS session_z FROM (SELECT symbol, trade_date, max(CASE WHEN slot < 3 THEN high END) - min(CASE WHEN slot < 3 THEN low END) AS session_value FROM bars GROUP BY 1, 2)",
    "symbol trade_date", "session_value session_z",
)
_C5, _P5 = f"{D} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW", f"{D} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING"
reg(
    "e39_path_features", lambda v: E.path_features(v.bars),
    f"""SELECT symbol, bar_ts, CASE WHEN count(*) OVER ({_C5}) >= 5 THEN abs(close - lag(close, 4) OVER ({D})) / nullif(sum(step) OVER ({D} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 0) END AS efficiency,
      CASE WHEN count(*) OVER ({_C5}) >= 5 THEN (max(high) OVER ({_C5}) - close) / nullif(max(high) OVER ({_C5}) - min(low) OVER ({_C5}), 0) END AS pullback,
      CASE WHEN count(*) OVER ({_P5}) = 5 AND avg(high - low) OVER ({_P5}) > 0 THEN (high - low) / avg(high - low) OVER ({_P5}) END AS range_expansion FROM (SELECT *, abs(close - lag(close) OVER ({D})) AS step FROM bars)""",
    KEY, "efficiency pullback range_expansion",
)
reg("e40_eligibility", lambda v: E.eligibility(v.bars, 3, 2, 20), f"SELECT *, slot BETWEEN 2 AND 20 AND coalesce(lead(slot, 3) OVER ({D}) = slot + 3, false) AS eligible FROM bars", f"{KEY} eligible")
reg("e42_flow_means", lambda v: E.flow_means(v.daily, "value"), "SELECT date, avg(value) OVER (ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS flow_mean FROM daily", "date", "flow_mean")
reg(
    "e46_forward_returns", lambda v: E.forward_returns(v.panel),
    """SELECT *, 1 - (rank - 1) / greatest(count(*) OVER (PARTITION BY date) - 1, 1) AS pct FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY fwd_1 DESC, name) AS rank FROM (
      SELECT name, date, CASE WHEN value <> 0 THEN (lead(value, 1) OVER w / value - 1) * 10000 END AS fwd_1, CASE WHEN value <> 0 THEN (lead(value, 3) OVER w / value - 1) * 10000 END AS fwd_3 FROM panel WINDOW w AS (PARTITION BY name ORDER BY date)) WHERE fwd_1 IS NOT NULL)""",
    "name date rank", "fwd_1 fwd_3 pct",
)
reg("e47_one_bar_momentum", lambda v: E.momentum_bps(v.bars, 1, E.SYMBOL), f"SELECT *, CASE WHEN lag(close) OVER w <> 0 THEN (close / lag(close) OVER w - 1) * 10000 END AS momentum_bps FROM bars WINDOW w AS ({W})", KEY, "momentum_bps")
