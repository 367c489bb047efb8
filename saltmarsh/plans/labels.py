"""Queries of path labels and of selection, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import features as E
from saltmarsh.operators import labels as L
from saltmarsh.operators import select as S
from saltmarsh.plans.views import reg

SES, SYM = ["symbol", "trade_date"], ["symbol"]


def _touch_sql(h: int, up: str, down: str, entry: str = "e.open", keys: str = "symbol, trade_date", side: int = 1, src: str = "bars", full: bool = False) -> str:
    """Explode-and-join form: path rows by position, first touch by minimum position."""
    same = " AND ".join(f"{{0}}.{k} = a.{k}" for k in keys.split(", "))
    t, s = ("b.high >= tp", "b.low <= sp") if side > 0 else ("b.low <= tp", "b.high >= sp")
    best, worst = ("max(high)", "min(low)") if side > 0 else ("min(low)", "max(high)")
    return f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY bar_ts) AS seq FROM {src}),
      q AS (SELECT a.*, {entry} AS entry, CAST({up} AS DOUBLE) AS tp, CAST({down} AS DOUBLE) AS sp FROM n a LEFT JOIN n e ON {same.format('e')} AND e.seq = a.seq + 1),
      p AS (SELECT a.symbol, a.bar_ts, a.trade_date, a.slot, a.entry, a.tp, a.sp, b.seq - a.seq AS k, b.high, b.low, b.close, {t} AS t, {s} AS s FROM q a JOIN n b ON {same.format('b')} AND b.seq BETWEEN a.seq + 1 AND a.seq + {h}),
      m AS (SELECT symbol, bar_ts, min(k) FILTER (s) AS ks, min(k) FILTER (t) AS kt, max(k) AS kmax FROM p GROUP BY 1, 2),
      x AS (SELECT *, CASE WHEN ks IS NOT NULL AND ks <= coalesce(kt, 999999) THEN 'stop' WHEN kt IS NOT NULL THEN 'target' ELSE 'timeout' END AS outcome, least(coalesce(ks, kmax), coalesce(kt, kmax)) AS bars_held, coalesce(ks = kt, false) AS ambiguous FROM m),
      y AS (SELECT p.symbol, p.bar_ts, x.outcome, x.bars_held, x.ambiguous, any_value(entry) AS entry, any_value(CASE x.outcome WHEN 'stop' THEN sp WHEN 'target' THEN tp END) AS px, any_value(p.close) FILTER (k = kmax) AS last_close, {best.split('(')[0]}({best.split('(')[1][:-1]}) FILTER (k <= x.bars_held) AS b, {worst.split('(')[0]}({worst.split('(')[1][:-1]}) FILTER (k <= x.bars_held) AS w FROM p JOIN x USING (symbol, bar_ts) GROUP BY ALL)
      SELECT q.symbol, q.bar_ts, q.trade_date, q.slot, coalesce(outcome, 'excluded') AS outcome, bars_held, coalesce(ambiguous, false) AS ambiguous, coalesce(px, last_close) AS exit_px, (coalesce(px, last_close) / y.entry - 1) * 10000 * {side} AS gross_bps, (b / y.entry - 1) * 10000 * {side} AS mfe_bps, (w / y.entry - 1) * 10000 * {side} AS mae_bps, y.entry AS entry_px FROM q LEFT JOIN y USING (symbol, bar_ts)"""


OUT, REAL = "symbol bar_ts outcome bars_held ambiguous", "exit_px gross_bps mfe_bps mae_bps"
_ATR = "(SELECT *, avg(high - low) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr FROM bars)"


def _atr(v):
    return v.bars.withColumn("atr", F.avg(F.col("high") - F.col("low")).over(E.trailing(E.SYMBOL, 14)))


for name, side in (("long", 1), ("short", -1)):
    sign = "+" if side > 0 else "-"
    anti = "-" if side > 0 else "+"
    reg(
        f"f01_atr_barriers_{name}", lambda v, side=side: L.atr_barriers(_atr(v), SES, "bar_ts", 6, "atr", 0.8, 0.6, side, 3.5),
        _touch_sql(6, f"e.open {sign} 0.8 * a.atr", f"e.open {anti} 0.6 * a.atr", side=side, src=_ATR), OUT, REAL,
    )
    reg(
        f"f05_close_barriers_{name}", lambda v, side=side: L.percent_barriers(v.bars, SYM, "bar_ts", 8, 0.4, 0.3, side, next_open=False),
        _touch_sql(8, f"a.close * (1 {sign} 0.4::DOUBLE)", f"a.close * (1 {anti} 0.3::DOUBLE)", "a.close", "symbol", side), OUT, REAL,
    )
reg(
    "f02_full_horizon_labels", lambda v: L.percent_barriers(v.bars, SYM, "bar_ts", 5, 0.5, 0.4, 1, next_open=False).where(F.size("path") == 5),
    "SELECT r.* FROM (" + _touch_sql(5, "a.close * (1 + 0.5::DOUBLE)", "a.close * (1 - 0.4::DOUBLE)", "a.close", "symbol") + ") r JOIN (SELECT symbol, bar_ts, count(*) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM bars) USING (symbol, bar_ts) WHERE ahead = 5", OUT, REAL,
)
_CP = "(SELECT a.symbol, a.bar_ts, coalesce(min(k) FILTER (b >= c * 1.4), 999999) AS lt, coalesce(min(k) FILTER (b <= c * (1 - 0.3::DOUBLE)), 999999) AS ls, coalesce(min(k) FILTER (b <= c * (1 - 0.4::DOUBLE)), 999999) AS st, coalesce(min(k) FILTER (b >= c * 1.3), 999999) AS ss FROM (WITH n AS (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY bar_ts) AS seq FROM bars) SELECT a.symbol, a.bar_ts, a.close AS c, b.close AS b, b.seq - a.seq AS k FROM n a LEFT JOIN n b ON a.symbol = b.symbol AND a.trade_date = b.trade_date AND b.seq BETWEEN a.seq + 1 AND a.seq + 10) a GROUP BY 1, 2)"
reg("f03_close_parity", lambda v: L.close_parity(v.bars, SES, "bar_ts", 10, 0.4, 0.3), f"SELECT symbol, bar_ts, CAST(lt < ls AS BIGINT) AS long_label, CAST(st < ss AS BIGINT) AS short_label FROM {_CP}", "symbol bar_ts long_label short_label")
_F4 = _touch_sql(6, "e.open * (1 + 0.4::DOUBLE)", "e.open * (1 - 0.3::DOUBLE)")
reg(
    "f04_execution_labels", lambda v: L.percent_barriers(v.bars, SES, "bar_ts", 6, 0.4, 0.3).withColumn("net_bps", F.col("gross_bps") - F.lit(3.5)).withColumn("r_units", F.col("net_bps") / 3000).withColumn("label", F.when(F.col("outcome") != "excluded", (F.col("net_bps") > 0).cast("long"))),
    f"SELECT *, gross_bps - 3.5 AS net_bps, (gross_bps - 3.5) / 3000 AS r_units, CAST(gross_bps - 3.5 > 0 AS BIGINT) AS label FROM ({_F4})", OUT + " label", REAL + " net_bps r_units",
)


def _signals(v):
    df = L.percent_barriers(E.signal_gate(v.bars), SES, "bar_ts", 4, 0.4, 0.3)
    return df.withColumn("seq", F.row_number().over(E.rows(E.SESSION)).cast("long")).where((F.col("gate") != 0) & (F.size("path") == 4)).withColumn("exit_seq", F.col("seq") + F.col("bars_held"))


_SEQ = "(SELECT symbol, trade_date, bar_ts, volume, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY bar_ts) AS seq, count(*) OVER (PARTITION BY symbol, trade_date ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM bars)"


def _signals_sql() -> str:
    from saltmarsh.plans.features import _GATE

    return f"SELECT t.*, s.seq, s.seq + t.bars_held AS exit_seq FROM ({_touch_sql(4, 'e.open * (1 + 0.4::DOUBLE)', 'e.open * (1 - 0.3::DOUBLE)')}) t JOIN ({_GATE}) g USING (symbol, bar_ts) JOIN {_SEQ} s USING (symbol, bar_ts) WHERE g.gate <> 0 AND s.ahead = 4"


reg("f06_gated_outcomes", _signals, _signals_sql(), OUT + " seq exit_seq", REAL)
reg(
    "f07_keep_disjoint", lambda v: L.keep_disjoint(_signals(v), SES, "seq", "exit_seq"),
    f"""WITH RECURSIVE g AS (SELECT symbol, trade_date, seq, exit_seq FROM ({_signals_sql()})), k AS (SELECT symbol, trade_date, min(seq) AS seq FROM g GROUP BY 1, 2
      UNION ALL SELECT symbol, trade_date, nxt FROM (SELECT k.symbol, k.trade_date, (SELECT min(n.seq) FROM g n WHERE n.symbol = k.symbol AND n.trade_date = k.trade_date AND n.seq > g.exit_seq) AS nxt FROM k JOIN g ON g.symbol = k.symbol AND g.trade_date = k.trade_date AND g.seq = k.seq) WHERE nxt IS NOT NULL) SELECT * FROM k""",
    "symbol trade_date seq",
)
reg(
    "f08_gap_through", lambda v: L.percent_barriers(v.bars, SES, "bar_ts", 6, 0.4, 0.3).withColumn("pnl", F.greatest(F.col("gross_bps") - 3.5, F.lit(-4000.0))).select("*"),
    f"SELECT *, greatest(gross_bps - 3.5, -4000.0) AS pnl FROM ({_F4}) WHERE true", "symbol bar_ts outcome", "pnl",
)
_ADM = "(SELECT config, date, line + order_key * 10 AS o, gross_bps FROM trades)"
reg(
    "f09_daily_admission", lambda v: L.daily_admission(v.trades.withColumn("o", F.col("line") + F.col("order_key") * 10).withColumn("bucket", F.col("config") % 10), ["fold", "bucket", "side"], "o", "gross_bps", 3, -50.0),
    """WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY fold, bucket, side ORDER BY o) AS r FROM (SELECT fold, config % 10 AS bucket, side, line + order_key * 10 AS o, gross_bps FROM trades)),
      k AS (SELECT fold, bucket, side, r, o, 1 AS n, gross_bps AS s FROM t WHERE r = 1 UNION ALL SELECT t.fold, t.bucket, t.side, t.r, t.o, k.n + 1, k.s + t.gross_bps FROM k JOIN t ON t.fold = k.fold AND t.bucket = k.bucket AND t.side = k.side AND t.r = k.r + 1 WHERE k.n < 3 AND k.s > -50) SELECT fold, bucket, side, o FROM k""",
    "fold bucket side o",
)
_GEO = [(4000, 3000), (6000, 4000), (2, 3000)]
reg(
    "d38_viability", lambda v: L.viability(v.bars, SYM, "bar_ts", 5, _GEO, 3.5),
    " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS target_bps, {s}::DOUBLE AS stop_bps, count(*) AS n, count(*) FILTER (outcome = 'target') AS n_target, count(*) FILTER (outcome = 'stop') AS n_stop, count(*) FILTER (outcome = 'timeout') AS n_timeout, count(*) FILTER (outcome = 'target') / count(*) AS hit_rate, {1.0 if t <= 3.5 else (s + 3.5) / (t + s)} AS breakeven FROM (SELECT r.* FROM ({_touch_sql(5, f'a.close * (1 + {t}::DOUBLE / 10000)', f'a.close * (1 - {s}::DOUBLE / 10000)', 'a.close', 'symbol')}) r JOIN (SELECT symbol, bar_ts, count(*) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM bars) USING (symbol, bar_ts) WHERE ahead = 5)"
        for t, s in _GEO
    ),
    "target_bps stop_bps n n_target n_stop n_timeout", "hit_rate breakeven",
)
reg(
    "f10_best_contract", lambda v: L.best_contract(L.viability(v.bars, ["symbol", "trade_date"], "bar_ts", 4, _GEO, 3.5).withColumn("edge", F.col("hit_rate") - F.col("breakeven")), ["target_bps", "stop_bps"], "edge"),
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS target_bps, {s}::DOUBLE AS stop_bps, count(*) FILTER (outcome = 'target') / count(*) - {1.0 if t <= 3.5 else (s + 3.5) / (t + s)} AS mean_net, 1::BIGINT AS n FROM (SELECT r.* FROM ({_touch_sql(4, f'a.close * (1 + {t}::DOUBLE / 10000)', f'a.close * (1 - {s}::DOUBLE / 10000)', 'a.close')}) r JOIN {_SEQ} USING (symbol, bar_ts) WHERE ahead = 4)" for t, s in _GEO
    ) + ") ORDER BY round(mean_net, 9) DESC, target_bps, stop_bps LIMIT 1",
    "target_bps stop_bps n", "mean_net",
)
reg("g01_top_k", lambda v: S.top_k(v.scores.withColumn("hour", F.date_trunc("day", "ts").cast("timestamp_ntz")), ["hour"], 5, F.col("p").desc(), "event_id"), "SELECT date_trunc('day', ts)::TIMESTAMP AS hour, event_id, p, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY p DESC, event_id) AS rank FROM scores QUALIFY rank <= 5", "hour event_id rank", "p")
reg(
    "g02_top_momentum", lambda v: S.top_k(E.momentum_bps(v.bars, 1, E.SYMBOL).where("momentum_bps IS NOT NULL"), ["bar_ts"], 2, F.col("momentum_bps").desc(), "symbol"),
    "SELECT * FROM (SELECT symbol, bar_ts, m AS momentum_bps, row_number() OVER (PARTITION BY bar_ts ORDER BY m DESC, symbol) AS rank FROM (SELECT *, CASE WHEN lag(close) OVER w <> 0 THEN (close / lag(close) OVER w - 1) * 10000 END AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) WHERE m IS NOT NULL) WHERE rank <= 2", "symbol bar_ts rank", "momentum_bps",
)
reg(
    "g03_both_sides", lambda v: S.both_sides(v.bars.withColumn("le", F.col("high") - F.col("close")).withColumn("se", F.col("close") - F.col("low")), ["bar_ts"], "le", "se", 2, 0.0, "symbol"),
    """SELECT symbol, bar_ts, CASE WHEN l AND s THEN CASE WHEN le >= se THEN 'LONG' ELSE 'SHORT' END WHEN l THEN 'LONG' WHEN s THEN 'SHORT' ELSE 'NO_TRADE' END AS action FROM (SELECT *, row_number() OVER (PARTITION BY bar_ts ORDER BY le DESC, symbol) <= 2 AS l, row_number() OVER (PARTITION BY bar_ts ORDER BY se DESC, symbol) <= 2 AS s FROM (SELECT *, high - close AS le, close - low AS se FROM bars))""",
    "symbol bar_ts action",
)
reg(
    "g04_top_bottom_spread", lambda v: S.top_bottom_spread(v.panel, "date", "value", "n", 3, 10.0, "name"),
    "SELECT date, gross, gross - 20 AS net FROM (SELECT date, avg(n) FILTER (t <= 3) - avg(n) FILTER (b <= 3) AS gross FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, name) AS t, row_number() OVER (PARTITION BY date ORDER BY value, name DESC) AS b, count(*) OVER (PARTITION BY date) AS c FROM panel) WHERE c >= 6 GROUP BY 1)", "date", "gross net",
)
reg(
    "g05_by_worst_fold", lambda v: S.by_worst_fold(v.trades, "config", "fold", "gross_bps", 30),
    "SELECT config, min(m) AS worst, avg(m) AS mean, CAST(sum(n) AS BIGINT) AS n FROM (SELECT config, fold, avg(gross_bps) AS m, count(*) AS n FROM trades GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) >= 30 ORDER BY round(min(m), 9) DESC, round(avg(m), 9) DESC, sum(n) DESC, config LIMIT 1", "config n", "worst mean",
)
reg("g06_hashed_sample", lambda v: S.hashed_sample(v.trades.withColumn("id", F.col("order_key") * 10 + F.col("line")), "side", 20, "side", "id"), "SELECT side, id, sha256(concat_ws('|', side, id)) AS digest, row_number() OVER (PARTITION BY side ORDER BY sha256(concat_ws('|', side, id))) AS rank FROM (SELECT *, order_key * 10 + line AS id FROM trades) QUALIFY rank <= 20", "side id digest rank")
reg("g07_every_nth", lambda v: S.every_nth(v.bars, ["symbol"], ["bar_ts"], 7), "SELECT symbol, bar_ts FROM bars QUALIFY (row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1) % 7 = 0", "symbol bar_ts")
reg("h01_keep_last", lambda v: S.keep_last(v.ticks.withColumn("day", F.to_date("ts")), ["symbol", "day"], ["ts", "event_id"], "price"), "SELECT symbol, CAST(ts AS DATE) AS day, last(price ORDER BY ts, event_id) AS price, count(*) AS n, count(DISTINCT price) <= 1 AS identical FROM ticks GROUP BY 1, 2", "symbol day n identical", "price")
reg(
    "h02_candidate_pool", lambda v: v.trades.select("config", F.lit("trades").alias("origin")).distinct().unionByName(v.table("supplier").select(F.col("s_suppkey").alias("config"), F.lit("supplier").alias("origin"), "s_nationkey"), allowMissingColumns=True),
    "SELECT DISTINCT config, 'trades' AS origin, NULL::BIGINT AS s_nationkey FROM trades UNION ALL SELECT s_suppkey, 'supplier', s_nationkey FROM supplier", "config origin s_nationkey",
)
reg("h03_split_overlaps", lambda v: S.split_overlaps(v.trades.withColumn("split", F.when(F.col("fold") < 1995, "train").otherwise("test")), "split", "config"), "SELECT config, count(DISTINCT s) AS n_splits, string_agg(DISTINCT s, ',' ORDER BY s) AS splits FROM (SELECT config, CASE WHEN fold < 1995 THEN 'train' ELSE 'test' END AS s FROM trades) GROUP BY 1 HAVING count(DISTINCT s) > 1", "config n_splits splits")
reg("h04_sealed_split", lambda v: S.sealed_split(v.trades, "date", 0.2), "SELECT date, CASE WHEN r > n - greatest(1, least(ceil(n * 0.2), n - 1)) THEN 'sealed' ELSE 'select' END AS split FROM (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM trades))", "date split")
reg(
    "m07_stratified_split", lambda v: S.stratified_split(v.table("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", [("val", 0.1), ("test", 0.1), ("blind", 0.2)], "train", 42),
    "SELECT c_custkey, c_mktsegment, CASE WHEN r <= a THEN 'val' WHEN r <= a + a THEN 'test' WHEN r <= a + a + b THEN 'blind' ELSE 'train' END AS split FROM (SELECT *, round(n * 0.1) AS a, round(n * 0.2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat_ws('|', '42', c_custkey)), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer))", "c_custkey c_mktsegment split",
)
reg(
    "m05_embargo_folds", lambda v: S.embargo_folds(v.bars, "bar_ts", 3, 3600),
    "SELECT tile - 1 AS fold, min(t) AS valid_from, max(t) AS valid_to, count(*) AS n_valid, min(t) - INTERVAL 3600 SECONDS AS train_before FROM (SELECT t, ntile(4) OVER (ORDER BY t) AS tile FROM (SELECT DISTINCT bar_ts AS t FROM bars)) WHERE tile > 1 GROUP BY tile", "fold valid_from valid_to n_valid train_before",
)
reg(
    "m10_gates", lambda v: S.gates(v.trades.groupBy("config").agg(F.count("*").alias("n"), F.avg("gross_bps").alias("ev"), F.count_distinct("date").alias("days")), {"trades": F.col("n") >= 590, "days": F.col("days") >= 500, "ev": F.col("ev") > 10}),
    "SELECT config, n >= 590 AS gate_trades, days >= 500 AS gate_days, ev > 10 AS gate_ev, concat_ws(',', CASE WHEN NOT n >= 590 THEN 'trades' END, CASE WHEN NOT days >= 500 THEN 'days' END, CASE WHEN NOT ev > 10 THEN 'ev' END) AS failed, CASE WHEN NOT n >= 590 THEN 'trades' WHEN NOT days >= 500 THEN 'days' WHEN NOT ev > 10 THEN 'ev' END AS first_failed, n >= 590 AND days >= 500 AND ev > 10 AS passed FROM (SELECT config, count(*) AS n, avg(gross_bps) AS ev, count(DISTINCT date) AS days FROM trades GROUP BY 1)",
    "config gate_trades gate_days gate_ev failed first_failed passed",
)
