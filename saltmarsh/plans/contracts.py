"""Queries of contract calendars against what was recorded, trade summaries, gates and fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import asof as J
from saltmarsh.operators import contracts as X
from saltmarsh.operators import metrics as M
from saltmarsh.operators import select as C
from saltmarsh.plans.views import reg
from saltmarsh.sources import tables as T

_MOVED = 10_000  # days from the orders to the events


def _contracts(v):
    """Line items as quotes of weekly contracts of two underlyings."""
    i = v.table("lineitem").select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", F.to_date("l_shipdate").alias("ship"))
    o = v.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.concat(F.lit("f"), F.col("o_custkey") % 2).alias("symbol"), F.date_add(F.to_date("o_orderdate"), _MOVED).alias("trade_date"))
    return o.join(i, "l_orderkey").select(
        "symbol", "trade_date", F.date_add(F.trunc("ship", "week"), _MOVED).alias("expiry"), F.date_add("ship", _MOVED).alias("ship"), (F.col("l_suppkey") % 4).alias("id"), F.col("l_suppkey").alias("maker"),
        F.col("l_quantity").cast("double").alias("close"), (F.col("l_linenumber") * 10).cast("double").alias("oi"), F.when(F.col("l_linenumber") % 3 == 0, "udiff").otherwise("legacy").alias("source"),
    )


_CONTRACTS = """c AS (SELECT 'f' || CAST(o_custkey % 2 AS VARCHAR) AS symbol, CAST(o_orderdate AS DATE) + 10000 AS trade_date, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) + 10000 AS expiry, CAST(l_shipdate AS DATE) + 10000 AS ship, l_suppkey % 4 AS id, l_suppkey AS maker,
  CAST(l_quantity AS DOUBLE) AS close, CAST(l_linenumber * 10 AS DOUBLE) AS oi, CASE WHEN l_linenumber % 3 = 0 THEN 'udiff' ELSE 'legacy' END AS source FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def _ladder(v):
    return X.contract_ladder(_contracts(v), "trade_date", "expiry", "id", ["close", "oi"], ["symbol"])


_NAMES = ((1, "front"), (2, "next"), (3, "third"))
_LADDER = f"""{_CONTRACTS}, l AS (SELECT symbol, trade_date, {", ".join(f"max({c}) FILTER (r = {i}) AS {n}_{c}" for i, n in _NAMES for c in ("id", "expiry", "close", "oi"))} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY expiry, id) AS r FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, expiry, id ORDER BY close, oi) AS once FROM c WHERE expiry >= trade_date) WHERE once = 1) WHERE r <= 3 GROUP BY 1, 2)"""
_COLUMNS = [f"{n}_{c}" for _, n in _NAMES for c in ("id", "expiry")]
reg("c18_ladder", _ladder, f"WITH {_LADDER} SELECT * FROM l", " ".join(["symbol", "trade_date", *_COLUMNS]), " ".join(f"{n}_{c}" for _, n in _NAMES for c in ("close", "oi")))


def _evening(v):
    """Minute bars moved so that a session's third bar is that of 15:30, with open interest zero for half of them."""
    return v.minutes.withColumn("bar_ts", F.col("bar_ts") + F.make_dt_interval(mins=F.lit(373))).withColumn("oi", F.floor(F.col("oi") / 25) * 25)


_EVENING = "m AS (SELECT symbol, bar_ts + to_minutes(373) AS ts, CAST(bar_ts + to_minutes(373) AS DATE) AS d, strftime(bar_ts + to_minutes(373), '%H:%M:%S') AS t, close, volume, floor(oi / 25) * 25 AS oi FROM minutes)"
_PICK = "CASE WHEN {v} IS NULL OR least(abs({v} - front_{k}), abs({v} - next_{k}), abs({v} - third_{k})) IS NULL THEN NULL " + " ".join(f"WHEN abs({{v}} - {n}_{{k}}) = least(abs({{v}} - front_{{k}}), abs({{v}} - next_{{k}}), abs({{v}} - third_{{k}})) THEN '{n}'" for _, n in _NAMES) + " END"
reg(
    "c18_roll_evidence", lambda v: X.roll_evidence(_ladder(v), _evening(v), ["symbol"]),
    f"""WITH {_LADDER}, {_EVENING}, n AS (SELECT *, lag(trade_date) OVER w AS b_day, lag(front_expiry) OVER w AS b_expiry, lead(trade_date) OVER w IS NULL AS final FROM l WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
      e AS (SELECT *, trade_date AS expiry, 'expiry_day' AS role FROM n WHERE front_expiry = trade_date AND NOT final UNION ALL SELECT *, b_day, 'day_after' FROM n WHERE b_expiry = b_day),
      b AS (SELECT symbol AS bs, d AS bd, t AS bar_time, close AS bar_close, oi AS bar_oi FROM m QUALIFY row_number() OVER (PARTITION BY symbol, d ORDER BY t = '15:30:00' DESC, t = '15:29:00' DESC, ts DESC) = 1),
      j AS (SELECT *, {_PICK.format(v="bar_close", k="close")} AS by_close, {_PICK.format(v="bar_oi", k="oi")} AS by_oi FROM e LEFT JOIN b ON bs = symbol AND bd = trade_date)
    SELECT *, CASE WHEN bar_time IS NULL THEN 'missing_bars' WHEN by_close IS NULL THEN 'unusable' WHEN by_close = 'front' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM j""",
    "symbol expiry role trade_date bar_time by_close by_oi verdict", "bar_close bar_oi",
)
reg(
    "d33_expiry_sources", lambda v: X.expiry_sources(_contracts(v), "trade_date", "ship", "id", "source", "udiff"),
    f"""WITH {_CONTRACTS}, p AS (SELECT ship AS s, string_agg(CAST(id AS VARCHAR), ';' ORDER BY source, CAST(id AS VARCHAR)) AS every, string_agg(CAST(id AS VARCHAR), ';' ORDER BY CAST(id AS VARCHAR)) FILTER (source = 'udiff') AS own, string_agg(source, ';' ORDER BY source, CAST(id AS VARCHAR)) AS sources FROM (SELECT DISTINCT ship, id, source FROM c) GROUP BY 1),
      a AS (SELECT ship, CAST((dayofweek(ship) + 6) % 7 AS BIGINT) AS weekday, min(trade_date) AS first_day, max(trade_date) AS last_day FROM c GROUP BY 1)
    SELECT ship, weekday, first_day, last_day, coalesce(own, every) AS ids, sources, CASE WHEN lag(weekday) OVER (ORDER BY ship) <> weekday THEN lag(weekday) OVER (ORDER BY ship) END AS weekday_before FROM a JOIN p ON s = ship""",
    "ship weekday first_day last_day ids sources weekday_before",
)
reg("d33_expiry_weekdays", lambda v: X.expiry_weekdays(_contracts(v).select("ship").distinct(), "ship"), f"WITH {_CONTRACTS} SELECT CAST(date_trunc('month', ship) AS DATE) AS month, CAST((dayofweek(ship) + 6) % 7 AS BIGINT) AS weekday, count(DISTINCT ship) AS n FROM c GROUP BY 1, 2", "month weekday n")
reg("d34_moved_ids", lambda v: X.moved_ids(_contracts(v), "maker", "expiry"), f"WITH {_CONTRACTS} SELECT maker, count(DISTINCT expiry) AS n_expiries, min(expiry) AS first_expiry, max(expiry) AS last_expiry FROM c GROUP BY 1 HAVING count(DISTINCT expiry) > 1", "maker n_expiries first_expiry last_expiry")


def _order_days(v):
    return v.table("orders").select(F.to_date("o_orderdate").alias("day"), "o_orderstatus")


_PARTLY = "p AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'P')"
reg(
    "d34_absent_weekdays", lambda v: X.absent_weekdays(_order_days(v).where("o_orderstatus = 'P'"), "day"),
    f"WITH {_PARTLY} SELECT day, year(day) AS year FROM (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM p) WHERE (dayofweek(day) + 6) % 7 < 5 AND day NOT IN (SELECT day FROM p)", "day year",
)
reg(
    "d34_coverage", lambda v: X.coverage_by_year(_order_days(v), _order_days(v).where("o_orderstatus = 'P'"), "day"),
    f"WITH {_PARTLY} SELECT year(a) AS year, count(*) AS calendar_days, count(day) AS recorded_days, count(*) - count(day) AS missing_days FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS a FROM orders) LEFT JOIN p ON day = a GROUP BY 1", "year calendar_days recorded_days missing_days",
)


def _forensics(v):
    d = F.dayofmonth("trade_date")
    own = _evening(v).groupBy("symbol", F.to_date("bar_ts").alias("trade_date")).agg(F.avg("close").alias("c"), F.sum("volume").alias("s"), F.max("oi").alias("o"))
    calendar = own.select("symbol", F.when(d % 9 == 0, F.date_add("trade_date", 60)).otherwise(F.col("trade_date")).alias("trade_date"), F.col("c").alias("front_close"), (F.col("s") / 20).alias("front_volume"), F.lit(25).alias("lot"), F.when(d % 4 != 0, F.col("o")).alias("front_oi"))
    return X.backfill_forensics(_evening(v), calendar, ["symbol"])


_FORENSICS = f"""{_EVENING}, h AS (SELECT symbol AS hs, d AS hd, max(ts) FILTER (oi <> 0) AS held FROM m GROUP BY 1, 2),
a AS (SELECT symbol AS s0, d AS d0, count(*) AS bars, min(t) AS first_time, max(t) AS last_time, last(close ORDER BY ts) AS last_close, last(oi ORDER BY ts) AS last_oi, last(t ORDER BY volume > 0, ts) AS close_time, last(close ORDER BY volume > 0, ts) AS close_observed,
  last(t ORDER BY oi <> 0, ts) AS oi_time, last(oi ORDER BY oi <> 0, ts) AS oi_observed, sum(volume) AS volume_sum, count(*) FILTER (held IS NULL OR ts > held) AS zero_tail, min(t) FILTER (held IS NULL OR ts > held) AS zero_from, avg(close) AS c, max(oi) AS o FROM m JOIN h ON hs = symbol AND hd = d GROUP BY 1, 2),
f AS (SELECT k.symbol, k.trade_date, a.s0 IS NOT NULL AS found, a.*, (close_observed - e_close) / nullif(e_close, 0) AS close_rel, (last_close - e_close) / nullif(e_close, 0) AS last_close_rel, (oi_observed - e_oi) / nullif(e_oi, 0) AS oi_rel, volume_sum / nullif(e_volume * 25, 0) AS volume_ratio, volume_sum / nullif(e_volume, 0) AS raw_volume_ratio
  FROM (SELECT s0 AS symbol, CASE WHEN day(d0) % 9 = 0 THEN d0 + 60 ELSE d0 END AS trade_date, c AS e_close, volume_sum / 20 AS e_volume, CASE WHEN day(d0) % 4 <> 0 THEN o END AS e_oi FROM a) k LEFT JOIN a ON a.s0 = k.symbol AND a.d0 = k.trade_date)"""
reg(
    "d28_forensics", _forensics, f"WITH {_FORENSICS} SELECT * FROM f", "symbol trade_date found bars first_time last_time close_time oi_time zero_tail zero_from",
    "last_close last_oi close_observed oi_observed volume_sum close_rel last_close_rel oi_rel volume_ratio raw_volume_ratio",
)
_ITEMS = [("days", "''", "true"), ("bars", "CAST(bars AS VARCHAR)", "true"), ("last_time", "last_time", "true"), ("zero_last_oi", "''", "last_oi = 0"), ("until_close", "''", "last_time >= '15:30:00'")]
reg(
    "d28_vintage_report", lambda v: X.vintages(_forensics(v), F.when(F.dayofmonth("trade_date") <= 15, "first half").otherwise("second half")),
    f"WITH {_FORENSICS} " + " UNION ALL ".join(f"SELECT CASE WHEN day(trade_date) <= 15 THEN 'first half' ELSE 'second half' END AS vintage, '{w}' AS what, {e} AS level, count(*) AS n FROM f WHERE found AND {t} GROUP BY ALL" for w, e, t in _ITEMS), "vintage what level n",
)


def _quotes(v):
    """Ticks of a day as quotes of an option chain; some without a price, some that could not be parsed."""
    e = F.col("event_id")
    return v.ticks.select("symbol", F.date_trunc("day", "ts").alias("at"), F.when(e % 31 != 0, F.col("size") % 30).alias("strike"), F.when(e % 29 != 0, F.when(e % 2 == 0, "CE").otherwise("PE")).alias("kind"), F.when(e % 7 == 0, 0.0).when(e % 11 != 0, F.abs("price") + 1).alias("price"))


_SURFACE = """q AS (SELECT symbol, CAST(ts AS DATE) AS stamp, size % 30 AS k, CASE WHEN event_id % 2 = 0 THEN 'CE' ELSE 'PE' END AS kind, event_id % 7 <> 0 AND event_id % 11 <> 0 AS active FROM ticks WHERE event_id % 31 <> 0 AND event_id % 29 <> 0),
x AS (SELECT symbol AS xs, stamp AS xa, quantile_cont(k, 0.5) FILTER (active) AS middle FROM q GROUP BY 1, 2),
s AS (SELECT symbol, stamp, middle, """ + ", ".join(f"count(DISTINCT k) FILTER (active AND kind = '{k}' AND k {o} middle) AS {k.lower()}_{n}" for k in ("CE", "PE") for n, o in (("below", "<"), ("above", ">"))) + " FROM q JOIN x ON xs = symbol AND xa = stamp GROUP BY 1, 2, 3)"
_FOUR = "ce_below ce_above pe_below pe_above"
_SIDES = f"least({', '.join(_FOUR.split())})"
reg("d30_calls_and_puts", lambda v: X.surface_minutes(_quotes(v), ["symbol"], "at", "strike", "kind", "price").withColumn("day", F.to_date("at")), f"WITH {_SURFACE} SELECT *, stamp AS day, {_SIDES} >= 5 AS valid FROM s", f"symbol day {_FOUR} valid", "middle")
reg("d30_surface_share", lambda v: X.surface_share(X.surface_minutes(_quotes(v), ["symbol"], "at", "strike", "kind", "price"), ["symbol"], "at"), f"WITH {_SURFACE} SELECT symbol, count(*) AS session_minutes, count(*) FILTER ({_SIDES} >= 5) AS valid_minutes, count(*) FILTER ({_SIDES} >= 5) / count(*) AS share FROM s GROUP BY 1", "symbol session_minutes valid_minutes", "share")


def _series(v):
    return v.table("events").select(F.col("user_id").alias("name"), F.to_date("ts").alias("day"), "event_type")


def _own_days(v):
    return _series(v).groupBy("name").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("name", F.explode(F.sequence("a", "b")).alias("day"))


reg(
    "h01_series_faults", lambda v: X.series_faults(_series(v), _own_days(v), ["name"], "day"),
    """WITH s AS (SELECT user_id AS name, CAST(ts AS DATE) AS day, event_type FROM events), h AS (SELECT name, day, count(*) AS n, count(DISTINCT event_type) AS k FROM s GROUP BY 1, 2), c AS (SELECT name, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s GROUP BY 1)
    SELECT name, day, CASE WHEN k = 1 THEN 'identical' ELSE 'differing' END AS fault, n FROM h WHERE n > 1 UNION ALL SELECT name, day, 'missing', 0 FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.name = c.name AND h.day = c.day)""",
    "name day fault n",
)


def _summaries(v):
    """Summaries of each year and, as references, of the year before."""
    t = v.trades.withColumn("reason", F.when(F.col("side") == "A", "TARGET").when(F.col("side") == "R", "STOP").otherwise("TIME"))
    one = M.trade_summary(t, ["fold"], "reason", "gross_bps", "date")
    return M.summary_deltas(one, one.withColumn("fold", F.col("fold") + 1), ["fold"], {"trades": 0.01, "net": 0.05, "exit_": 0.02})


_PARTS = [
    ("'trades'", "CAST(count(*) AS DOUBLE)", "trades"), ("'net'", "sum(gross_bps)", "trades"), ("'daily_sharpe'", "CASE WHEN count(*) >= 2 AND stddev_samp(s) > 0 THEN avg(s) / stddev_samp(s) * sqrt(252) ELSE 0 END", "(SELECT fold, date, sum(gross_bps) AS s FROM trades GROUP BY 1, 2)"),
    ("CASE side WHEN 'A' THEN 'exit_TARGET' WHEN 'R' THEN 'exit_STOP' ELSE 'exit_TIME' END", "CAST(count(*) AS DOUBLE)", "trades"),
]
_SUMMARIES = "w AS (" + " UNION ALL ".join(f"SELECT fold, {m} AS metric, {e} AS value FROM {t} GROUP BY ALL" for m, e, t in _PARTS) + ")"
reg(
    "d46_year_deltas", _summaries,
    f"""WITH {_SUMMARIES}, j AS (SELECT fold, metric, coalesce(a.value, 0) AS actual, coalesce(b.value, 0) AS reference FROM w a FULL JOIN (SELECT fold + 1 AS fold, metric, value FROM w) b USING (fold, metric))
    SELECT fold, metric, actual, reference, actual - reference AS delta, relative, abs(relative) <= CASE WHEN metric = 'net' THEN 0.05 WHEN metric = 'trades' THEN 0.01 WHEN starts_with(metric, 'exit_') THEN 0.02 END AS passed
    FROM (SELECT *, CASE WHEN reference <> 0 THEN (actual - reference) / reference WHEN actual = 0 THEN 0 ELSE CAST('inf' AS DOUBLE) END AS relative FROM j)""",
    "fold metric passed", "actual reference delta relative",
)


def _regimes(v):
    return v.minutes.withColumn("regime", F.when(F.col("volume") % 3 == 0, "compression").when(F.col("volume") % 3 == 1, "trend"))


_ELIGIBLE = "SELECT symbol, bar_ts, CASE volume % 3 WHEN 0 THEN 'compression' WHEN 1 THEN 'trend' END AS regime FROM minutes"
reg(
    "b29_eligible_entries", lambda v: C.entry_eligible(_regimes(v)),
    f"SELECT symbol, bar_ts FROM ({_ELIGIBLE}) WHERE strftime(bar_ts, '%H:%M') >= '09:45' AND strftime(bar_ts, '%H:%M') < '14:55' AND NOT hour(bar_ts) = 11 AND coalesce(regime, '') <> 'compression'", "symbol bar_ts",
)
reg("b38_regime_gate", lambda v: C.regime_gate(_regimes(v), F.col("regime"), ["trend"]), f"SELECT symbol, bar_ts FROM ({_ELIGIBLE}) WHERE regime = 'trend'", "symbol bar_ts")


def _dated(v):
    d = F.to_date("bar_ts")
    return v.minutes.select(d.alias("trade_date"), "bar_ts", F.concat("symbol", F.when((F.dayofmonth(d) % 3 != 0) & (F.col("volume") % 2 == 0), "-I").otherwise("-II")).alias("symbol"), F.col("symbol").alias("own"))


reg(
    "b38_front_month", lambda v: C.front_month(_dated(v), ["trade_date", "own"]),
    "SELECT trade_date, bar_ts, symbol, own FROM (SELECT *, max(CAST(front AS INTEGER)) OVER (PARTITION BY trade_date, own) AS any_front FROM (SELECT CAST(bar_ts AS DATE) AS trade_date, bar_ts, symbol || CASE WHEN day(bar_ts) % 3 <> 0 AND volume % 2 = 0 THEN '-I' ELSE '-II' END AS symbol, symbol AS own, day(bar_ts) % 3 <> 0 AND volume % 2 = 0 AS front FROM minutes)) WHERE front OR any_front = 0",
    "trade_date bar_ts symbol own",
)


def _fill(v):
    m = v.minutes.withColumn("trade_date", F.to_date("bar_ts"))
    archive = m.where(F.dayofmonth("trade_date") % 3 == 0)
    return T.fill_archive(m, archive, ["symbol", "trade_date"], J.reconcile(m, archive, ["symbol", "bar_ts"], "close", 1e-4), ["close"])


reg("a20_gated_fill", _fill, "SELECT symbol, bar_ts, round(close, 2) AS close FROM minutes WHERE day(bar_ts) % 3 <> 0 AND strftime(bar_ts, '%H:%M') BETWEEN '09:15' AND '15:29'", "symbol bar_ts", "close")
