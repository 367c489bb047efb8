"""Queries of the point-in-time joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import asof as J
from saltmarsh.plans.views import reg

_MEM = "(SELECT o_custkey AS cust, CAST(min(o_orderdate) AS DATE) AS effective_from, CASE WHEN max(o_orderdate) >= DATE '1998-01-01' THEN NULL ELSE CAST(max(o_orderdate) AS DATE) END AS effective_to FROM orders GROUP BY 1)"
_ORD = "(SELECT o_orderkey, o_custkey AS cust, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders)"


def orders(v):
    return v.table("orders").select("o_orderkey", F.col("o_custkey").alias("cust"), F.to_date("o_orderdate").alias("day"), "o_totalprice")


def membership(v):
    o = orders(v).groupBy("cust").agg(F.min("day").alias("effective_from"), F.max("day").alias("last"))
    return o.select("cust", "effective_from", F.when(F.col("last") < F.lit("1998-01-01").cast("date"), F.col("last")).alias("effective_to"))


def ladder(v):
    i = v.table("lineitem").select(F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("expiry"), F.col("l_suppkey").alias("id"), F.col("l_quantity").cast("double").alias("oi"))
    return orders(v).select(F.col("o_orderkey").alias("key"), "day").join(i, "key")


_LAD = "(SELECT o.day, CAST(l_shipdate AS DATE) AS expiry, l_suppkey AS id, CAST(l_quantity AS DOUBLE) AS oi FROM lineitem JOIN " + _ORD + " o ON o.o_orderkey = l_orderkey)"

reg(
    "c01_active_members", lambda v: J.active_members(orders(v), membership(v), "cust", "day"),
    f"SELECT o.* FROM {_ORD} o WHERE EXISTS (SELECT 1 FROM {_MEM} m WHERE m.cust = o.cust AND o.day >= m.effective_from AND (m.effective_to IS NULL OR o.day < m.effective_to))",
    "o_orderkey cust day",
)
reg(
    "c02_membership_history", lambda v: membership(v).withColumn("is_open", F.col("effective_to").isNull()).withColumn("row_hash", F.sha2(F.concat_ws("|", "cust", "effective_from", "effective_to"), 256)),
    f"SELECT *, effective_to IS NULL AS is_open, sha256(concat_ws('|', cust, effective_from, effective_to)) AS row_hash FROM {_MEM}", "cust effective_from effective_to is_open row_hash",
)
reg(
    "c03_strict_as_of", lambda v: J.as_of(v.bars.groupBy("trade_date").agg(F.max("close").alias("top")).withColumn("k", F.lit(1)), v.bars.where("symbol LIKE 'p%'").groupBy("trade_date").agg(F.avg("close").alias("level")).withColumn("k", F.lit(1)), ["k"], "trade_date", "trade_date", "level", strict=True),
    "SELECT a.trade_date, top, (SELECT level FROM (SELECT trade_date, avg(close) AS level FROM bars WHERE symbol LIKE 'p%' GROUP BY 1) b WHERE b.trade_date < a.trade_date ORDER BY b.trade_date DESC LIMIT 1) AS asof_value FROM (SELECT trade_date, max(close) AS top FROM bars GROUP BY 1) a",
    "trade_date", "top asof_value",
)
reg(
    "c03_as_of_large", lambda v: J.as_of(v.bars, v.ticks, ["symbol"], "bar_ts", "ts", "price"),
    "SELECT b.symbol, b.bar_ts, t.price AS asof_value FROM bars b ASOF LEFT JOIN (SELECT symbol, ts, max(price) AS price FROM ticks GROUP BY 1, 2) t ON b.symbol = t.symbol AND b.bar_ts >= t.ts", "symbol bar_ts", "asof_value",
)
reg(
    "c04_previous_day_value", lambda v: J.previous_day_value(v.daily.where(F.day("date") % 5 != 0), v.daily.select("date"), "value"),
    "SELECT c.date, d.value AS prev_value FROM (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM daily) c LEFT JOIN (SELECT * FROM daily WHERE day(date) % 5 <> 0) d ON d.date = c.prev", "date", "prev_value",
)
reg(
    "c05_next_event", lambda v: J.next_event(orders(v).select("cust", "day"), orders(v).where(F.col("o_totalprice") > 200000).select("cust", F.col("day").alias("big")), "cust", "day", "big"),
    f"SELECT DISTINCT o.cust, o.day, (SELECT min(b.day) FROM {_ORD} b WHERE b.cust = o.cust AND b.o_totalprice > 200000 AND b.day >= o.day) AS next_event FROM {_ORD} o", "cust day next_event",
)
reg(
    "c06_trading_index_gap", lambda v: J.trading_index_gap(ladder(v).select("day", "expiry", "id").distinct(), v.daily.select("date"), "day", "expiry"),
    f"WITH c AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM daily) SELECT DISTINCT l.day, l.expiry, l.id, b.i - a.i + 1 AS days_left FROM {_LAD} l LEFT JOIN c a ON a.date = l.day LEFT JOIN c b ON b.date = l.expiry", "day expiry id days_left",
)


def _legs(v):
    b = v.bars
    two = sorted(("click", "purchase"))
    return b.where(F.col("symbol") == two[0]).withColumn("leg", F.lit(1)), b.where(F.col("symbol") == two[1]).withColumn("leg", F.lit(1))


_LEGS = "(SELECT *, 1 AS leg FROM bars WHERE symbol = '{}')"
reg(
    "c07_spot_basis", lambda v: J.spot_basis(*_legs(v), ["leg", "trade_date"], "bar_ts"),
    f"""SELECT *, CASE WHEN exact AND coalesce(lag(exact) OVER w, false) THEN basis_bps - lag(basis_bps) OVER w END AS basis_change FROM (SELECT *, NOT exact AND spot IS NOT NULL AS stale, CASE WHEN spot > 0 THEN (close / spot - 1) * 10000 END AS basis_bps FROM (
      SELECT f.*, s.close IS NOT NULL AS exact, last_value(s.close IGNORE NULLS) OVER (PARTITION BY f.leg, f.trade_date ORDER BY f.bar_ts ROWS UNBOUNDED PRECEDING) AS spot FROM {_LEGS.format('click')} f LEFT JOIN {_LEGS.format('purchase')} s ON s.bar_ts = f.bar_ts)) WINDOW w AS (PARTITION BY leg, trade_date ORDER BY bar_ts)""",
    "bar_ts exact stale", "spot basis_bps basis_change",
)
reg("c08_next_bar", lambda v: J.next_bar(v.bars, ["symbol", "trade_date"], "bar_ts"), "SELECT symbol, bar_ts, lead(bar_ts) OVER w AS entry_ts, lead(open) OVER w AS entry_open FROM bars WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY bar_ts)", "symbol bar_ts entry_ts", "entry_open")
reg(
    "c09_missing_days", lambda v: J.missing_days(v.bars.select("trade_date").distinct().crossJoin(v.bars.select("symbol", "slot").distinct()), v.bars, ["trade_date", "symbol", "slot"]),
    "SELECT trade_date, symbol, slot FROM (SELECT DISTINCT trade_date FROM bars), (SELECT DISTINCT symbol, slot FROM bars) EXCEPT SELECT trade_date, symbol, slot FROM bars", "trade_date symbol slot",
)
reg(
    "c10_backfill_targets", lambda v: J.missing_days(v.daily.withColumn("id", F.month("date").cast("long")), v.bars.select(F.col("trade_date").alias("date")), ["date"]).groupBy("id").agg(F.count("*").alias("n_days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")),
    "SELECT CAST(month(date) AS BIGINT) AS id, count(*) AS n_days, min(date) AS first_day, max(date) AS last_day FROM daily WHERE date NOT IN (SELECT trade_date FROM bars) GROUP BY 1", "id n_days first_day last_day",
)
reg(
    "c11_reconcile", lambda v: J.reconcile(v.bars.where("slot % 5 <> 0"), v.bars.where("slot % 7 <> 0").withColumn("close", F.when(F.col("slot") == 3, F.col("close") * 1.001).otherwise(F.col("close"))), ["symbol", "bar_ts"], "close", 0.0005),
    "SELECT *, coalesce(max_rel > 0.0005, false) AS drift FROM (SELECT count(*) FILTER (a.close IS NOT NULL AND b.c IS NOT NULL) AS matched, count(*) FILTER (b.c IS NULL) AS only_a, count(*) FILTER (a.close IS NULL) AS only_b, max(abs(a.close - b.c)) AS max_abs, max(abs((a.close - b.c) / b.c)) AS max_rel FROM (SELECT * FROM bars WHERE slot % 5 <> 0) a FULL JOIN (SELECT symbol, bar_ts, CASE WHEN slot = 3 THEN close * 1.001 ELSE close END AS c FROM bars WHERE slot % 7 <> 0) b ON a.symbol = b.symbol AND a.bar_ts = b.bar_ts)",
    "matched only_a only_b drift", "max_abs max_rel",
)
reg(
    "c12_table_parity", lambda v: J.table_parity(v.bars, v.bars.where("slot <> 5").withColumn("close", F.col("close") + F.when(F.col("slot") == 3, 1.0).otherwise(0.0)), ["symbol", "bar_ts"], ["open", "close", "volume"]),
    "SELECT feature, count(*) AS n, count(*) FILTER (bad) AS mismatches FROM (SELECT slot, unnest(['open', 'close', 'volume']) AS feature, unnest([slot = 5, slot IN (3, 5), slot = 5]) AS bad FROM bars) GROUP BY 1", "feature n mismatches",
)
reg(
    "c13_seam", lambda v: v.ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.max_by("price", F.struct("ts", "event_id")).alias("last_price")).join(v.bars.groupBy("symbol", F.col("trade_date").alias("day")).agg(F.max_by("close", "bar_ts").alias("eod")), ["symbol", "day"]).groupBy("symbol").agg(F.count_if(F.col("last_price") == F.col("eod")).alias("exact"), F.count("*").alias("n"), F.max(F.abs(F.col("last_price") - F.col("eod"))).alias("max_drift")),
    "SELECT symbol, count(*) FILTER (a.p = b.e) AS exact, count(*) AS n, max(abs(a.p - b.e)) AS max_drift FROM (SELECT symbol, CAST(ts AS DATE) AS day, last(price ORDER BY ts, event_id) AS p FROM ticks GROUP BY 1, 2) a JOIN (SELECT symbol, trade_date AS day, last(close ORDER BY bar_ts) AS e FROM bars GROUP BY 1, 2) b USING (symbol, day) GROUP BY 1",
    "symbol exact n", "max_drift",
)
reg(
    "c14_symbol_master", lambda v: v.table("customer").select(F.col("c_nationkey").alias("k")).union(v.table("supplier").select("s_nationkey")).distinct().join(v.table("nation").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey"), "k", "left").join(v.table("region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left").withColumn("quarantined", F.col("r_name").isNull()),
    "SELECT k, n_name, r_name, r_name IS NULL AS quarantined FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) LEFT JOIN nation ON n_nationkey = k LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3", "k n_name r_name quarantined",
)
reg(
    "c15_relative_strength", lambda v: J.relative_strength(v.bars, v.bars.where("symbol = 'click'"), "bar_ts", "close"),
    "SELECT b.symbol, b.bar_ts, b.close - coalesce(k.close, 0.0) AS relative FROM bars b LEFT JOIN (SELECT * FROM bars WHERE symbol = 'click') k ON k.bar_ts = b.bar_ts", "symbol bar_ts", "relative",
)
reg(
    "c17_precedence", lambda v: J.precedence(v.bars.where("slot < 12").select("trade_date", "symbol", "slot", F.lit("new").alias("src")), v.bars.select("trade_date", "symbol", "slot", F.lit("legacy").alias("src")), ["trade_date", "symbol"]),
    "SELECT trade_date, symbol, slot, 'new' AS src FROM bars WHERE slot < 12 UNION ALL SELECT trade_date, symbol, slot, 'legacy' FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars n WHERE n.slot < 12 AND n.trade_date = b.trade_date AND n.symbol = b.symbol)", "trade_date symbol slot src",
)
reg(
    "c18_nearest_contract", lambda v: J.nearest_contract(v.bars, "close", {"front": "open", "next": "high", "third": "low"}),
    "SELECT symbol, bar_ts, CASE WHEN abs(close - open) <= abs(close - high) AND abs(close - open) <= abs(close - low) THEN 'front' WHEN abs(close - high) <= abs(close - low) THEN 'next' ELSE 'third' END AS nearest, least(abs(close - open), abs(close - high), abs(close - low)) AS gap FROM bars", "symbol bar_ts nearest", "gap",
)
reg(
    "c21_expiry_check", lambda v: J.monthly_expiries(v.daily, "date", 3).withColumn("match", F.col("expiry") == F.col("target")),
    "SELECT *, expiry = target AS match FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS month, target, max(date) AS expiry FROM (SELECT date, CAST(last_day(date) - CAST(((dayofweek(last_day(date)) + 6) % 7 - 3 + 7) % 7 AS INTEGER) AS DATE) AS target FROM daily) WHERE date <= target GROUP BY 1, 2)", "month target expiry match",
)
reg(
    "c24_live_parity", lambda v: J.explode_parity(v.bars.select(F.concat_ws("/", "symbol", "bar_ts").alias("k"), "slot", "open", "close"), v.bars.select(F.concat_ws("/", "symbol", "bar_ts").alias("k"), "slot", "open", (F.col("close") + F.when(F.col("slot") == 1, 1e-8).when(F.col("slot") == 2, 1e-3).otherwise(0.0)).alias("close")), "k", ["open", "close"]).withColumn("symbol", F.split("k", "/")[0]).groupBy("symbol", "verdict").agg(F.count("*").alias("n")),
    "SELECT symbol, CASE WHEN slot = 2 THEN 'FAIL' WHEN slot = 1 THEN 'DEGRADED' ELSE 'PASS' END AS verdict, count(*) AS n FROM bars GROUP BY 1, 2", "symbol verdict n",
)
reg(
    "b19_latest_known", lambda v: J.latest_known(v.ticks, v.bars, "symbol", "ts", "bar_ts"),
    "SELECT b.symbol, b.bar_ts, (SELECT count(*) FROM ticks t WHERE t.symbol = b.symbol AND t.ts <= b.bar_ts) AS known, (SELECT max(ts) FROM ticks t WHERE t.symbol = b.symbol AND t.ts <= b.bar_ts) AS latest FROM bars b", "symbol bar_ts known latest",
)
reg(
    "d32_two_nearest", lambda v: J.two_nearest(ladder(v), "day", "expiry", "id"),
    f"SELECT day, max(expiry) FILTER (r = 1) AS front_expiry, max(i) FILTER (r = 1) AS front_id, max(expiry) FILTER (r = 2) AS next_expiry, max(i) FILTER (r = 2) AS next_id FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY expiry) AS r FROM (SELECT day, expiry, min(id) AS i FROM {_LAD} WHERE expiry >= day GROUP BY 1, 2)) WHERE r <= 2 GROUP BY 1",
    "day front_expiry front_id next_expiry next_id",
)
reg("d33_expiry_table", lambda v: J.expiry_table(ladder(v), "day", "expiry", "id"), f"SELECT expiry, min(day) AS first_day, max(day) AS last_day, count(DISTINCT id) AS n_ids, count(*) AS n, CAST((dayofweek(expiry) + 6) % 7 AS BIGINT) AS weekday FROM {_LAD} GROUP BY 1", "expiry first_day last_day n_ids n weekday")
reg("d34_duplicate_keys", lambda v: J.duplicate_keys(ladder(v), ["day", "id"]), f"SELECT day, id, count(*) AS n FROM {_LAD} GROUP BY 1, 2 HAVING count(*) > 1", "day id n")
reg("d35_monthly_expiries", lambda v: J.monthly_expiries(v.daily.where(F.weekday("date") < 5), "date", 1), "SELECT CAST(date_trunc('month', date) AS DATE) AS month, target, max(date) AS expiry FROM (SELECT date, CAST(last_day(date) - CAST(((dayofweek(last_day(date)) + 6) % 7 - 1 + 7) % 7 AS INTEGER) AS DATE) AS target FROM daily WHERE (dayofweek(date) + 6) % 7 < 5) WHERE date <= target GROUP BY 1, 2", "month target expiry")
