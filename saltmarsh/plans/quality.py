"""Queries of normalisers, quality checks and costs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltmarsh.functions import costs as K
from saltmarsh.functions import normalise as N
from saltmarsh.operators import asof as J
from saltmarsh.operators import checks as Q
from saltmarsh.operators import features as E
from saltmarsh.plans.views import reg


def dirty(v):
    """Ticks with defects by event_id: bad prices, off-session times, repeated keys, negative volume."""
    t = v.ticks.withColumn("minute", (F.hour("ts") * 60 + F.minute("ts")).cast("long"))
    return t.withColumn("close", F.col("price")).withColumn("open", F.when(F.col("event_id") % 17 == 0, -1.0).otherwise(F.col("price"))).withColumn("high", F.col("price") + 1).withColumn("low", F.col("price") - 1).withColumn("volume", F.when(F.col("event_id") % 23 == 0, -1).otherwise(F.col("size"))).withColumn("bucket", F.date_trunc("hour", "ts").cast("timestamp_ntz"))


_DIRTY = "(SELECT *, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS minute, price AS close, CASE WHEN event_id % 17 = 0 THEN -1.0 ELSE price END AS open, price + 1 AS high, price - 1 AS low, CASE WHEN event_id % 23 = 0 THEN -1 ELSE size END AS volume, date_trunc('hour', ts) AS bucket FROM ticks)"
_OK = "(least(open, high, low, close) > 0 AND low <= least(open, close) AND greatest(open, close) <= high)"


def _rejects():
    return {"symbol_mismatch": F.col("symbol") == "view", "off_session": ~F.col("minute").between(60, 1380), "invalid_ohlc": ~N.valid_ohlc(), "negative_volume": F.col("volume") < 0}


def routed(v):
    return N.route(dirty(v), _rejects(), ["symbol", "bucket"], "event_id")


_FIRST = f"CASE WHEN symbol = 'view' THEN 'symbol_mismatch' WHEN NOT minute BETWEEN 60 AND 1380 THEN 'off_session' WHEN NOT {_OK} THEN 'invalid_ohlc' WHEN volume < 0 THEN 'negative_volume' END"
_ROUTED = f"(SELECT * EXCLUDE (r), CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY symbol, bucket, r IS NULL ORDER BY event_id) > 1 THEN 'duplicate_timestamp' ELSE r END AS reject_reason FROM (SELECT *, {_FIRST} AS r FROM {_DIRTY}))"
reg("b03_valid_ohlc", lambda v: dirty(v).withColumn("ok", N.valid_ohlc()), f"SELECT event_id, {_OK} AS ok FROM {_DIRTY}", "event_id ok")
reg("b02_in_session", lambda v: dirty(v).where(N.in_session(F.col("minute"), F.floor(F.second("ts")), 555, 929)), f"SELECT event_id, minute FROM {_DIRTY} WHERE minute BETWEEN 555 AND 929 AND floor(second(ts)) = 0", "event_id minute")
reg("b04_reject_router", routed, f"SELECT event_id, symbol, bucket, reject_reason FROM {_ROUTED}", "event_id symbol bucket reject_reason")
_OUTLIERS = f"""r AS (SELECT * FROM {_ROUTED}), a AS (SELECT event_id, symbol, close / lag(close) OVER (PARTITION BY symbol, CAST(bucket AS DATE) ORDER BY bucket, event_id) - 1 AS ret FROM r WHERE reject_reason IS NULL),
d AS (SELECT event_id, a.symbol, n, abs(ret - med) AS dev FROM a JOIN (SELECT symbol, quantile_cont(ret, 0.5) AS med, count(ret) AS n FROM a GROUP BY 1) m ON m.symbol = a.symbol), k AS (SELECT symbol, quantile_cont(dev, 0.5) AS mad FROM d GROUP BY 1),
o AS (SELECT event_id FROM d JOIN k ON k.symbol = d.symbol WHERE n >= 5 AND CASE WHEN mad = 0 THEN dev > 0.05 ELSE dev / (1.4826 * mad) > 8 END)"""
reg(
    "b04_router_with_outliers", lambda v: Q.reject_router(dirty(v), _rejects(), ["symbol"], ["symbol", "bucket"], "bucket", "event_id", "close"),
    f"WITH {_OUTLIERS} SELECT event_id, symbol, bucket, CASE WHEN event_id IN (SELECT event_id FROM o) THEN 'outlier_return' ELSE reject_reason END AS reject_reason FROM r", "event_id symbol bucket reject_reason",
)
reg("e43_silver", lambda v: routed(v).where("reject_reason IS NULL"), f"SELECT event_id, symbol, bucket, close FROM {_ROUTED} WHERE reject_reason IS NULL", "event_id symbol bucket", "close")
reg("d40_reject_counts", lambda v: routed(v).groupBy("symbol", F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")), f"SELECT symbol, coalesce(reject_reason, 'kept') AS reason, count(*) AS n FROM {_ROUTED} GROUP BY 1, 2", "symbol reason n")
reg(
    "b01_canonical_row", lambda v: v.table("events").select("event_id", F.upper(F.trim(F.concat(F.lit(" "), "event_type"))).alias("symbol"), N.number(F.col("value").cast("string")).alias("price"), N.parse_time(F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).alias("at_ts")),
    "SELECT event_id, upper(event_type) AS symbol, value AS price, date_trunc('second', ts) AS at_ts FROM events", "event_id symbol at_ts", "price",
)
reg("b05_comma_numbers", lambda v: v.table("orders").select("o_orderkey", N.number(F.format_number("o_totalprice", 2)).alias("price")), "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders", "o_orderkey", "price")
reg("b06_token", lambda v: v.table("customer").select("c_custkey", N.token(F.col("c_name")).alias("token")), "SELECT c_custkey, CAST(('0x' || substr(sha256(c_name), 1, 12)) AS BIGINT) AS token FROM customer", "c_custkey token")
reg("b07_spot_defaults", lambda v: v.bars.select("symbol", "bar_ts", F.coalesce(F.when(F.col("slot") % 3 != 0, F.col("volume")), F.lit(0)).alias("volume"), F.lit(True).alias("context_only")), "SELECT symbol, bar_ts, CASE WHEN slot % 3 <> 0 THEN volume ELSE 0 END AS volume, true AS context_only FROM bars", "symbol bar_ts volume context_only")
reg("b08_parse_time", lambda v: v.table("lineitem").select("l_orderkey", "l_linenumber", N.parse_time(F.concat(F.date_format("l_shipdate", "dd-MM-yyyy"), F.lit(" 09:15"))).alias("at_ts")), "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) + INTERVAL '9 hours 15 minutes' AS at_ts FROM lineitem", "l_orderkey l_linenumber at_ts")
_SYM = "upper(regexp_replace(concat(n_name, CASE WHEN n_nationkey % 3 = 0 THEN '-I' WHEN n_nationkey % 3 = 1 THEN ' FUT' ELSE '' END), ' ', '', 'g'))"
reg(
    "b09_symbol_kinds", lambda v: v.table("nation").withColumn("s", F.upper(F.regexp_replace(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, "-I").when(F.col("n_nationkey") % 3 == 1, " FUT").otherwise("")), " ", ""))).select("n_nationkey", "s", F.col("s").rlike("^[A-Z0-9_]+-(I|II|III)$").alias("continuous"), F.col("s").contains("FUT").alias("futures")),
    f"SELECT n_nationkey, s, regexp_matches(s, '^[A-Z0-9_]+-(I|II|III)$') AS continuous, contains(s, 'FUT') AS futures FROM (SELECT *, {_SYM} AS s FROM nation)", "n_nationkey s continuous futures",
)


def _tests():
    return {"no_volume": F.col("volume") == 0, "flat": F.col("high") == F.col("low"), "thin": F.col("n_ticks") < 2}


reg(
    "b10_feed_failures", lambda v: v.bars.withColumn("failed", F.array_join(N.reasons(_tests()), ",")).groupBy("symbol", "failed").agg(F.count("*").alias("n"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_share")),
    "SELECT symbol, concat_ws(',', CASE WHEN volume = 0 THEN 'no_volume' END, CASE WHEN high = low THEN 'flat' END, CASE WHEN n_ticks < 2 THEN 'thin' END) AS failed, count(*) AS n, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) AS zero_share FROM bars GROUP BY 1, 2", "symbol failed n", "zero_share",
)
reg(
    "b11_row_errors", lambda v: v.bars.select("symbol", "bar_ts", F.posexplode(N.reasons(_tests())).alias("pos", "error")),
    "SELECT symbol, bar_ts, CAST(unnest(range(len(e))) AS BIGINT) AS pos, unnest(e) AS error FROM (SELECT *, list_filter([CASE WHEN volume = 0 THEN 'no_volume' END, CASE WHEN high = low THEN 'flat' END, CASE WHEN n_ticks < 2 THEN 'thin' END], lambda x: x IS NOT NULL) AS e FROM bars)", "symbol bar_ts pos error",
)
_OPT = "concat('NIFTY', day(o_orderdate), 'JAN', 24, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'CE' ELSE 'PE' END)"
reg(
    "b12_option_symbols", lambda v: v.table("orders").select("o_orderkey", F.concat(F.lit("NIFTY"), F.lpad(F.day("o_orderdate").cast("string"), 2, "0"), F.lit("JAN24"), "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, "CE").otherwise("PE")).alias("s")).select(
        "o_orderkey", F.regexp_extract("s", r"^(NIFTY|BANKNIFTY)(\d{2})([A-Z]{3})(\d{2})(\d+)(CE|PE)$", 1).alias("root"), F.regexp_extract("s", r"^(NIFTY|BANKNIFTY)(\d{2})([A-Z]{3})(\d{2})(\d+)(CE|PE)$", 5).cast("long").alias("strike"), F.regexp_extract("s", r"^(NIFTY|BANKNIFTY)(\d{2})([A-Z]{3})(\d{2})(\d+)(CE|PE)$", 6).alias("kind")),
    "SELECT o_orderkey, 'NIFTY' AS root, o_custkey AS strike, CASE WHEN o_orderkey % 2 = 0 THEN 'CE' ELSE 'PE' END AS kind FROM orders", "o_orderkey root strike kind",
)
reg("b13_symbol_from_name", lambda v: v.bars.select("symbol", "bar_ts", F.regexp_extract(F.concat(F.upper("symbol"), F.lit("_minute.csv")), r"^(.+?)(_minute)?\.csv$", 1).alias("name")), "SELECT symbol, bar_ts, upper(symbol) AS name FROM bars", "symbol bar_ts name")
_ROLE = [("license", "licen[cs]ed"), ("secret", "password|token"), ("contact", "@|\\+1 ")]
reg(
    "b14_roles", lambda v: v.table("documents").select("doc_id", N.keyword_class(F.col("text"), _ROLE, "other").alias("role")),
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[cs]ed') THEN 'license' WHEN regexp_matches(lower(text), 'password|token') THEN 'secret' WHEN regexp_matches(lower(text), '@|\\+1 ') THEN 'contact' ELSE 'other' END AS role FROM documents", "doc_id role",
)
reg(
    "b15_time_quality", lambda v: v.ticks.groupBy("symbol").agg(F.count_if(F.date_format("ts", "HH:mm:ss") == "00:00:00").alias("date_only"), F.bool_and(F.date_format("ts", "HH:mm").isin("07:00", "08:00")).alias("fixed_time"), F.count("*").alias("n")).withColumn("quality", F.when(F.col("date_only") == F.col("n"), "date_only").when(F.col("fixed_time"), "fixed_time_suspect").otherwise("intraday_no_timezone")),
    "SELECT symbol, date_only, fixed_time, n, CASE WHEN date_only = n THEN 'date_only' WHEN fixed_time THEN 'fixed_time_suspect' ELSE 'intraday_no_timezone' END AS quality FROM (SELECT symbol, count(*) FILTER (strftime(ts, '%H:%M:%S') = '00:00:00') AS date_only, bool_and(strftime(ts, '%H:%M') IN ('07:00', '08:00')) AS fixed_time, count(*) AS n FROM ticks GROUP BY 1)", "symbol date_only fixed_time n quality",
)
reg(
    "b16_sector_cascade", lambda v: v.table("supplier").join(v.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.when(F.col("s_name").rlike("[05]$"), "round"), F.lit("default")).alias("sector")),
    "SELECT s_suppkey, coalesce(n_name, CASE WHEN regexp_matches(s_name, '[05]$') THEN 'round' END, 'default') AS sector FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON n_nationkey = s_nationkey", "s_suppkey sector",
)
reg("b17_event_type", lambda v: v.table("documents").groupBy("source", N.keyword_class(F.col("text"), _ROLE[:2], "other").alias("kind")).agg(F.count("*").alias("n")), "SELECT source, CASE WHEN regexp_matches(lower(text), 'licen[cs]ed') THEN 'license' WHEN regexp_matches(lower(text), 'password|token') THEN 'secret' ELSE 'other' END AS kind, count(*) AS n FROM documents GROUP BY 1, 2", "source kind n")
reg(
    "b18_announcements", lambda v: v.table("conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b")).select("conv_id", F.concat_ws(" - ", "a", "b").alias("headline")),
    "SELECT conv_id, concat_ws(' - ', first(text ORDER BY turn), last(text ORDER BY turn)) AS headline FROM conversations GROUP BY 1", "conv_id headline",
)
reg(
    "b20_flow_pivot", lambda v: v.trades.groupBy("date").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("gross_bps"))), F.lit(0.0)).alias(f"net_{s}") for s in "AR"]).withColumn("net_total", F.col("net_A") + F.col("net_R")).withColumn("usable_from", F.date_add("date", 1)),
    "SELECT date, net_A, net_R, net_A + net_R AS net_total, CAST(date + INTERVAL 1 DAY AS DATE) AS usable_from FROM (SELECT date, coalesce(sum(gross_bps) FILTER (side = 'A'), 0) AS net_A, coalesce(sum(gross_bps) FILTER (side = 'R'), 0) AS net_R FROM trades GROUP BY 1)", "date usable_from", "net_A net_R net_total",
)
reg("b21_availability", lambda v: v.daily.select("date", (F.col("date").cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("available_at"), F.date_add("date", 1).alias("usable_from")), "SELECT date, CAST(date AS TIMESTAMP) + INTERVAL 18 HOURS AS available_at, CAST(date + INTERVAL 1 DAY AS DATE) AS usable_from FROM daily", "date available_at usable_from")
reg("b22_registry", lambda v: v.ticks.groupBy("symbol", "oi_step").agg(F.max_by(F.when(F.col("size") > 50, "promoted").otherwise("quarantined"), F.struct("ts", "event_id")).alias("status")), "SELECT symbol, oi_step, last(CASE WHEN size > 50 THEN 'promoted' ELSE 'quarantined' END ORDER BY ts, event_id) AS status FROM ticks GROUP BY 1, 2", "symbol oi_step status")
reg("b23_calendar", lambda v: v.daily.select("date", F.weekday("date").cast("long").alias("weekday"), F.month("date").cast("long").alias("month")), "SELECT date, CAST((dayofweek(date) + 6) % 7 AS BIGINT) AS weekday, CAST(month(date) AS BIGINT) AS month FROM daily", "date weekday month")
reg("b24_sign_regimes", lambda v: v.bars.select("symbol", "bar_ts", F.when(F.col("close") > F.col("open"), "up").when(F.col("close") < F.col("open"), "down").otherwise("flat").alias("trend")), "SELECT symbol, bar_ts, CASE WHEN close > open THEN 'up' WHEN close < open THEN 'down' ELSE 'flat' END AS trend FROM bars", "symbol bar_ts trend")
_CAP = [(8000.0, "mega"), (5000.0, "large"), (2000.0, "mid"), (0.0, "small")]
reg("b25_trait_buckets", lambda v: v.table("customer").select("c_custkey", N.ladder(F.col("c_acctbal"), _CAP, "micro", "unknown").alias("cap")), "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN 'unknown' WHEN c_acctbal >= 8000 THEN 'mega' WHEN c_acctbal >= 5000 THEN 'large' WHEN c_acctbal >= 2000 THEN 'mid' WHEN c_acctbal >= 0 THEN 'small' ELSE 'micro' END AS cap FROM customer", "c_custkey cap")
reg(
    "b26_trait_matrix", lambda v: v.table("customer").select("c_custkey", *[(F.col("c_mktsegment") == s).cast("long").alias(f"is_{s.lower()}") for s in ("AUTOMOBILE", "BUILDING", "MACHINERY")], "c_acctbal"),
    "SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS BIGINT) AS is_automobile, CAST(c_mktsegment = 'BUILDING' AS BIGINT) AS is_building, CAST(c_mktsegment = 'MACHINERY' AS BIGINT) AS is_machinery, c_acctbal FROM customer", "c_custkey is_automobile is_building is_machinery", "c_acctbal",
)
reg("b28_temporal_split", lambda v: v.trades.where("fold < 1998").groupBy(F.when(F.col("fold") < 1995, "train").when(F.col("fold") < 1997, "validation").otherwise("test").alias("split")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")), "SELECT CASE WHEN fold < 1995 THEN 'train' WHEN fold < 1997 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, min(date) AS first, max(date) AS last FROM trades WHERE fold < 1998 GROUP BY 1", "split n first last")
reg("b29_entry_eligible", lambda v: v.bars.where((F.col("slot") >= 2) & (F.col("slot") < 20) & ~F.col("slot").between(11, 12)), "SELECT * FROM bars WHERE slot >= 2 AND slot < 20 AND NOT slot BETWEEN 11 AND 12", "symbol bar_ts slot")
reg("b31_expected_edge", lambda v: v.scores.select("event_id", (F.col("p") * 40 - (1 - F.col("p")) * 30).alias("long_edge"), ((1 - F.col("p")) * 40 - F.col("p") * 30).alias("short_edge")), "SELECT event_id, p * 40 - (1 - p) * 30 AS long_edge, (1 - p) * 40 - p * 30 AS short_edge FROM scores", "event_id", "long_edge short_edge")
_ACT = "CASE WHEN p >= 0.55 AND p * 40 - (1 - p) * 30 > 0 AND p * 40 - (1 - p) * 30 >= (1 - p) * 40 - p * 30 THEN 'LONG' WHEN 1 - p >= 0.55 AND (1 - p) * 40 - p * 30 > 0 AND (1 - p) * 40 - p * 30 > p * 40 - (1 - p) * 30 THEN 'SHORT' ELSE 'NO_TRADE' END"


def _action(v):
    p = F.col("p")
    long, short = p * 40 - (1 - p) * 30, (1 - p) * 40 - p * 30
    side = F.when((p >= 0.55) & (long > 0) & (long >= short), "LONG").when((1 - p >= 0.55) & (short > 0) & (short > long), "SHORT").otherwise("NO_TRADE")
    return v.scores.withColumn("action", side)


reg("b32_choose_action", _action, f"SELECT event_id, {_ACT} AS action FROM scores", "event_id action")
reg("b33_confidence", lambda v: v.scores.select("event_id", F.when(F.col("p") >= 0.5, "LONG").otherwise("SHORT").alias("side"), (2 * F.abs(F.col("p") - 0.5)).alias("confidence"), (2 * F.abs(F.col("p") - 0.5) >= 0.3).alias("execute")), "SELECT event_id, CASE WHEN p >= 0.5 THEN 'LONG' ELSE 'SHORT' END AS side, 2 * abs(p - 0.5) AS confidence, 2 * abs(p - 0.5) >= 0.3 AS execute FROM scores", "event_id side execute", "confidence")
reg("b35_order_limits", lambda v: v.table("lineitem").select("l_orderkey", "l_linenumber", F.array_join(N.reasons({"quantity": F.col("l_quantity") > 40, "discount": F.col("l_discount") > 0.08, "tax": F.col("l_tax") > 0.07}), ",").alias("reasons")), "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 40 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.07 THEN 'tax' END) AS reasons FROM lineitem", "l_orderkey l_linenumber reasons")
reg("b38_front_filter", lambda v: v.bars.withColumn("front", F.col("symbol").endswith("k")).withColumn("any_front", F.max("front").over(Window.partitionBy("trade_date"))).where(F.col("front") | ~F.col("any_front")), "SELECT symbol, bar_ts FROM (SELECT *, suffix(symbol, 'k') AS front, max(suffix(symbol, 'k')) OVER (PARTITION BY trade_date) AS af FROM bars) WHERE front OR NOT af", "symbol bar_ts")
reg("b40_outcome_class", lambda v: v.trades.select("order_key", "line", F.when(F.col("gross_bps") - 3.5 > 0, "LONG").when(-F.col("gross_bps") - 3.5 > 0, "SHORT").otherwise("NO_TRADE").alias("actual")), "SELECT order_key, line, CASE WHEN gross_bps - 3.5 > 0 THEN 'LONG' WHEN -gross_bps - 3.5 > 0 THEN 'SHORT' ELSE 'NO_TRADE' END AS actual FROM trades", "order_key line actual")
reg("b41_time_keys", lambda v: v.ticks.select("event_id", F.to_date("ts").alias("date"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute"), F.upper("symbol").alias("symbol")), "SELECT event_id, CAST(ts AS DATE) AS date, date_trunc('minute', ts) AS minute, upper(symbol) AS symbol FROM ticks", "event_id date minute symbol")
reg("d03_liquid_universe", lambda v: v.bars.groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("traded"), F.count_distinct("trade_date").alias("days")).withColumn("coverage", F.col("days") / F.max("days").over(Window.partitionBy())).where("coverage >= 0.9").withColumn("rank", F.row_number().over(Window.orderBy(F.col("traded").desc(), "symbol")).cast("long")).where("rank <= 3"), "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY traded DESC, symbol) AS rank FROM (SELECT symbol, sum(close * volume) AS traded, count(DISTINCT trade_date) AS days, count(DISTINCT trade_date) / max(count(DISTINCT trade_date)) OVER () AS coverage FROM bars GROUP BY 1) WHERE coverage >= 0.9) WHERE rank <= 3", "symbol days rank", "traded coverage")
reg("d04_price_floor", lambda v: v.bars.groupBy("symbol").agg(F.avg("close").alias("mean_close")).withColumn("kept", F.col("mean_close") >= 50), "SELECT symbol, avg(close) AS mean_close, avg(close) >= 50 AS kept FROM bars GROUP BY 1", "symbol kept", "mean_close")
reg("d22_zero_volume_and_gaps", lambda v: v.bars.groupBy("symbol", "trade_date").agg(F.count_if(F.col("volume") == 0).alias("zero_volume"), (F.max("slot") - F.min("slot") + 1 - F.count("*")).alias("missing"), F.max("bar_ts").alias("freshest")), "SELECT symbol, trade_date, count(*) FILTER (volume = 0) AS zero_volume, max(slot) - min(slot) + 1 - count(*) AS missing, max(bar_ts) AS freshest FROM bars GROUP BY 1, 2", "symbol trade_date zero_volume missing freshest")
reg("d23_minute_summary", lambda v: v.bars.agg(F.count("*").alias("n"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"), F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume_share"), F.count_if(~F.col("slot").between(9, 15)).alias("off_session"), F.count_distinct("symbol").alias("symbols")), "SELECT count(*) AS n, min(bar_ts) AS first_ts, max(bar_ts) AS last_ts, avg(CASE WHEN volume = 0 THEN 1.0 ELSE 0.0 END) AS zero_volume_share, count(*) FILTER (NOT slot BETWEEN 9 AND 15) AS off_session, count(DISTINCT symbol) AS symbols FROM bars", "n first_ts last_ts off_session symbols", "zero_volume_share")
reg("d25_day_validation", lambda v: v.bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("n"), F.try_divide(F.sum(F.when((F.col("slot") >= 20) & (F.col("volume") > 0), F.col("close") * F.col("volume"))), F.sum(F.when((F.col("slot") >= 20) & (F.col("volume") > 0), F.col("volume")))).alias("late_vwap"), F.max_by(F.when(F.col("oi") != 0, F.col("oi")), F.when(F.col("oi") != 0, F.col("bar_ts"))).alias("last_oi")).withColumn("ok", F.col("n").between(15, 24)), "SELECT symbol, trade_date, count(*) AS n, sum(close * volume) FILTER (slot >= 20 AND volume > 0) / sum(volume) FILTER (slot >= 20 AND volume > 0) AS late_vwap, last(oi ORDER BY bar_ts) FILTER (oi <> 0) AS last_oi, count(*) BETWEEN 15 AND 24 AS ok FROM bars GROUP BY 1, 2", "symbol trade_date n last_oi ok", "late_vwap")
reg("d26_oi_regime", lambda v: v.bars.groupBy("symbol", "trade_date").agg(F.max_by("oi", "bar_ts").alias("o"), F.avg("oi").alias("expected")).withColumn("ratio", F.try_divide(F.col("expected"), F.col("o"))).withColumn("regime", F.when(F.col("ratio").isNull(), "unknown").when(F.col("ratio").between(0.5, 2), "one").when(F.col("ratio").between(50, 200), "x100").otherwise("ambiguous")), "SELECT symbol, trade_date, ratio, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio BETWEEN 0.5 AND 2 THEN 'one' WHEN ratio BETWEEN 50 AND 200 THEN 'x100' ELSE 'ambiguous' END AS regime FROM (SELECT symbol, trade_date, avg(oi) / nullif(last(oi ORDER BY bar_ts), 0) AS ratio FROM bars GROUP BY 1, 2)", "symbol trade_date regime", "ratio")
reg("d27_lot_inference", lambda v: v.trades.groupBy("config").agg(F.round(F.percentile("quantity", 0.5)).cast("long").alias("lot"), F.min("quantity").alias("low"), F.max("quantity").alias("high"), F.count("*").alias("n")), "SELECT config, CAST(round(quantile_cont(quantity, 0.5)) AS BIGINT) AS lot, min(quantity) AS low, max(quantity) AS high, count(*) AS n FROM trades GROUP BY 1", "config lot n", "low high")
reg("d28_vintages", lambda v: v.bars.groupBy("symbol", "trade_date").agg(F.count("*").alias("bars"), F.max("slot").alias("last")).groupBy("symbol", "bars", "last").agg(F.count("*").alias("n")), "SELECT symbol, bars, last, count(*) AS n FROM (SELECT symbol, trade_date, count(*) AS bars, max(slot) AS last FROM bars GROUP BY 1, 2) GROUP BY 1, 2, 3", "symbol bars last n")
reg("d29_cadence", lambda v: v.ticks.select("symbol", "ts").distinct().withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")), F.col("ts"))).groupBy("symbol").agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("median_gap"), F.percentile("gap", 0.95).alias("p95_gap"), F.max("gap").alias("max_gap")), "SELECT symbol, count(*) AS n, quantile_cont(gap, 0.5) AS median_gap, quantile_cont(gap, 0.95) AS p95_gap, max(gap) AS max_gap FROM (SELECT symbol, datesub('second', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS gap FROM (SELECT DISTINCT symbol, ts FROM ticks)) GROUP BY 1", "symbol n max_gap", "median_gap p95_gap")
reg("d30_surface", lambda v: v.ticks.join(v.ticks.groupBy("symbol").agg(F.percentile("size", 0.5).alias("mid")), "symbol").groupBy("symbol", F.hour("ts").cast("long").alias("hour")).agg(F.count_distinct(F.when(F.col("size") > F.col("mid"), F.col("size"))).alias("above"), F.count_distinct(F.when(F.col("size") < F.col("mid"), F.col("size"))).alias("below")).withColumn("valid", (F.col("above") >= 5) & (F.col("below") >= 5)), "SELECT symbol, CAST(hour(ts) AS BIGINT) AS hour, count(DISTINCT CASE WHEN size > mid THEN size END) AS above, count(DISTINCT CASE WHEN size < mid THEN size END) AS below, count(DISTINCT CASE WHEN size > mid THEN size END) >= 5 AND count(DISTINCT CASE WHEN size < mid THEN size END) >= 5 AS valid FROM ticks JOIN (SELECT symbol, quantile_cont(size, 0.5) AS mid FROM ticks GROUP BY 1) USING (symbol) GROUP BY 1, 2", "symbol hour above below valid")
reg("d31_breadth", lambda v: v.bars.groupBy("bar_ts").agg(F.count_distinct("symbol").alias("symbols"), F.count_if(F.col("close") > F.col("open")).alias("positive")).groupBy(F.to_date("bar_ts").alias("date")).agg(F.sum(F.least("symbols", F.lit(3))).alias("capacity"), F.sum("positive").alias("positive"), F.count("*").alias("n_bars")), "SELECT CAST(bar_ts AS DATE) AS date, CAST(sum(least(s, 3)) AS BIGINT) AS capacity, CAST(sum(p) AS BIGINT) AS positive, count(*) AS n_bars FROM (SELECT bar_ts, count(DISTINCT symbol) AS s, count(*) FILTER (close > open) AS p FROM bars GROUP BY 1) GROUP BY 1", "date capacity positive n_bars")
reg(
    "e44_gaps_and_stale", lambda v: N.runs_of_equal(v.bars.withColumn("up", (F.col("close") > F.col("open")).cast("long")), ["symbol"], "bar_ts", "up", 5),
    "SELECT symbol, count(*) AS n, min(bar_ts) AS from_ts, max(bar_ts) AS to_ts, any_value(up) AS up FROM (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN up = lag(up) OVER (PARTITION BY symbol ORDER BY bar_ts) THEN 0 ELSE 1 END AS new FROM (SELECT *, CAST(close > open AS BIGINT) AS up FROM bars))) GROUP BY symbol, run HAVING count(*) >= 5", "symbol n from_ts to_ts up",
)
reg(
    "e45_robust_outliers", lambda v: N.robust_outliers(v.bars, ["symbol"], "bar_ts", "close"),
    """SELECT symbol, bar_ts, coalesce(n_ret >= 5 AND CASE WHEN mad > 0 THEN dev / (1.4826 * mad) > 8 ELSE abs(ret) > 0.05 END, false) AS outlier FROM (SELECT d.*, mad FROM (SELECT r.*, med, n_ret, abs(ret - med) AS dev FROM (SELECT *, CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) r
      JOIN (SELECT symbol, quantile_cont(ret, 0.5) AS med, count(ret) AS n_ret FROM (SELECT symbol, CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) GROUP BY 1) USING (symbol)) d
      JOIN (SELECT symbol, quantile_cont(abs(ret - med), 0.5) AS mad FROM (SELECT symbol, ret, quantile_cont(ret, 0.5) OVER (PARTITION BY symbol) AS med FROM (SELECT symbol, CASE WHEN lag(close) OVER w <> 0 THEN close / lag(close) OVER w - 1 END AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))) GROUP BY 1) USING (symbol))""",
    "symbol bar_ts outlier",
)
_SIDE = "(least({n} * 0.0005, 20.0) + {n} * ({stt} + {stamp} + 0.0000322 + 0.000001 + {slip} / 10000.0) + (least({n} * 0.0005, 20.0) + {n} * 0.0000322) * 0.18)"
_SLIP = "CASE WHEN n % 3 = 0 THEN 3.0 WHEN n % 3 = 1 THEN 12.0 ELSE 8.0 END"
_PRODUCT = "CASE WHEN n % 2 = 0 THEN {} ELSE {} END"
reg(
    "i01_equity_cost", lambda v: v.table("orders").select("o_orderkey", K.equity_round_trip(F.col("o_totalprice"), F.col("o_totalprice") * 1.01, F.when(F.col("o_orderkey") % 2 == 0, "delivery").otherwise("intraday"), F.when(F.col("o_orderkey") % 3 == 0, "LARGE").when(F.col("o_orderkey") % 3 == 1, "small").otherwise("new")).alias("c")).select("o_orderkey", "c.total", "c.total_bps"),
    f"SELECT o_orderkey, b + s AS total, (b + s) / p * 10000 AS total_bps FROM (SELECT o_orderkey, p, {_SIDE.format(n='p', stt='0.0', stamp=_PRODUCT.format(0.00015, 0.00003), slip=_SLIP)} AS b, {_SIDE.format(n='q', stt=_PRODUCT.format(0.001, 0.00025), stamp='0.0', slip=_SLIP)} AS s FROM (SELECT o_orderkey, o_orderkey AS n, CAST(o_totalprice AS DOUBLE) AS p, CAST(o_totalprice AS DOUBLE) * 1.01 AS q FROM orders))",
    "o_orderkey", "total total_bps",
)
reg("i02_futures_cost", lambda v: v.table("orders").select("o_orderkey", K.futures_round_trip_bps(F.col("o_totalprice")).alias("bps")), "SELECT o_orderkey, ((40 + p * 0.346 / 10000) * 1.18 + p * 2.22 / 10000) / p * 10000 + 2 AS bps FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS p FROM orders)", "o_orderkey", "bps")
_ERA = "(VALUES " + ", ".join(f"(DATE '{d}', {lot}::BIGINT, {s}::DOUBLE, {t}::DOUBLE)" for d, lot, s, t in K.ERAS) + ") e(effective_date, lot_size, stt, txn)"


def shifted(v):
    return v.table("orders").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 10500).alias("day"), F.col("o_totalprice").cast("double").alias("p"))


_SH = "(SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 10500 AS DATE) AS day, CAST(o_totalprice AS DOUBLE) AS p FROM orders)"
reg(
    "c19_cost_era", lambda v: J.by_era(shifted(v), K.era_table(v.spark), "day").withColumn("cost", K.era_cost(F.col("p"), F.col("p"))),
    f"SELECT o_orderkey, lot_size, 40 + 2 * p * txn / 100000 + 2 * p * 10 / 10000000 + p * 0.002 / 100 + p * stt / 100 + (40 + 2 * p * txn / 100000 + 2 * p * 10 / 10000000) * 0.18 AS cost FROM {_SH} o ASOF JOIN {_ERA} ON o.day >= e.effective_date", "o_orderkey lot_size", "cost",
)
reg("i03_era_cost_bps", lambda v: J.by_era(shifted(v), K.era_table(v.spark), "day").withColumn("bps", K.era_cost(F.col("p"), F.col("p"), 3.5) / F.col("p") * 10_000), f"SELECT o_orderkey, (40 + 2 * p * txn / 100000 + 2 * p * 10 / 10000000 + p * 0.002 / 100 + p * stt / 100 + (40 + 2 * p * txn / 100000 + 2 * p * 10 / 10000000) * 0.18) / p * 10000 + 3.5 AS bps FROM {_SH} o ASOF JOIN {_ERA} ON o.day >= e.effective_date", "o_orderkey", "bps")
reg("c20_lot_size", lambda v: J.by_era(shifted(v).select("o_orderkey", F.trunc("day", "month").alias("day")), K.era_table(v.spark), "day"), f"SELECT o_orderkey, lot_size FROM (SELECT o_orderkey, CAST(date_trunc('month', day) AS DATE) AS day FROM {_SH}) o ASOF JOIN {_ERA} ON o.day >= e.effective_date", "o_orderkey lot_size")
reg("i04_position_size", lambda v: v.bars.select("symbol", "bar_ts", K.position_size(F.lit(1e6), F.col("close"), 0.01, F.lit(0.8), F.col("close") * F.col("volume"), 0.05).alias("units")), "SELECT symbol, bar_ts, CASE WHEN close > 0 THEN CAST(greatest(0, least(floor(1e6 * 0.01 * 0.8 / close), floor(close * volume * 0.05 / close))) AS BIGINT) ELSE 0 END AS units FROM bars", "symbol bar_ts units")
reg("i05_row_digest", lambda v: v.table("nation").select("n_nationkey", K.row_digest("n_name", "n_regionkey").alias("digest")), "SELECT n_nationkey, sha256(n_name || '|' || n_regionkey) AS digest FROM nation", "n_nationkey digest")
reg("i05_set_digest", lambda v: K.set_digest(v.table("customer").withColumn("digest", F.sha2("c_name", 256)), "digest", ["c_nationkey"]), "SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(c_name), 1, 12)) AS HUGEINT)) % 281474976710656 AS BIGINT) AS set_digest FROM customer GROUP BY 1", "c_nationkey n set_digest")
reg("i06_stable_probability", lambda v: v.ticks.select("event_id", K.stable_probability("symbol", "event_id").alias("p")), "SELECT event_id, CAST(('0x' || substr(sha256(concat_ws('|', symbol, event_id)), 1, 8)) AS BIGINT) / 4294967295 AS p FROM ticks", "event_id", "p")
reg("i07_logistic", lambda v: v.scores.select("event_id", K.logistic(F.col("p") - 0.5).alias("s")), "SELECT event_id, 1 / (1 + exp(-20 * (p - 0.5))) AS s FROM scores", "event_id", "s")
reg("i08_month_chunks", lambda v: K.month_chunks(v.table("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")), "a", "b"), "SELECT o_custkey, greatest(a, m) AS chunk_from, least(b, last_day(m)) AS chunk_to FROM (SELECT o_custkey, a, b, CAST(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)) AS DATE) AS m FROM (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1))", "o_custkey chunk_from chunk_to")
reg("i09_finite", lambda v: v.bars.select("symbol", "bar_ts", F.coalesce(F.nanvl(F.try_divide(F.col("close"), F.col("volume")), F.lit(0.0)), F.lit(0.0)).alias("x")), "SELECT symbol, bar_ts, coalesce(close / nullif(volume, 0), 0) AS x FROM bars", "symbol bar_ts", "x")
reg("e48_family_features", lambda v: E.volume_ratio(E.price_returns(E.momentum_bps(v.bars, 1, E.SYMBOL), (1,))), "SELECT symbol, bar_ts, CASE WHEN before <> 0 THEN (close / before - 1) * 10000 END AS momentum_bps, CASE WHEN before <> 0 THEN close / before - 1 ELSE 0 END AS return_1, CASE WHEN m > 0 THEN volume / m ELSE 1 END AS volume_ratio FROM (SELECT *, lag(close) OVER w AS before, avg(volume) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts))", "symbol bar_ts", "momentum_bps return_1 volume_ratio")
