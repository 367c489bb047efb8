"""Queries of file, session, snapshot and ledger checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import audit as A
from saltmarsh.operators import select as S
from saltmarsh.plans.views import reg
from saltmarsh.sources import archives as Z
from saltmarsh.streaming import jobs as J

reg(
    "a10_zip_members", lambda v: Z.unzip_csv(Z.zip_rows(v.table("customer"), ["c_custkey", "c_name", "c_acctbal"])).select(F.col("cells.c_custkey").cast("long").alias("c_custkey"), F.col("cells.c_name").alias("c_name"), F.col("cells.c_acctbal").cast("double").alias("c_acctbal")),
    "SELECT c_custkey, c_name, c_acctbal FROM customer", "c_custkey c_name", "c_acctbal",
)
reg(
    "a12_nearest_expiry", lambda v: S.nearest_expiry(v.table("lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("expiry"), F.col("l_linenumber").alias("line"), F.floor(F.col("l_quantity") / 10).alias("volume")), ["l_orderkey"], "expiry", "volume", "line"),
    "SELECT l_orderkey, first(l_linenumber ORDER BY CAST(l_shipdate AS DATE), l_linenumber) AS line, CAST(min(l_shipdate) AS DATE) AS expiry FROM lineitem WHERE floor(l_quantity / 10) > 0 GROUP BY 1", "l_orderkey line expiry",
)


def _immutable(v):
    """Written twice; the second time nothing changes."""
    df, folder = v.table("customer").select("c_custkey", "c_name"), J.scratch(v.spark)
    path = Z.write_immutable(df, folder, "customers")
    if Z.write_immutable(df, folder, "customers") != path:
        raise ValueError("the same content went to another path")
    return v.spark.read.parquet(path)


reg("a19_immutable_sink", _immutable, "SELECT c_custkey, c_name FROM customer", "c_custkey c_name")
reg(
    "b27_guarded_columns", lambda v: v.bars.select("symbol", "bar_ts", *A.guard_columns(c for c in v.bars.columns if c in ("open", "high", "low", "close"))),
    "SELECT symbol, bar_ts, open, high, low, close FROM bars", "symbol bar_ts", "open high low close",
)


def _picks(v):
    side = F.when(F.col("line") == 7, "HOLD").when(F.col("side") == "A", "LONG").when(F.col("side") == "R", "SHORT").otherwise("NO_TRADE")
    status = F.when(F.col("line") == 6, "BAD").when(F.col("status") == "O", "NO_TRADE").otherwise("HALTED")
    return A.recommendations(v.trades.select("order_key", "line", side.alias("side"), status.alias("status"), F.col("quantity").cast("long").alias("size")), "side", "status", "size")


reg(
    "b36_recommendations", _picks,
    """SELECT order_key, line, side, q AS quarantined, CASE WHEN side = 'NO_TRADE' THEN 0 ELSE size END AS size, CASE WHEN q THEN status WHEN side = 'NO_TRADE' THEN 'NO_TRADE' WHEN status = 'NO_TRADE' THEN 'PICK' ELSE status END AS status
      FROM (SELECT *, side = 'HOLD' OR status = 'BAD' AS q FROM (SELECT order_key, line, CAST(quantity AS BIGINT) AS size, CASE WHEN line = 7 THEN 'HOLD' WHEN side = 'A' THEN 'LONG' WHEN side = 'R' THEN 'SHORT' ELSE 'NO_TRADE' END AS side,
        CASE WHEN line = 6 THEN 'BAD' WHEN status = 'O' THEN 'NO_TRADE' ELSE 'HALTED' END AS status FROM trades))""",
    "order_key line side status size quarantined",
)


def _grids(v):
    """A grid for each order: lines of odd number as objects, with an id only where divisible by three, others as arrays."""
    i = v.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("k"), F.col("l_quantity").cast("long").alias("t"), F.col("l_suppkey").alias("s"))
    named = F.to_json(F.struct(F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), "k")).alias("id"), F.col("t").alias("target_bps"), F.col("s").alias("stop_bps"), F.col("k").alias("horizon_bars")))
    item = F.when(F.col("k") % 2 == 1, named).otherwise(F.to_json(F.array("t", "s", "k")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("k", "t", "s", item.alias("item")))), lambda x: x["item"])
    return Z.grid_table(i.groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("grid")), "grid")


reg(
    "b37_replay_grid", _grids,
    "SELECT l_orderkey, CASE WHEN k % 6 = 3 THEN concat('c', k) ELSE concat('grid_', row_number() OVER (PARTITION BY l_orderkey ORDER BY k, t, s) - 1) END AS id, t AS target_bps, s AS stop_bps, k AS horizon_bars FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS k, CAST(l_quantity AS BIGINT) AS t, l_suppkey AS s FROM lineitem)",
    "l_orderkey id horizon_bars", "target_bps stop_bps",
)


def _files(v):
    """Files of an order: role by parity of the line, one file for each return flag; bounds are ship years."""
    year = F.year("l_shipdate").cast("long")
    return v.table("lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("fix"), F.col("l_returnflag").alias("file")).agg(
        F.count("*").alias("n"), F.min(year).alias("a"), F.max(year).alias("b"), F.max("l_linestatus").alias("kind"), (F.sum("l_quantity") > 5).alias("ok"))


_FILES = "(SELECT l_orderkey, l_linenumber % 2 = 0 AS fix, l_returnflag AS file, count(*) AS n, min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS b, max(l_linestatus) AS kind, sum(l_quantity) > 5 AS ok FROM lineitem GROUP BY 1, 2, 3)"
reg(
    "c16_corrections", lambda v: A.resolve_corrections(_files(v), "l_orderkey", F.col("fix"), F.col("ok"), "kind", "n", "a", "b"),
    f"""SELECT l_orderkey, fix, file, max(a) OVER w <= min(b) OVER w AS overlap, CASE WHEN count(*) OVER w = 1 THEN CASE WHEN NOT ok THEN 'invalid_schema' WHEN fix THEN 'selected_corrected' ELSE 'selected' END
      WHEN count(*) OVER w = 2 AND sum(CAST(fix AS INT)) OVER w = 1 AND bool_and(ok) OVER w AND min(n) OVER w = max(n) OVER w AND min(a) OVER w = max(a) OVER w AND min(b) OVER w = max(b) OVER w AND min(kind) OVER w = max(kind) OVER w
      THEN CASE WHEN fix THEN 'selected_corrected' ELSE 'superseded' END ELSE 'quarantined' END AS decision FROM {_FILES} WINDOW w AS (PARTITION BY l_orderkey)""",
    "l_orderkey fix file overlap decision",
)


def _session_rows(v):
    """Ticks as rows of a vendor's session file in order of arrival, with coarse prices."""
    t = v.ticks.select("symbol", F.to_date("ts").alias("trade_date"), F.hour("ts").cast("long").alias("slot"), "event_id", F.floor(F.col("price") / 40).alias("close"), "size", F.col("oi_step").alias("oi"))
    return t.withColumn("volume", F.when(F.col("size") > 5, F.col("size")))


reg(
    "d24_session_scan", lambda v: A.session_scan(_session_rows(v), ["symbol", "trade_date"], "slot", "event_id", 1, 22, 18, F.day("trade_date") == 20),
    """SELECT * EXCLUDE (starts, ends, missing), len(starts) AS n_gaps, coalesce(array_to_string(list_transform(range(1, len(starts) + 1), lambda i: concat(starts[i], '-', ends[i], ' (', ends[i] - starts[i] + 1, ')')), '; '), '') AS gap_segments,
      CASE WHEN day(trade_date) = 20 THEN 'keep_full' WHEN duplicates > 0 AND n >= 44 THEN 'drop_day' WHEN n > 22 THEN 'trim_to_regular_hours' WHEN n < 22 AND (n < 18 OR last < 22) THEN 'drop_day' WHEN n < 22 THEN 'exclude_labels_near_close' WHEN len(starts) = 0 AND duplicates = 0 THEN 'keep_full' ELSE 'exclude_training' END AS disposition
      FROM (SELECT *, list_filter(missing, lambda x: NOT list_contains(missing, x - 1)) AS starts, list_filter(missing, lambda x: NOT list_contains(missing, x + 1)) AS ends
      FROM (SELECT symbol, trade_date, count(*) AS n, min(slot) AS first, max(slot) AS last, count(*) - count(DISTINCT slot) AS duplicates, count(*) FILTER (back) AS non_monotonic, count(*) FILTER (coalesce(volume, 0) = 0) AS zero_volume, count(*) FILTER (close = 0) AS zero_price,
        count(*) FILTER (same) + count(*) FILTER (same AND NOT before) AS constant, bool_and(coalesce(oi, 0) = 0) AS oi_all_zero, list_filter(range(1, 23), lambda x: NOT list_contains(list(slot), x)) AS missing
      FROM (SELECT *, coalesce(lag(same) OVER w, false) AS before FROM (SELECT *, coalesce(close = lag(close) OVER w, false) AS same, coalesce(lag(slot) OVER w > slot, false) AS back
        FROM (SELECT symbol, CAST(ts AS DATE) AS trade_date, CAST(hour(ts) AS BIGINT) AS slot, event_id, floor(price / 40) AS close, CASE WHEN size > 5 THEN size END AS volume, oi_step AS oi FROM ticks) WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY event_id))
        WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY event_id)) GROUP BY 1, 2))""",
    "symbol trade_date n first last duplicates non_monotonic zero_volume zero_price constant oi_all_zero gap_segments n_gaps disposition",
)


def _paper(v):
    incident = F.when((F.col("line") == 7) & (F.col("quantity") > 45), "missed_signal").when(F.col("order_key") % 997 == 0, "duplicate_signal")
    return v.trades.withColumns({"net": F.col("gross_bps") - 3.5, "off": (F.col("quantity") - 25) / 100, "p": F.col("quantity") / 100, "y": (F.col("gross_bps") > 20).cast("double"), "incident": incident})


reg(
    "d44_graduation", lambda v: A.graduation(_paper(v), "config", "date", "net", "off", "p", "y", "incident", 0.245),
    """SELECT *, months >= 6 AS gate_months, n >= 200 AS gate_trades, ci_low > 0 AS gate_ci, worst <= 0.245 AS gate_fill, ece <= 0.10 AS gate_ece, missed = 0 AS gate_missed, repeated = 0 AS gate_repeated FROM (SELECT config, count(*) AS n, datediff('day', min(date), max(date)) / 30.4375 AS months,
      avg(gross_bps - 3.5) - coalesce(1.96 * stddev_samp(gross_bps - 3.5) / sqrt(count(*)), 0) AS ci_low, max(abs((quantity - 25) / 100)) AS worst, count(*) FILTER (line = 7 AND quantity > 45) AS missed, count(*) FILTER (NOT (line = 7 AND quantity > 45) AND order_key % 997 = 0) AS repeated FROM trades GROUP BY 1)
      JOIN (SELECT config, sum(off) / sum(k) AS ece FROM (SELECT config, abs(sum(quantity / 100) - sum(CASE WHEN gross_bps > 20 THEN 1.0 ELSE 0 END)) AS off, count(*) AS k FROM trades GROUP BY config, least(floor(quantity / 100 * 10), 9)) GROUP BY 1) USING (config)""",
    "config n missed repeated gate_months gate_trades gate_ci gate_fill gate_ece gate_missed gate_repeated", "months ci_low ece",
)


def _picked(v):
    d = v.scores.withColumn("day", F.to_date("ts"))
    return S.hit_report(S.costed_picks(d, ["day"], 5, "p", 0.9, F.when(F.col("y") == 1, 1.0).when(F.col("event_id") % 3 == 0, 0.0).otherwise(-1.0), 30.0, "event_id"), ["day"])


reg(
    "g01_costed_report", _picked,
    "SELECT day, count(*) AS picks, count(*) FILTER (g > 0) AS wins, count(*) FILTER (g < 0) AS losses, avg(CASE WHEN g > 0 THEN 1.0 ELSE 0 END) AS hit_rate, sum(g - 0.003) AS net_score FROM (SELECT CAST(ts AS DATE) AS day, p, CASE WHEN y = 1 THEN 1.0 WHEN event_id % 3 = 0 THEN 0.0 ELSE -1.0 END AS g FROM scores QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY p DESC, event_id) <= 5) WHERE p >= 0.9 GROUP BY 1",
    "day picks wins losses", "hit_rate net_score",
)
_W4 = "(PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)"
reg(
    "s06_label_stream", lambda v: J.run(J.label_stream(J.stream_of(v.bars), "symbol", "bar_ts", 4, 0.4, 0.3, "1 hour", "90 days")).withColumn("bar_ts", F.col("bar_ts").cast("timestamp_ntz")),
    f"""SELECT symbol, bar_ts, CASE WHEN k IS NULL THEN 'timeout' WHEN path[k].lo <= e * 0.7 THEN 'stop' ELSE 'target' END AS outcome, coalesce(k, 4) AS bars_held, (CASE WHEN k IS NULL THEN path[4].c WHEN path[k].lo <= e * 0.7 THEN e * 0.7 ELSE e * 1.4 END / e - 1) * 10000 AS gross_bps
      FROM (SELECT *, path[1].o AS e, list_filter([1, 2, 3, 4], lambda i: path[i].hi >= path[1].o * 1.4 OR path[i].lo <= path[1].o * 0.7)[1] AS k FROM (SELECT symbol, bar_ts, list({{'o': open, 'hi': high, 'lo': low, 'c': close}}) OVER {_W4} AS path FROM bars) WHERE len(path) = 4)""",
    "symbol bar_ts outcome bars_held", "gross_bps",
)


def _snapshots(v):
    """Records of ticks with broken digests, numbers that are not finite, and ids used twice."""
    e = F.col("event_id")
    d = v.ticks.select("event_id", F.when(e % 53 == 0, e - 1).otherwise(e).alias("id"), F.concat_ws("|", "symbol", "event_id", "size").alias("content"), F.when(e % 37 == 0, F.lit(float("nan"))).when(e % 43 == 0, F.lit(float("-inf"))).otherwise(F.col("price")).alias("price"))
    return A.snapshot_faults(d.withColumn("stored", F.when(e % 41 != 0, F.sha2("content", 256))), "id", F.col("content"), "stored", ["price"])


reg(
    "s10_snapshot_checks", _snapshots,
    "SELECT event_id, id, concat_ws(',', CASE WHEN event_id % 41 = 0 THEN 'hash' END, CASE WHEN event_id % 37 = 0 OR event_id % 43 = 0 THEN 'non_finite' END, CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate_id' END) AS faults FROM (SELECT *, CASE WHEN event_id % 53 = 0 THEN event_id - 1 ELSE event_id END AS id FROM ticks)",
    "event_id id faults",
)


def _ledger(v):
    s = v.trades.select("config", "date", "side", "fold", "order_key", "line", F.when(F.col("line") % 3 != 0, F.col("gross_bps").cast("long")).alias("fill"), F.col("quantity").cast("long").alias("intended"), F.lit(20).cast("long").alias("expected"))
    return A.paper_ledger(s, ["config", "date", "side"], ["order_key", "line", "fill", "intended"], "fill", "intended", "expected")


_SIGNALS = "(SELECT config, date, side, fold, count(*) - 1 AS skipped, arg_min(CASE WHEN line % 3 <> 0 THEN CAST(gross_bps AS BIGINT) ELSE CAST(quantity AS BIGINT) END, (order_key, line, CASE WHEN line % 3 <> 0 THEN CAST(gross_bps AS BIGINT) END, CAST(quantity AS BIGINT))) AS fill_price FROM trades GROUP BY 1, 2, 3, 4)"
reg("s11_ledger", _ledger, f"SELECT *, fill_price - 20 AS fill_divergence FROM {_SIGNALS}", "config date side skipped fill_price fill_divergence")
reg(
    "s11_ledger_chain", lambda v: A.chain_hashes(_ledger(v), ["config", "fold"], ["date", "side"], F.concat_ws("|", "date", "side", "fill_price")),
    f"""WITH RECURSIVE e AS (SELECT config, fold, date, side, concat_ws('|', date, side, fill_price) AS text, row_number() OVER (PARTITION BY config, fold ORDER BY date, side) AS r FROM {_SIGNALS}),
      c AS (SELECT config, fold, date, side, r, 'GENESIS' AS previous_hash, sha256('GENESIS|' || text) AS chain_hash FROM e WHERE r = 1 UNION ALL SELECT e.config, e.fold, e.date, e.side, e.r, c.chain_hash, sha256(c.chain_hash || '|' || e.text) FROM c JOIN e ON e.config = c.config AND e.fold = c.fold AND e.r = c.r + 1) SELECT * FROM c""",
    "config fold date side previous_hash chain_hash",
)


def _closed(v):
    closes = v.table("orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("order_key"), (F.col("o_totalprice") / 1000).alias("exit"))
    t = v.trades.select("order_key", "line", F.when(F.col("side") == "R", "SHORT").when(F.col("side") == "N", "SELL").otherwise("LONG").alias("side"), F.col("gross_bps").alias("fill"), "quantity", F.when(F.col("line") != 2, F.lit(1.5)).alias("costs"))
    return A.close_trades(t, closes, ["order_key"], "exit", F.col("side"), "fill", "quantity", "costs")


reg(
    "s12_trade_close", _closed,
    "SELECT order_key, line, CASE WHEN x IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, CASE WHEN side IN ('R', 'N') THEN -1 ELSE 1 END * (x - gross_bps) * quantity - CASE WHEN line <> 2 THEN 1.5 ELSE 0 END AS pnl FROM trades LEFT JOIN (SELECT o_orderkey, max(o_totalprice / 1000) AS x FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1) ON o_orderkey = order_key",
    "order_key line status", "pnl",
)
