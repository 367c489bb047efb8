"""Further queries: lake sinks, corrections, ledgers, and compositions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltmarsh.operators import asof as J
from saltmarsh.operators import features as E
from saltmarsh.operators import metrics as M
from saltmarsh.operators import select as C
from saltmarsh.operators.ranks import interpolated
from saltmarsh.plans.views import reg
from saltmarsh.sources import tables as T
from saltmarsh.streaming import jobs as S

KEEP = "symbol bar_ts"
reg("a04_gold_scan", lambda v: v.bars.withColumn("label_excluded", F.when(F.col("slot") % 7 != 0, F.col("slot") % 5 == 0)).where(~F.coalesce("label_excluded", F.lit(False))), "SELECT symbol, bar_ts FROM bars WHERE NOT coalesce(CASE WHEN slot % 7 <> 0 THEN slot % 5 = 0 END, false)", KEEP)


def _views(v):
    v.bars.createOrReplaceTempView("lake_bars")
    return v.spark.sql("SELECT symbol, trade_date, count(*) AS n, max(high) AS top FROM lake_bars GROUP BY symbol, trade_date")


reg("a05_named_views", _views, "SELECT symbol, trade_date, count(*) AS n, max(high) AS top FROM bars GROUP BY 1, 2", "symbol trade_date n", "top")


def _gold(v):
    path = S.scratch(v.spark) + "/gold"
    df = v.bars.where("volume > 0").select("symbol", "bar_ts", "close")
    if df.isEmpty():
        raise ValueError("no labelled rows")
    df.repartition("symbol").sortWithinPartitions("symbol", "bar_ts").write.parquet(path)
    return v.spark.read.parquet(path)


reg("a07_gold_sink", _gold, "SELECT symbol, bar_ts, close FROM bars WHERE volume > 0", KEEP, "close")
reg("a08_date_from_name", lambda v: v.bars.select("symbol", "bar_ts", F.when(F.col("slot") % 2 == 0, F.concat(F.lit("nifty_fut_"), F.date_format("trade_date", "dd_MM_yyyy"), F.lit(".csv"))).otherwise(F.concat(F.lit("options_"), F.date_format("trade_date", "yyyyMMdd"), F.lit(".parquet"))).alias("file")).withColumn("day", T.date_from_name("file")), "SELECT symbol, bar_ts, trade_date AS day FROM bars", f"{KEEP} day")


def _segments(v):
    path = S.scratch(v.spark) + "/segments"
    T.write_partitions(v.bars.withColumn("segment", F.substring("symbol", 1, 1)).select("segment", "trade_date", "symbol", "bar_ts", "close"), path, "segment", "trade_date")
    return T.scan(v.spark, path, ["symbol", "bar_ts", "close"], segment=["c"])


reg("a13_segment_sink", _segments, "SELECT symbol, bar_ts, close FROM bars WHERE symbol LIKE 'c%'", KEEP, "close")


def _cache(v):
    path = S.scratch(v.spark)
    v.table("nation").write.option("header", True).csv(f"{path}/csv")
    v.spark.read.option("header", True).schema("n_nationkey long, n_name string, n_regionkey long").csv(f"{path}/csv").write.parquet(f"{path}/cache")
    return v.spark.read.parquet(f"{path}/cache")


reg("a15_csv_cache", _cache, "SELECT n_nationkey, n_name, n_regionkey FROM nation", "n_nationkey n_name n_regionkey")
reg("a02_json_rows", lambda v: _json_rows(v), "SELECT c_custkey, c_name, c_nationkey FROM customer", "c_custkey c_name c_nationkey")


def _json_rows(v):
    path = S.scratch(v.spark) + "/rows.jsonl"
    v.table("customer").select("c_custkey", "c_name", "c_nationkey").write.json(path)
    return T.read_rows(v.spark, path, "c_custkey long, c_name string, c_nationkey long")


reg("a17_file_families", lambda v: v.spark.read.format("binaryFile").load(f"{v.sf_dir}/*.parquet").select(F.regexp_extract("path", r"([a-z]+)\.parquet", 1).alias("family"), "length").groupBy("family").agg(F.count("*").alias("n"), F.sum("length").alias("bytes")), None, "family n bytes")
reg("a18_lower_columns", lambda v: v.table("region").toDF(*[c.upper() for c in v.table("region").columns]).transform(lambda d: d.toDF(*[c.lower() for c in d.columns])).withColumn("source", F.lit("fallback")), "SELECT r_regionkey, r_name, 'fallback' AS source FROM region", "r_regionkey r_name source")

reg(
    "a20_archive_fill", lambda v: T.append_missing_days(v.bars.where(F.col("slot").between(9, 15)).withColumn("close", F.round("close", 2)), v.bars.where("slot = 12"), ["symbol", "trade_date"]),
    "SELECT symbol, bar_ts, round(close, 2) AS close FROM bars b WHERE slot BETWEEN 9 AND 15 AND NOT EXISTS (SELECT 1 FROM bars c WHERE c.slot = 12 AND c.symbol = b.symbol AND c.trade_date = b.trade_date)", KEEP, "close",
)
reg(
    "b30_entry_grid", lambda v: v.bars.crossJoin(F.broadcast(v.bars.select("symbol").distinct().select((F.length("symbol") % 3).cast("long").alias("skip")).distinct())).where((F.col("slot") >= F.col("skip")) & ~F.col("slot").between(11, 12)).groupBy("symbol", "skip").agg(F.count("*").alias("n")),
    "SELECT symbol, skip, count(*) AS n FROM bars, (SELECT DISTINCT CAST(length(symbol) % 3 AS BIGINT) AS skip FROM bars) WHERE slot >= skip AND NOT slot BETWEEN 11 AND 12 GROUP BY 1, 2", "symbol skip n",
)
reg("b39_bar_aliases", lambda v: v.bars.select("symbol", "bar_ts", F.col("open").alias("f_open"), F.when(F.col("slot") % 2 == 0, F.col("close")).alias("close"), F.col("close").alias("fut_close")).select("symbol", "bar_ts", F.col("f_open").alias("open"), F.coalesce("close", "fut_close").alias("close")), "SELECT symbol, bar_ts, open, close FROM bars", KEEP, "open close")
def _prior_thresholds(v):
    d = v.scores.withColumn("day", F.to_date("ts"))
    q = interpolated(d, ["day"], "p", {"q85": 0.85, "q95": 0.95})
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    return d.join(q.select("day", F.lag("q85").over(w).alias("q85"), F.lag("q95").over(w).alias("q95")), "day").withColumn("level", F.when(F.col("p") >= F.col("q95"), 2).when(F.col("p") >= F.col("q85"), 1).otherwise(0).cast("long"))


reg(
    "c22_prior_day_thresholds", _prior_thresholds,
    "SELECT s.event_id, q85, q95, CASE WHEN p >= q95 THEN 2 WHEN p >= q85 THEN 1 ELSE 0 END AS level FROM scores s JOIN (SELECT day, lag(a) OVER (ORDER BY day) AS q85, lag(b) OVER (ORDER BY day) AS q95 FROM (SELECT CAST(ts AS DATE) AS day, quantile_cont(p, 0.85) AS a, quantile_cont(p, 0.95) AS b FROM scores GROUP BY 1)) q ON q.day = CAST(s.ts AS DATE)", "event_id level", "q85 q95",
)
reg("c23_baseline_join", lambda v: v.bars.join(v.bars.groupBy("symbol", "slot").agg(F.avg("volume").alias("slot_mean")), ["symbol", "slot"]), "SELECT symbol, bar_ts, slot_mean FROM bars JOIN (SELECT symbol, slot, avg(volume) AS slot_mean FROM bars GROUP BY 1, 2) USING (symbol, slot)", KEEP, "slot_mean")
reg("d05_universe_rows", lambda v: v.table("supplier").join(v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey"), "s_nationkey", "left").select("s_suppkey", F.col("n_name").alias("sector"), F.col("n_regionkey").alias("feed"), (F.col("n_regionkey") < 3).alias("available")), "SELECT s_suppkey, n_name AS sector, n_regionkey AS feed, n_regionkey < 3 AS available FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey", "s_suppkey sector feed available")
reg("d39_role_counts", lambda v: v.table("documents").groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 3), "SELECT source, lang, count(*) AS n, count(*) >= 3 AS enough FROM documents GROUP BY 1, 2", "source lang n enough")

reg(
    "s04_snapshot_ages", lambda v: J.as_of(v.bars, v.ticks.withColumn("quote_ts", F.col("ts")), ["symbol"], "bar_ts", "ts", "quote_ts").withColumn("age", F.timestamp_diff("SECOND", F.col("asof_value"), F.col("bar_ts"))),
    "SELECT b.symbol, b.bar_ts, datesub('second', t.ts, b.bar_ts) AS age FROM bars b ASOF LEFT JOIN (SELECT DISTINCT symbol, ts FROM ticks) t ON b.symbol = t.symbol AND b.bar_ts >= t.ts", f"{KEEP} age",
)
_S60 = "PARTITION BY symbol, slot ORDER BY session_idx RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING"
reg(
    "s05_stateful_baseline", lambda v: S.run(S.slot_baseline(S.stream_of(E.with_session_index(v.bars).select("symbol", "slot", "session_idx", F.col("volume").cast("double").alias("value"))), 60, 20)),
    f"SELECT symbol, slot, session_idx, CASE WHEN count(*) OVER ({_S60}) >= 20 THEN avg(volume) OVER ({_S60}) END AS base_mean FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY trade_date) AS session_idx FROM bars)", "symbol slot session_idx", "base_mean",
)
reg(
    "m06_rolling_folds", lambda v: v.trades.agg(F.min("fold").alias("a"), F.max("fold").alias("b")).select(F.explode(F.sequence(F.col("a"), F.col("b") - 3)).alias("select_from")).select("select_from", (F.col("select_from") + 2).alias("select_to"), (F.col("select_from") + 3).alias("oos")),
    "SELECT s AS select_from, s + 2 AS select_to, s + 3 AS oos FROM (SELECT unnest(range(min(fold), max(fold) - 2)) AS s FROM trades)", "select_from select_to oos",
)
_THR = [0.5, 0.6, 0.7, 0.8]


def _selection(v):
    t = v.spark.createDataFrame([(x,) for x in _THR], "threshold double")
    s = v.scores.crossJoin(F.broadcast(t)).where("p >= threshold")
    return s.groupBy("symbol", "threshold").agg(F.count("*").alias("n"), F.avg("y").alias("hit_rate")).withColumn("tradable", (F.col("n") >= 100) & (F.col("hit_rate") >= 0.5))


reg("m08_threshold_selection", _selection, "SELECT symbol, threshold, count(*) AS n, avg(y) AS hit_rate, count(*) >= 100 AND avg(y) >= 0.5 AS tradable FROM scores, (SELECT unnest([0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold) WHERE p >= threshold GROUP BY 1, 2", "symbol threshold n tradable", "hit_rate")
reg("m09_sealed_period", lambda v: M.calibration(v.scores.join(C.sealed_split(v.scores.withColumn("day", F.to_date("ts")), "day", 0.2).where("split = 'sealed'"), F.to_date("ts") == F.col("day"), "left_semi"), ["symbol"], "p", "y"), "SELECT symbol, sum(pow(p - y, 2)) / count(*) AS brier, count(*) AS n FROM scores WHERE CAST(ts AS DATE) IN (SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM scores)) WHERE r > n - greatest(1, least(ceil(n * 0.2), n - 1))) GROUP BY 1", "symbol n", "brier")
reg("m11_scored_report", lambda v: M.breakdowns(M.net(v.trades.where("fold >= 1997"), 8.0), ["side", "status"], "net_bps"), " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS level, count(*) AS n, avg(gross_bps - 8) AS ev FROM trades WHERE fold >= 1997 GROUP BY {d}" for d in ("side", "status")), "dim level n", "ev")
reg("m12_momentum_run", lambda v: C.top_k(E.momentum_bps(v.bars, 1, E.SYMBOL).withColumn("fwd", F.lead("close").over(E.rows(E.SYMBOL)) / F.col("close") - 1).where("momentum_bps IS NOT NULL AND fwd IS NOT NULL"), ["bar_ts"], 2, F.col("momentum_bps").desc(), "symbol").groupBy("symbol").agg(F.count("*").alias("n"), (F.avg("fwd") * 10_000).alias("gross_bps")), "SELECT symbol, count(*) AS n, avg(fwd) * 10000 AS gross_bps FROM (SELECT *, row_number() OVER (PARTITION BY bar_ts ORDER BY m DESC, symbol) AS r FROM (SELECT *, CASE WHEN lag(close) OVER w <> 0 THEN (close / lag(close) OVER w - 1) * 10000 END AS m, CASE WHEN close <> 0 THEN lead(close) OVER w / close - 1 END AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_ts)) WHERE m IS NOT NULL AND fwd IS NOT NULL) WHERE r <= 2 GROUP BY 1", "symbol n", "gross_bps")


def _per_fold(v):
    return v.trades.groupBy("config", "fold").agg(F.avg("gross_bps").alias("score"), F.count("*").alias("n"))


reg("m13_fold_evaluator", _per_fold, "SELECT config, fold, avg(gross_bps) AS score, count(*) AS n FROM trades GROUP BY 1, 2", "config fold n", "score")
