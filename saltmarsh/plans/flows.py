"""Queries of sources, streams and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from saltmarsh.plans.views import reg
from saltmarsh.sources import tables as T
from saltmarsh.streaming import jobs as S


def _lake(v) -> str:
    path = S.scratch(v.spark) + "/bars"
    T.write_partitions(v.bars.select("symbol", "trade_date", "bar_ts", "slot", "close", "volume"), path, "trade_date", "symbol")
    return path


def _csv(v) -> str:
    path = S.scratch(v.spark) + "/bars_csv"
    v.bars.select(F.col("bar_ts").alias("DateTime"), "symbol", "open", "high", "low", "close", "volume", F.lit("x").alias("note")).write.option("header", True).csv(path)
    return path


reg("a01_candle_csv", lambda v: T.read_candles(v.spark, _csv(v)).select("symbol", F.col("timestamp").cast("timestamp_ntz").alias("bar_ts"), F.col("close").cast("double").alias("close"), F.col("volume").cast("long").alias("volume")), "SELECT symbol, bar_ts, close, volume FROM bars", "symbol bar_ts volume", "close")
reg("a03_partition_scan", lambda v: T.scan(v.spark, _lake(v), ["symbol", "bar_ts", "slot", "close"], symbol=["click", "view"]), "SELECT symbol, bar_ts, slot, close FROM bars WHERE symbol IN ('click', 'view')", "symbol bar_ts slot", "close")


def _rewritten(v):
    path = _lake(v)
    T.write_partitions(v.bars.where("symbol = 'click'").select("symbol", "trade_date", "bar_ts", "slot", (F.col("close") + 1).alias("close"), "volume"), path, "trade_date", "symbol")
    return T.scan(v.spark, path, ["symbol", "bar_ts", "close"])


reg("a06_partition_overwrite", _rewritten, "SELECT symbol, bar_ts, CASE WHEN symbol = 'click' THEN close + 1 ELSE close END AS close FROM bars", "symbol bar_ts", "close")
reg(
    "a06_changed_only", lambda v: T.changed_only(v.bars, ["symbol", "trade_date"], ["bar_ts", "close"], T.fingerprints(v.bars.withColumn("close", F.when(F.col("slot") == 5, F.col("close") + 1).otherwise(F.col("close"))), ["symbol", "trade_date"], ["bar_ts", "close"])),
    "SELECT symbol, bar_ts FROM bars b WHERE EXISTS (SELECT 1 FROM bars c WHERE c.symbol = b.symbol AND c.trade_date = b.trade_date AND c.slot = 5)", "symbol bar_ts",
)
reg("a09_append_missing_days", lambda v: T.append_missing_days(v.bars, v.bars.where((F.col("slot") >= 22) & (F.dayofmonth("trade_date") % 3 != 0)), ["symbol", "trade_date"]), "SELECT symbol, bar_ts FROM bars b WHERE NOT EXISTS (SELECT 1 FROM bars c WHERE c.slot >= 22 AND day(c.trade_date) % 3 <> 0 AND c.symbol = b.symbol AND c.trade_date = b.trade_date)", "symbol bar_ts")
reg("a11_typed_filter", lambda v: v.table("lineitem").where(F.trim("l_returnflag") == "A").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").try_cast("double").alias("quantity"), F.date_add(F.to_date("l_shipdate"), 1).alias("usable_from")), "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CAST(CAST(l_shipdate AS DATE) + 1 AS DATE) AS usable_from FROM lineitem WHERE l_returnflag = 'A'", "l_orderkey l_linenumber usable_from", "quantity")
reg(
    "a14_candle_arrays", lambda v: T.candle_arrays(v.bars.groupBy("symbol", "trade_date").agg(F.to_json(F.collect_list(F.array(*[F.col(c).cast("string") for c in ("bar_ts", "open", "high", "low", "close", "volume", "oi")]))).alias("candles")), "candles"),
    "SELECT symbol, bar_ts AS ts, open, high, low, close, volume, oi FROM bars", "symbol ts", "open high low close volume oi",
)
reg("a16_file_inventory", lambda v: T.file_inventory(v.table("events").select("*", "_metadata"), "ts").select("n", "first_ts", "last_ts"), "SELECT count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events", "n first_ts last_ts")
reg("s01_landing", lambda v: S.run(S.land(S.events(v.spark, v.sf_dir), ["event_type", "user_id", "value"], "ts", "60 days").select("event_type", "user_id", "value", "digest")), "SELECT DISTINCT event_type, user_id, sha256(concat_ws('|', event_type, user_id, value)) AS digest FROM (SELECT event_type, user_id, value FROM events)", "event_type user_id digest")
reg("s03_latest", lambda v: S.latest(S.events(v.spark, v.sf_dir), "event_type", "ts", ["event_id", "value"]), "SELECT event_type, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1", "event_type ts event_id", "value")
reg("s07_running_state", lambda v: S.running_state(S.events(v.spark, v.sf_dir), "event_type", "ts", "value"), "SELECT event_id, event_type, lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous FROM events", "event_id event_type", "previous")
reg("s13_windowed_counts", lambda v: S.run(S.windowed_counts(S.events(v.spark, v.sf_dir), "ts", "event_type", "value", "1 hour", "2 hours")), "SELECT window_start, event_type, n, total FROM (SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOURS", "window_start event_type n", "total")


def _log(v):
    o = v.table("orders").select("o_custkey", "o_orderkey", F.concat_ws("|", "o_custkey", "o_orderkey").alias("content"))
    stored = F.when(F.col("o_orderkey") % 97 == 0, F.sha2(F.concat(F.col("content"), F.lit("x")), 256)).otherwise(F.sha2("content", 256))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.withColumn("stored", stored).withColumn("previous", F.when(F.col("o_orderkey") % 89 == 0, "broken").otherwise(F.coalesce(F.lag("stored").over(w), F.lit("GENESIS"))))


reg("s08_chain_violations", lambda v: S.chain_violations(_log(v), "o_custkey", "o_orderkey", "content", "stored", "previous"), "SELECT o_custkey, o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 97 = 0 THEN 'content' END, CASE WHEN o_orderkey % 89 = 0 THEN 'link' END) AS violations FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0", "o_custkey o_orderkey violations")
def _logistic(v):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = VectorAssembler(inputCols=["open", "high", "low", "volume"], outputCol="x").transform(v.bars.withColumn("y", (F.col("close") > F.col("open")).cast("double")))
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=10).fit(df)
    return model.transform(df).select("symbol", "bar_ts", vector_to_array("probability")[1].alias("p"))


def _boosted(v):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    df = VectorAssembler(inputCols=["open", "high", "low", "volume"], outputCol="x").transform(v.bars.withColumn("y", (F.col("close") > F.col("open")).cast("double")))
    return GBTClassifier(featuresCol="x", labelCol="y", maxIter=5, maxDepth=3, seed=1).fit(df).transform(df).select("symbol", "bar_ts", vector_to_array("probability")[1].alias("p"))


def _isotonic(v):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    df = VectorAssembler(inputCols=["p"], outputCol="x").transform(v.scores.withColumn("label", F.col("y").cast("double")))
    return IsotonicRegression(featuresCol="x", labelCol="label").fit(df).transform(df).select("event_id", F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.col("prediction"))).alias("calibrated"))


reg("m01_boosted_sides", _boosted, None, "symbol bar_ts", "p")
reg("m02_isotonic", _isotonic, None, "event_id", "calibrated")
reg("m03_logistic", _logistic, None, "symbol bar_ts", "p")
reg(
    "m04_trailing_win_rate", lambda v: v.scores.withColumn("win_rate", F.avg("y").over(Window.partitionBy("symbol").orderBy("ts", "event_id").rowsBetween(-10, -1))),
    "SELECT event_id, avg(y) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS win_rate FROM scores", "event_id", "win_rate",
)
