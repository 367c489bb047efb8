"""Views that stand for market tables, built from the given tables; the same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.operators.bars import resample
from saltmarsh.plans import registry


class Views:
    """One input folder's views."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def ticks(self) -> DataFrame:
        """Events as trades."""
        return self.table("events").select(
            "event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"),
            F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("size"), (F.col("user_id") % 50).alias("oi_step"),
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Hourly bars: 30 sessions of up to 24 slots for each of the event types."""
        b = resample(self.ticks, "hour", extra=[F.sum("oi_step").alias("oi")])
        return b.withColumn("trade_date", F.to_date("bar_ts")).withColumn("slot", F.hour("bar_ts").cast("long"))

    @cached_property
    def minutes(self) -> DataFrame:
        """Minute bars of as many instruments as there are blocks of 150 users: the n-th event of a day is its n-th minute."""
        e = self.table("events").withColumn("symbol", F.concat(F.lit("f"), F.floor(F.col("user_id") / 150))).withColumn("trade_date", F.to_date("ts"))
        w = Window.partitionBy("symbol", "trade_date").orderBy("ts", "event_id")
        size = F.regexp_extract("props", "[0-9]+", 0).cast("double")
        e = e.select("symbol", "trade_date", (F.row_number().over(w) - 1).alias("seq"), F.coalesce(F.lag("value").over(w), F.col("value") + 1).alias("open"), F.col("value").alias("close"), size.alias("volume"), (F.col("user_id") % 50).cast("double").alias("oi"), (F.col("user_id") % 7 / 10).alias("spread"))
        return e.select(
            "symbol", (F.col("trade_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("seq") + 555)).alias("bar_ts"), "open",
            (F.greatest("open", "close") + F.col("spread")).alias("high"), (F.least("open", "close") - F.col("spread")).alias("low"), "close", "volume", "oi",
        )

    @cached_property
    def index_values(self) -> DataFrame:
        """A daily index: mean order prices, moved on 10,000 days so that they reach the days of the events."""
        return self.table("orders").groupBy(F.date_add(F.to_date("o_orderdate"), 10_000).alias("date")).agg((F.avg("o_totalprice") / 1000).alias("close"))

    @cached_property
    def daily(self) -> DataFrame:
        """One value a day: the mean order price."""
        return self.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("value"))

    @cached_property
    def panel(self) -> DataFrame:
        """Cross-section: last value of each user and day."""
        e = self.table("events")
        return e.groupBy(F.col("user_id").alias("name"), F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.count("*").alias("n"))

    @cached_property
    def trades(self) -> DataFrame:
        """Line items as trades of a strategy (supplier) in folds (ship year)."""
        i = self.table("lineitem")
        return i.select(
            F.col("l_suppkey").alias("config"), F.year("l_shipdate").cast("long").alias("fold"), F.to_date("l_shipdate").alias("date"),
            F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").cast("long").alias("line"),
            F.col("l_returnflag").alias("side"), F.col("l_linestatus").alias("status"),
            (F.round(F.col("l_discount") * 1000, 0) - F.round(F.col("l_tax") * 1000, 0)).alias("gross_bps"), F.col("l_quantity").cast("double").alias("quantity"),
        )

    @cached_property
    def scores(self) -> DataFrame:
        """Probabilities and outcomes."""
        e = self.table("events")
        return e.select("event_id", F.col("event_type").alias("symbol"), "ts", (F.pmod("value", F.lit(100)) / 100).alias("p"), (F.col("user_id") % 2).cast("long").alias("y"))


#: The same views for DuckDB.
VIEWS_SQL = """
ticks AS (SELECT event_id, event_type AS symbol, ts, value AS price, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS size, user_id % 50 AS oi_step FROM events),
bars AS (SELECT symbol, date_trunc('hour', ts) AS bar_ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS n_ticks, CAST(sum(oi_step) AS BIGINT) AS oi,
  CAST(date_trunc('hour', ts) AS DATE) AS trade_date, CAST(hour(date_trunc('hour', ts)) AS BIGINT) AS slot FROM ticks GROUP BY symbol, date_trunc('hour', ts)),
minutes AS (SELECT symbol, CAST(trade_date AS TIMESTAMP) + to_minutes(seq + 555) AS bar_ts, open, greatest(open, close) + spread AS high, least(open, close) - spread AS low, close, volume, oi FROM (
  SELECT 'f' || CAST(user_id // 150 AS VARCHAR) AS symbol, CAST(ts AS DATE) AS trade_date, row_number() OVER w - 1 AS seq, coalesce(lag(value) OVER w, value + 1) AS open, value AS close,
  CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS volume, CAST(user_id % 50 AS DOUBLE) AS oi, user_id % 7 / 10 AS spread FROM events WINDOW w AS (PARTITION BY user_id // 150, CAST(ts AS DATE) ORDER BY ts, event_id))),
index_values AS (SELECT CAST(o_orderdate AS DATE) + 10000 AS date, avg(o_totalprice) / 1000 AS close FROM orders GROUP BY 1),
daily AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1),
panel AS (SELECT user_id AS name, CAST(ts AS DATE) AS date, last(value ORDER BY ts, event_id) AS value, count(*) AS n FROM events GROUP BY 1, 2),
trades AS (SELECT l_suppkey AS config, CAST(year(l_shipdate) AS BIGINT) AS fold, CAST(l_shipdate AS DATE) AS date, l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line,
  l_returnflag AS side, l_linestatus AS status, round(l_discount * 1000, 0) - round(l_tax * 1000, 0) AS gross_bps, CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem),
scores AS (SELECT event_id, event_type AS symbol, ts, fmod(value, 100) / 100 AS p, CAST(user_id % 2 AS BIGINT) AS y FROM events)
"""


def reg(name: str, build: Callable[[Views], DataFrame], body: str | None, keep: str, real: str = "") -> None:
    """Register ``build`` over the views with ``body`` as its SQL; columns ``real`` are rounded on both sides."""
    kept, reals = keep.split(), real.split()

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(Views(spark, sf_dir))
        return df.select(*kept, *[F.round(F.col(c).cast("double"), 6).alias(c) for c in reals])

    sql = None
    if body is not None:
        columns = ", ".join([*kept, *[f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in reals]])
        sql = f"WITH {VIEWS_SQL.strip()}\nSELECT {columns} FROM ({body})"
    registry.register(name, query, sql)
