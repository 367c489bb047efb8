"""Transaction costs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slippage in bps by liquidity bucket.
SLIPPAGE_BPS = {"large": 3.0, "liquid": 5.0, "medium": 8.0, "small": 12.0, "illiquid": 20.0, "unknown": 8.0}

# Charges of an equity order as shares of its notional, and the brokerage cap.
BROKERAGE, BROKERAGE_CAP, EXCHANGE, SEBI, GST = 0.0005, 20.0, 0.0000322, 0.000001, 0.18
STT_SELL = {"delivery": 0.001, "intraday": 0.00025}
STAMP_BUY = {"delivery": 0.00015, "intraday": 0.00003}

# First day, lot size, sell-side transaction tax in percent, exchange charge per lakh.
ERAS = [
    ("2020-01-01", 75, 0.01, 1.88),
    ("2020-07-01", 75, 0.01, 1.88),
    ("2021-07-01", 50, 0.01, 1.88),
    ("2023-04-01", 50, 0.0125, 1.88),
    ("2024-07-01", 25, 0.0125, 1.88),
    ("2024-10-01", 25, 0.02, 1.73),
    ("2025-02-01", 75, 0.02, 1.73),
    ("2026-01-01", 65, 0.02, 1.73),
    ("2026-04-01", 65, 0.05, 1.73),
]
ERA_BROKERAGE, ERA_SEBI_PER_CRORE, ERA_STAMP_PCT, ERA_GST_PCT = 20.0, 10.0, 0.002, 18.0


def era_table(spark: SparkSession) -> DataFrame:
    """One row an era: effective_date, lot_size, stt_pct, txn_per_lakh."""
    return spark.createDataFrame(ERAS, "d string, lot_size long, stt_pct double, txn_per_lakh double").select(F.to_date("d").alias("effective_date"), "lot_size", "stt_pct", "txn_per_lakh")


def _by(table: dict[str, float], key: Column, other: float) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(other))


def equity_side(notional: Column, side: str, product: Column, bucket: Column) -> Column:
    """Cost in currency of one order."""
    brokerage = F.least(notional * BROKERAGE, F.lit(BROKERAGE_CAP))
    stt = _by(STT_SELL, product, 0.0) if side == "sell" else F.lit(0.0)
    stamp = _by(STAMP_BUY, product, 0.0) if side == "buy" else F.lit(0.0)
    slip = _by(SLIPPAGE_BPS, F.lower(bucket), SLIPPAGE_BPS["unknown"]) / 10_000
    return brokerage + notional * (stt + stamp + EXCHANGE + SEBI + slip) + (brokerage + notional * EXCHANGE) * GST


def equity_round_trip(entry: Column, exit_: Column, product: Column, bucket: Column) -> Column:
    """struct(total, total_bps): both orders, in bps of the entry."""
    total = equity_side(entry, "buy", product, bucket) + equity_side(exit_, "sell", product, bucket)
    return F.struct(total.alias("total"), (total / F.when(entry != 0, entry).otherwise(F.lit(1.0)) * 10_000).alias("total_bps"))


def futures_round_trip_bps(notional: Column, slippage_bps: float = 1.0) -> Column:
    """Round trip in bps of one side's notional."""
    bps = lambda x: notional * x / 10_000
    fees = F.lit(40.0) + bps(2 * 0.173)
    return (fees * 1.18 + bps(2.0) + bps(2 * 0.01) + bps(0.2)) / notional * 10_000 + 2 * slippage_bps


def era_cost(entry: Column, exit_: Column, slippage_bps: float = 0.0) -> Column:
    """Cost in currency under the era columns joined to the row."""
    txn = (entry + exit_) * F.col("txn_per_lakh") / 100_000
    sebi = (entry + exit_) * ERA_SEBI_PER_CRORE / 10_000_000
    gst = (2 * ERA_BROKERAGE + txn + sebi) * ERA_GST_PCT / 100
    return 2 * ERA_BROKERAGE + txn + sebi + entry * ERA_STAMP_PCT / 100 + exit_ * F.col("stt_pct") / 100 + gst + (entry + exit_) / 2 * slippage_bps / 10_000


def position_size(capital: Column, price: Column, risk: float, confidence: Column, adv: Column, share: float) -> Column:
    """Whole units, capped by participation in the average daily value; never negative."""
    by_risk = F.floor(capital * risk * confidence / price)
    return F.when(price > 0, F.greatest(F.lit(0), F.least(by_risk, F.floor(adv * share / price)))).otherwise(0)


def logistic(x: Column, slope: float = 20.0) -> Column:
    return 1 / (1 + F.exp(-slope * x))


def stable_probability(*key: Column | str) -> Column:
    """First eight hex digits of a digest over 0xFFFFFFFF."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *key), 256), 1, 8), 16, 10).cast("double") / 4294967295


def row_digest(*columns: str) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def set_digest(df: DataFrame, digest: str, keys: list[str]) -> DataFrame:
    """Order-free digest of a group's row digests: a sum of their leading digits, so that no group is collected."""
    head = F.conv(F.substring(digest, 1, 12), 16, 10).cast("decimal(20,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.pmod(F.sum(head), F.lit(1 << 48)).cast("long").alias("set_digest"))


def month_chunks(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each calendar month of the range, cut to it."""
    m = F.explode(F.sequence(F.trunc(first, "month"), F.trunc(last, "month"), F.expr("interval 1 month"))).alias("month")
    return df.select("*", m).withColumn("chunk_from", F.greatest(F.col(first), F.col("month"))).withColumn("chunk_to", F.least(F.col(last), F.last_day("month")))


def day_chunks(df: DataFrame, first: str, last: str, days: int = 30) -> DataFrame:
    """One row for each run of ``days`` days of the range from its first day on, the last one cut to it."""
    starts = F.explode(F.sequence(F.lit(0), F.floor(F.datediff(last, first) / days).cast("int"))).alias("chunk")
    at = F.date_add(first, F.col("chunk") * days)
    return df.where(F.col(first) <= F.col(last)).select("*", starts).withColumn("chunk_from", at).withColumn("chunk_to", F.least(F.col(last), F.date_add(at, days - 1)))
