"""Readers and writers of market tables: fixed schemas, partition pruning, idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CANDLE = "symbol string, timestamp string, open string, high string, low string, close string, volume string"
# Header names that feeds use for the time column.
TIME_ALIASES = ("date", "datetime", "time", "timestamp")


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """CSV candles with a header; all columns text, time column under one name, names in lower case."""
    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    found = [c for c in df.columns if c in TIME_ALIASES]
    if not found:
        raise ValueError(f"no time column in {df.columns}")
    missing = {"open", "high", "low", "close", "volume"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df.withColumnRenamed(found[0], "timestamp")


def extra_columns(df: DataFrame, expected: set[str]) -> list[str]:
    return sorted(set(df.columns) - expected)


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV, JSON lines, or a JSON document by suffix; always with a schema."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).schema(schema).csv(path)
    return spark.read.option("multiLine", not path.endswith(".jsonl")).schema(schema).json(path)


def write_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Replace only the partitions that ``df`` has; one task writes each of them."""
    df.repartition(*by).write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(path)


def scan(spark: SparkSession, path: str, columns: list[str], between: dict[str, tuple] | None = None, **partitions: list) -> DataFrame:
    """Columns of the given partitions, by lists of values and by ranges (either end may be None); the filters are on partition columns, so other files are not read."""
    df = spark.read.parquet(path)
    for c, values in partitions.items():
        df = df.where(F.col(c).isin(values))
    for c, (first, last) in (between or {}).items():
        if first is not None:
            df = df.where(F.col(c) >= F.lit(first))
        if last is not None:
            df = df.where(F.col(c) <= F.lit(last))
    return df.select(*columns)


def fingerprints(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One digest for each partition, independent of row order: counts and sums of row hashes."""
    h = F.xxhash64(*columns)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.bit_xor(h).alias("mixed"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("total"))


def changed_only(df: DataFrame, keys: list[str], columns: list[str], known: DataFrame) -> DataFrame:
    """Rows of the partitions whose fingerprint is not among ``known``."""
    now = fingerprints(df, keys, columns)
    new = now.join(known, [*keys, "n", "mixed", "total"], "left_anti").select(*keys)
    return df.join(new, keys, "left_semi")


def append_missing_days(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def fill_archive(source: DataFrame, archive: DataFrame, keys: list[str], overlap: DataFrame, prices: list[str], at: str = "bar_ts") -> DataFrame:
    """Rows of ``source`` from 09:15 to 15:29 on days that ``archive`` lacks, prices rounded to two digits.

    ``overlap`` is the one row of a reconciliation of both over common days: where its
    drift is true nothing is filled, and that is an error.
    """
    if overlap.first()["drift"]:
        raise ValueError("source and archive drift apart on the days that both have")
    minute = F.hour(at) * 60 + F.minute(at)
    rows = source.where(minute.between(555, 929)).withColumns({c: F.round(c, 2) for c in prices})
    return append_missing_days(rows, archive, keys)


def file_inventory(df: DataFrame, time: str) -> DataFrame:
    """Rows, bounds and an order-free coverage digest of each source file."""
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.count("*").alias("n"), F.min(time).alias("first_ts"), F.max(time).alias("last_ts"), F.bit_xor(F.xxhash64(time)).alias("coverage"),
    )


def date_from_name(file: str = "_metadata.file_name") -> F.Column:
    """Trade date from names like x_02_01_2024.csv or y_20240102.parquet."""
    dmy, ymd = F.regexp_extract(file, r"(\d{2}_\d{2}_\d{4})\.", 1), F.regexp_extract(file, r"(\d{8})\.", 1)
    return F.coalesce(F.try_to_date(dmy, "dd_MM_yyyy"), F.try_to_date(ymd, "yyyyMMdd"))


def candle_arrays(df: DataFrame, column: str) -> DataFrame:
    """JSON arrays [ts, o, h, l, c, v, oi] to typed rows, one for each time."""
    c = F.explode(F.from_json(column, "array<array<string>>")).alias("c")
    names = ["open", "high", "low", "close", "volume", "oi"]
    at = F.get("c", F.lit(0)).try_cast("timestamp_ntz").alias("ts")
    return df.select("*", c).select(*[x for x in df.columns if x != column], at, *[F.get("c", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])
