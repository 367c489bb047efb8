"""Row normalisers and predicates of raw feeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Time formats that feeds use besides ISO.
FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd-MM-yyyy HH:mm:ss",
    "dd-MM-yyyy HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm",
]


def parse_time(text: Column) -> Column:
    """First format that fits; null where none does."""
    t = F.trim(text)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def number(text: Column) -> Column:
    """Number with thousands separators; null where it is none."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def token(symbol: Column) -> Column:
    """Stable id of a symbol: the first twelve hex digits of its digest."""
    return F.conv(F.substring(F.sha2(symbol, 256), 1, 12), 16, 10).cast("long")


def valid_ohlc(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    body = F.least(F.col(o), F.col(c)), F.greatest(F.col(o), F.col(c))
    return (F.least(F.col(o), F.col(h), F.col(lo), F.col(c)) > 0) & (F.col(lo) <= body[0]) & (body[1] <= F.col(h))


def in_session(minute: Column, second: Column, first: int, last: int) -> Column:
    return minute.between(first, last) & (second == 0)


def first_reason(tests: dict[str, Column]) -> Column:
    """Name of the first test that holds, null where none does."""
    out = None
    for name, test in tests.items():
        t = F.coalesce(test, F.lit(True))
        out = F.when(t, name) if out is None else out.when(t, name)
    return out


def reasons(tests: dict[str, Column]) -> Column:
    """Names of all tests that hold, in order."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def route(df: DataFrame, tests: dict[str, Column], keys: list[str], order: str) -> DataFrame:
    """Every row with its reject_reason: the first failing test, then a repeated key (the lowest source row stays)."""
    df = df.withColumn("reject_reason", first_reason(tests))
    w = Window.partitionBy(*keys, F.col("reject_reason").isNull()).orderBy(order)
    return df.withColumn("__n", F.row_number().over(w)).withColumn("reject_reason", F.when(F.col("reject_reason").isNull() & (F.col("__n") > 1), "duplicate_timestamp").otherwise(F.col("reject_reason"))).drop("__n")


def keyword_class(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Class of the first rule whose pattern is in the text."""
    t, out = F.lower(text), None
    for name, pattern in rules:
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out.otherwise(other)


def ladder(value: Column, steps: list[tuple[float, str]], low: str, unknown: str) -> Column:
    out = F.when(value.isNull(), unknown)
    for at, name in steps:
        out = out.when(value >= at, name)
    return out.otherwise(low)


def runs_of_equal(df: DataFrame, keys: list[str], order: str, value: str, least: int) -> DataFrame:
    """Stretches of at least ``least`` equal values in a row."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("__new", F.when(F.col(value) == F.lag(value).over(w), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__run").agg(F.count("*").alias("n"), F.min(order).alias("from_ts"), F.max(order).alias("to_ts"), F.first(value).alias(value)).where(F.col("n") >= least).drop("__run")


def robust_outliers(df: DataFrame, keys: list[str], order: str, price: str, limit: float = 8.0, flat: float = 0.05, least: int = 5) -> DataFrame:
    """Return far from the key's median in units of the scaled median deviation; both medians are aggregates joined back."""
    w = Window.partitionBy(*keys).orderBy(order)
    r = df.withColumn("ret", F.when(F.lag(price).over(w) != 0, F.col(price) / F.lag(price).over(w) - 1))
    m = r.groupBy(*keys).agg(F.percentile("ret", 0.5).alias("med"), F.count("ret").alias("n_ret"))
    d = r.join(m, keys).withColumn("dev", F.abs(F.col("ret") - F.col("med")))
    mad = d.groupBy(*keys).agg(F.percentile("dev", 0.5).alias("mad"))
    out = d.join(mad, keys)
    far = F.when(F.col("mad") > 0, F.col("dev") / (1.4826 * F.col("mad")) > limit).otherwise(F.abs("ret") > flat)
    return out.withColumn("outlier", F.coalesce((F.col("n_ret") >= least) & far, F.lit(False)))
