"""Ranking, selection, splitting and de-duplication of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """First k rows of each key in the given order, with their rank; Spark drops the rest before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def both_sides(df: DataFrame, keys: list[str], long_edge: str, short_edge: str, k: int, floor: float, name: str) -> DataFrame:
    """Top-k longs and shorts by edge; a row that is in both takes the larger edge, long on ties."""
    def rank(edge: str) -> Column:
        ok = F.when(F.col(edge) >= floor, F.col(edge))
        return F.when(ok.isNotNull(), F.row_number().over(Window.partitionBy(*keys).orderBy(ok.desc_nulls_last(), name)))

    df = df.withColumn("__l", F.coalesce(rank(long_edge) <= k, F.lit(False))).withColumn("__s", F.coalesce(rank(short_edge) <= k, F.lit(False)))
    side = F.when(F.col("__l") & F.col("__s"), F.when(F.col(long_edge) >= F.col(short_edge), "LONG").otherwise("SHORT")).when(F.col("__l"), "LONG").when(F.col("__s"), "SHORT").otherwise("NO_TRADE")
    return df.withColumn("action", side).drop("__l", "__s")


def top_bottom_spread(df: DataFrame, date: str, score: str, label: str, k: int, cost_bps: float, name: str) -> DataFrame:
    w = Window.partitionBy(date)
    r = df.withColumn("__top", F.row_number().over(w.orderBy(F.col(score).desc(), name))).withColumn("__low", F.row_number().over(w.orderBy(score, F.col(name).desc()))).withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= 2 * k)
    return r.groupBy(date).agg((F.avg(F.when(F.col("__top") <= k, F.col(label))) - F.avg(F.when(F.col("__low") <= k, F.col(label)))).alias("gross")).withColumn("net", F.col("gross") - 2 * cost_bps)


def by_worst_fold(df: DataFrame, config: str, fold: str, value: str, least: int) -> DataFrame:
    """The config with the best worst fold, then mean, trades, and id."""
    f = df.groupBy(config, fold).agg(F.avg(value).alias("__m"), F.count("*").alias("__n"))
    c = f.groupBy(config).agg(F.min("__m").alias("worst"), F.avg("__m").alias("mean"), F.sum("__n").alias("n")).where(F.col("n") >= least)
    return c.orderBy(F.round("worst", 9).desc(), F.round("mean", 9).desc(), F.col("n").desc(), config).limit(1)


def hashed_sample(df: DataFrame, group: str, n: int, *key: str) -> DataFrame:
    """The n rows of each group with the smallest digest of the key: the same rows in any run."""
    d = F.sha2(F.concat_ws("|", *key), 256)
    return top_k(df.withColumn("digest", d), [group], n, "digest")


def every_nth(df: DataFrame, group: list[str], order: list[str], step: int) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).where(F.col("__i") % step == 0).drop("__i")


def keep_last(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Last row of each key, how many there were, and whether they agreed."""
    o = F.struct(*order)
    return df.groupBy(*keys).agg(F.max_by(value, o).alias(value), F.count("*").alias("n"), (F.count_distinct(value) <= 1).alias("identical"))


def split_overlaps(df: DataFrame, split: str, name: str) -> DataFrame:
    """Names that are in more than one split."""
    return df.groupBy(name).agg(F.count_distinct(split).alias("n_splits"), F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits")).where("n_splits > 1")


def sealed_split(df: DataFrame, date: str, fraction: float) -> DataFrame:
    """Chronological split of days: the last ceil(fraction n) are sealed, at least one and never all."""
    d = df.select(date).distinct()
    w = Window.partitionBy(F.lit(0))
    d = d.withColumn("__r", F.row_number().over(w.orderBy(date))).withColumn("__n", F.count("*").over(w))
    sealed = F.greatest(F.lit(1), F.least(F.ceil(F.col("__n") * fraction), F.col("__n") - 1))
    return d.select(date, F.when(F.col("__r") > F.col("__n") - sealed, "sealed").otherwise("select").alias("split"))


def stratified_split(df: DataFrame, strata: list[str], name: str, shares: list[tuple[str, float]], rest: str, seed: int) -> DataFrame:
    """Splits of each stratum by the rank of a seeded digest, counts rounded."""
    w = Window.partitionBy(*strata)
    r = df.withColumn("__r", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(name).cast("string"))), name))).withColumn("__n", F.count("*").over(w))
    out, start = None, F.lit(0)
    for s, share in shares:
        end = start + F.round(F.col("__n") * share)
        test = (F.col("__r") > start) & (F.col("__r") <= end)
        out = F.when(test, s) if out is None else out.when(test, s)
        start = end
    return r.withColumn("split", out.otherwise(rest)).drop("__r", "__n")


def embargo_folds(df: DataFrame, order: str, n_folds: int, embargo: int) -> DataFrame:
    """Fold tables: validation bounds by position, training up to ``embargo`` seconds before; one row a fold."""
    d = df.select(F.col(order).alias("t")).distinct()
    tiles = d.withColumn("tile", F.ntile(n_folds + 1).over(Window.partitionBy(F.lit(0)).orderBy("t")))
    f = tiles.groupBy("tile").agg(F.min("t").alias("valid_from"), F.max("t").alias("valid_to"), F.count("*").alias("n_valid")).where("tile > 1")
    return f.select((F.col("tile") - 1).cast("long").alias("fold"), "valid_from", "valid_to", "n_valid", (F.col("valid_from") - F.expr(f"interval {embargo} seconds")).alias("train_before"))


def gates(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One boolean for each gate, the reasons of those that fail in order, and the first."""
    reasons = F.filter(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    return df.withColumns({f"gate_{n}": F.coalesce(t, F.lit(False)) for n, t in tests.items()}).withColumn("failed", F.array_join(reasons, ",")).withColumn("first_failed", F.get(reasons, F.lit(0))).withColumn("passed", F.size(reasons) == 0)


def nearest_expiry(df: DataFrame, keys: list[str], expiry: str, volume: str, *tie: str) -> DataFrame:
    """Of the traded contracts of each key, the one that expires first."""
    rest = [c for c in df.columns if c not in keys]
    return df.where(F.col(volume) > 0).groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(expiry, *tie)).alias("r")).select(*keys, "r.*")


def costed_picks(df: DataFrame, keys: list[str], k: int, confidence: str, least: float, gross: Column, cost_bps: float, tie: str) -> DataFrame:
    """The ``k`` most confident rows of each key that are confident enough, with their score after costs."""
    d = top_k(df, keys, k, F.col(confidence).desc(), tie).where(F.col(confidence) >= least)
    return d.withColumn("gross", gross).withColumn("net_score", F.col("gross") - cost_bps / 10_000)


def hit_report(picks: DataFrame, by: list[str]) -> DataFrame:
    """Picks, wins, losses, share of wins, and the sum of net scores."""
    return picks.groupBy(*by).agg(
        F.count("*").alias("picks"), F.count_if(F.col("gross") > 0).alias("wins"), F.count_if(F.col("gross") < 0).alias("losses"),
        F.avg((F.col("gross") > 0).cast("double")).alias("hit_rate"), F.sum("net_score").alias("net_score"),
    )


# Minutes of the day between which entries are made, the pause at noon, and the regime without entries.
ENTRY_FROM, ENTRY_UNTIL, PAUSE, NO_ENTRY = 585, 895, (660, 720), "compression"


def entry_eligible(df: DataFrame, at: str = "bar_ts", regime: str = "regime") -> DataFrame:
    """Rows from half an hour after the open until 14:55, but for 11:00 to 12:00, outside compression; a missing regime is none."""
    minute = F.hour(at) * 60 + F.minute(at)
    pause = (minute >= PAUSE[0]) & (minute < PAUSE[1])
    return df.where((minute >= ENTRY_FROM) & (minute < ENTRY_UNTIL) & ~pause & ~F.coalesce(F.col(regime) == NO_ENTRY, F.lit(False)))


def regime_gate(df: DataFrame, current: Column, allowed: list[str] | None) -> DataFrame:
    """Rows whose current regime is allowed; all where no list is given, none of a missing regime where one is."""
    return df if allowed is None else df.where(F.coalesce(current.isin(allowed), F.lit(False)))


def front_month(df: DataFrame, group: list[str], symbol: str = "symbol") -> DataFrame:
    """Rows of front-month symbols (ending with ``-I``); of a group without any, all rows."""
    front = F.coalesce(F.upper(F.trim(symbol)).endswith("-I"), F.lit(False))
    some = df.where(front).select(*[F.col(g).alias(f"__{g}") for g in group]).distinct()
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    return df.where(front).unionByName(df.where(~front).join(some, on, "left_anti"))
