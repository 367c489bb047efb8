"""Economic, classification and activity metrics over tables of trades and scores.

All are grouped: one pass of partial aggregation per key.  Drawdowns and streaks
need an order and use windows partitioned by the candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = math.sqrt(252)


def net(df: DataFrame, cost_bps: float, gross: str = "gross_bps") -> DataFrame:
    """Reprice preserved gross outcomes; labels stay as they are."""
    return df.withColumn("net_bps", F.col(gross) - F.lit(cost_bps))


def sharpe_of(v: Column) -> Column:
    sd = F.stddev_samp(v)
    return F.when((F.count(v) >= 2) & (sd > 0), F.avg(v) / sd * YEAR).otherwise(0.0)


def sortino_of(v: Column) -> Column:
    down = F.sqrt(F.avg(F.pow(F.least(v, F.lit(0.0)), F.lit(2))))
    return F.when(down > 0, F.avg(v) / down * YEAR).otherwise(0.0)


def profit_factor(v: Column) -> Column:
    """Gross profit over gross loss; the gross profit itself where there is no loss."""
    win, loss = F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)), F.coalesce(F.sum(F.when(v < 0, -v)), F.lit(0.0))
    return F.when(loss > 0, win / loss).otherwise(win)


def drawdown(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Largest fall of the running sum below its peak, the peak starting at 0.

    The rows of a key and first column of ``order`` (a day) are a stretch: its sum, highest
    and lowest running sum, and largest fall within.  A key's stretches then meet in order.
    """
    day, rest = order[0], order[1:] or order
    w = Window.partitionBy(*keys, day).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    e = df.select(*dict.fromkeys([*keys, *order, value])).withColumn("__equity", F.sum(value).over(w)).withColumn("__peak", F.max("__equity").over(w))
    # A sum over nulls alone is null and has no peak or fall; it counts as nothing in the stretches after.
    s = e.groupBy(*keys, day).agg(F.sum(value).alias("__sum"), F.max("__equity").alias("__high"), F.min("__equity").alias("__low"), F.min(F.col("__equity") - F.col("__peak")).alias("__fall"))
    w = Window.partitionBy(*keys).orderBy(day)
    s = s.withColumn("__before", F.coalesce(F.sum("__sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    peak = F.coalesce(F.max(F.col("__before") + F.col("__high")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("__peak", F.greatest(F.lit(0.0), peak))
    return s.groupBy(*keys).agg(F.least(F.lit(0.0), F.min("__fall"), F.min(F.col("__before") + F.col("__low") - F.col("__peak"))).alias("max_drawdown"))


def economic_metrics(df: DataFrame, keys: list[str], value: str = "net_bps", date: str = "date", order: tuple = ("date", "order_key", "line")) -> DataFrame:
    v = F.col(value)
    wins, losses = F.count_if(v > 0), F.count_if(v < 0)
    main = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(v).alias("expectancy"), (wins / F.count("*")).alias("hit_rate"),
        F.when((wins > 0) & (losses > 0), F.avg(F.when(v > 0, v)) / F.avg(F.when(v < 0, -v))).otherwise(0.0).alias("payoff"), profit_factor(v).alias("profit_factor"),
    )
    days = df.groupBy(*keys, date).agg(F.sum(v).alias("day"))
    daily = days.groupBy(*keys).agg(sharpe_of(F.col("day")).alias("daily_sharpe"), sortino_of(F.col("day")).alias("daily_sortino"))
    return main.join(drawdown(df, keys, value, list(order)), keys).join(daily, keys)


def contribution(df: DataFrame, key: str, value: str = "net_bps") -> DataFrame:
    by = df.groupBy(key).agg(F.sum(value).alias("total"))
    return by.withColumn("share", F.coalesce(F.try_divide(F.abs("total"), F.abs(F.sum("total").over(Window.partitionBy()))), F.lit(0.0)))


def concentration(df: DataFrame, group: list[str], name: str) -> DataFrame:
    """Distinct names and the largest share of rows that one name has."""
    by = df.groupBy(*group, name).agg(F.count("*").alias("n"))
    return by.groupBy(*group).agg(F.count("*").alias("distinct_names"), (F.max("n") / F.sum("n")).alias("max_share"), F.sum("n").alias("n"))


def outcome_table(df: DataFrame, keys: list[str], outcome: str, value: str, kinds: list[str]) -> DataFrame:
    """Counts and mean returns for each outcome."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("ev"), profit_factor(F.col(value)).alias("pf"),
        *[F.count_if(F.col(outcome) == k).alias(f"n_{k}") for k in kinds], *[F.avg(F.when(F.col(outcome) == k, F.col(value))).alias(f"ev_{k}") for k in kinds],
    )


def folds(df: DataFrame, keys: list[str], value: str, date: str = "date", bucket: int = 5) -> DataFrame:
    """By year, and by runs of ``bucket`` trading days of the key."""
    df = df.select(*keys, date, value)
    days = df.select(*keys, date).distinct().withColumn("fold", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1) / bucket))
    weekly = df.join(days, [*keys, date]).groupBy(*keys, "fold").agg(F.count("*").alias("n"), F.avg(value).alias("ev")).withColumn("kind", F.lit("bucket"))
    yearly = df.groupBy(*keys, F.year(date).cast("long").alias("fold")).agg(F.count("*").alias("n"), F.avg(value).alias("ev")).withColumn("kind", F.lit("year"))
    return weekly.unionByName(yearly)


def _day_sums(df: DataFrame, keys: list[str], value: str, date: str) -> DataFrame:
    """One row a key and day, numbered from 0: what fold tables are made of; rows without one have no fold."""
    for c in (*keys, date):
        df = df.where(F.col(c).isNotNull())
    by_day = df.groupBy(*keys, date).agg(F.count("*").alias("n"), F.count_if(F.col(value) > 0).alias("wins"), F.count_if(F.col(value) < 0).alias("losses"), F.sum(value).alias("total"), F.count(value).alias("__n"))
    return by_day.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(date)) - 1)


def _kinds(date: str, bucket: int) -> dict[str, Column]:
    return {"bucket": F.floor(F.col("__r") / bucket).cast("string"), "day": F.col(date).cast("string"), "year": F.year(date).cast("string")}


def _folded(days: DataFrame, keys: list[str]) -> DataFrame:
    return days.groupBy(*keys, "kind", "fold").agg(
        F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.sum("losses").alias("losses"), F.try_divide(F.sum("total"), F.sum("__n")).alias("ev"), F.sum("total").alias("total"), F.count("*").alias("days"),
    )


def fold_tables(df: DataFrame, keys: list[str], value: str, date: str = "date", bucket: int = 5) -> DataFrame:
    """By run of ``bucket`` trading days, by day and by year: kind, fold, n, wins, losses, ev, total, days of each key."""
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("fold")) for k, f in _kinds(date, bucket).items()]))
    return _folded(_day_sums(df, keys, value, date).withColumn("__f", every).select("*", "__f.*"), keys)


def selection_folds(df: DataFrame, keys: list[str], value: str, date: str = "date", bucket: int = 5) -> DataFrame:
    """Of ``fold_tables`` the folds by which a key is chosen: the first kind of bucket, day and year that has two folds or more, else those by year.

    The number of a key's days says which kind that is, so that only its folds are made.
    """
    n = F.count("*").over(Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kind = F.when(n > bucket, "bucket").when(n >= 2, "day").otherwise("year")
    days = _day_sums(df, keys, value, date).withColumn("kind", kind)
    fold = F.coalesce(*[F.when(F.col("kind") == k, f) for k, f in _kinds(date, bucket).items()])
    return _folded(days.withColumn("fold", fold), keys)


def candidate_summary(df: DataFrame, key: str, value: str, fold: str = "fold", least: int = 1) -> DataFrame:
    by = df.groupBy(key, fold).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    return by.groupBy(key).agg(F.sum("n").alias("n"), F.min(F.col("s") / F.col("n")).alias("worst_fold"), F.avg((F.col("s") > 0).cast("double")).alias("positive_folds"), (F.sum("s") / F.sum("n")).alias("ev"))


def cost_scenarios(df: DataFrame, keys: list[str], gross: str, costs: list[float], target: float, stop: float) -> DataFrame:
    """Every key under each cost; the scenarios are a handful of rows."""
    c = df.sparkSession.createDataFrame([(float(x),) for x in costs], "cost double")
    v = F.col("v")
    return (
        df.crossJoin(F.broadcast(c)).withColumn("v", F.col(gross) - F.col("cost")).groupBy(*keys, "cost")
        .agg(F.count("*").alias("n"), F.avg(v).alias("ev"), profit_factor(v).alias("pf"), F.avg((v > 0).cast("double")).alias("hit_rate"))
        .withColumn("breakeven", (stop + F.col("cost")) / (target + stop))
    )


def fill_rates(df: DataFrame, keys: list[str], ratio: str, vol: str) -> DataFrame:
    liquid = F.col(ratio) >= 0.75
    calm = liquid & (F.col(vol) <= 0.5)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(liquid).alias("liquid"), F.count_if(calm).alias("liquid_low_vol"), (F.count_if(liquid) / F.count("*")).alias("fill_rate"), F.count_if(~F.coalesce(liquid, F.lit(False))).alias("missed"))


def breakdowns(df: DataFrame, dims: list[str], value: str) -> DataFrame:
    """One table of all one-way groupings, by grouping sets: one shuffle."""
    sets = [[F.col(d)] for d in dims]
    g = df.groupingSets(sets, *dims).agg(F.count("*").alias("n"), F.avg(value).alias("ev"), *[F.grouping(d).alias(f"__g_{d}") for d in dims])
    dim = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.lit(d)) for d in dims])
    level = F.coalesce(*[F.when(F.col(f"__g_{d}") == 0, F.col(d).cast("string")) for d in dims])
    return g.select(dim.alias("dim"), level.alias("level"), "n", "ev")


def distribution(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Values at index floor(q (n - 1)) of the sorted list, by counts of equal values: a task has a key's distinct values, not its rows.

    Where nearly all values differ, ``ranks.at_ranks`` is the way.  Nulls come first, as in a sort.  ``order`` only orders rows of equal values, which changes no result.
    """
    w = Window.partitionBy(*keys)
    at_most = F.sum("__m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    r = df.groupBy(*keys, value).agg(F.count("*").alias("__m")).withColumn("__to", at_most).withColumn("__n", F.sum("__m").over(w))
    index = lambda q: F.floor(F.lit(q) * (F.col("__n") - 1))
    at = lambda q: F.max(F.when((index(q) < F.col("__to")) & (index(q) >= F.col("__to") - F.col("__m")), F.col(value)))
    return r.groupBy(*keys).agg(*[at(q).alias(n) for q, n in ((0.0, "lowest"), (0.05, "p05"), (0.5, "median"), (0.95, "p95"), (1.0, "highest"))])


def streaks(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Longest runs of wins and losses; zero breaks both."""
    w = Window.partitionBy(*keys).orderBy(*order)
    s = df.withColumn("__s", F.signum(value)).withColumn("__new", F.when(F.col("__s") == F.lag("__s").over(w), 0).otherwise(1)).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = s.groupBy(*keys, "__run").agg(F.first("__s").alias("__s"), F.count("*").alias("__n"))
    best = lambda sign: F.coalesce(F.max(F.when(F.col("__s") == sign, F.col("__n"))), F.lit(0))
    return runs.groupBy(*keys).agg(best(1).alias("win_streak"), best(-1).alias("loss_streak"))


def binary_scores(df: DataFrame, keys: list[str], p: str, y: str, threshold: float = 0.5) -> DataFrame:
    hit = F.col(p) >= threshold
    tp, fp, fn = F.count_if(hit & (F.col(y) == 1)), F.count_if(hit & (F.col(y) == 0)), F.count_if(~hit & (F.col(y) == 1))
    out = df.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.count("*").alias("n"))
    return out.withColumn("precision", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )


def calibration(df: DataFrame, keys: list[str], p: str, y: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error over ``bins`` bins, the last one closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("__b")
    by = df.groupBy(*keys, b).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("sq"))
    return by.groupBy(*keys).agg((F.sum("sq") / F.sum("n")).alias("brier"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def by_side(df: DataFrame, side: str, value: str, name: str) -> DataFrame:
    """Scored actions by side, with a total row."""
    return df.rollup(side).agg(F.count("*").alias("n"), F.avg(value).alias("ev"), F.count_distinct(name).alias("names"), F.grouping(side).cast("long").alias("is_total")).withColumn(side, F.when(F.col("is_total") == 1, "all").otherwise(F.col(side)))


def drift(live: DataFrame, reference: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    def long(df: DataFrame, suffix: str) -> DataFrame:
        stack = ", ".join(f"'{c}', cast({c} as double)" for c in columns)
        return df.selectExpr(f"stack({len(columns)}, {stack}) as (feature, v)").groupBy("feature").agg(F.avg("v").alias(f"mean_{suffix}"), F.stddev_pop("v").alias(f"sd_{suffix}"))

    z = F.coalesce(F.try_divide(F.abs(F.col("mean_live") - F.col("mean_ref")), F.col("sd_ref")), F.lit(0.0))
    return long(live, "live").join(long(reference, "ref"), "feature").withColumn("z", z).withColumn("alert", F.col("z") >= limit)


def rank_ic(df: DataFrame, date: str, score: str, label: str) -> DataFrame:
    """Pearson correlation of average ranks within a date."""
    w = Window.partitionBy(date)

    def average_rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(date, c)) - 1) / 2

    r = df.withColumn("__a", average_rank(score)).withColumn("__b", average_rank(label))
    return r.groupBy(date).agg(F.count("*").alias("n"), F.corr("__a", "__b").alias("ic"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in columns])
    return one.selectExpr("stack({}, {}) as (feature, rate)".format(len(columns), ", ".join(f"'{c}', {c}" for c in columns)))


def feature_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    one = df.agg(*[F.struct((F.count(c) / n).alias("present"), (F.count_if(F.col(c) != 0) / n).alias("nonzero")).alias(c) for c in columns])
    return one.selectExpr("stack({}, {}) as (feature, s)".format(len(columns), ", ".join(f"'{c}', {c}" for c in columns))).select("feature", F.col("s.present").alias("present"), F.col("s.nonzero").alias("nonzero"), (F.col("s.present") >= 0.95).alias("eligible"))


def halts(df: DataFrame, keys: list[str], value: str, order: list[str], capital: float, limit: float, days: int = 3) -> DataFrame:
    """Drawdown halt on the capital, and whether the last ``days`` rows all lost."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    last = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= days).groupBy(*keys).agg((F.count("*") == days).alias("__full"), F.bool_and(F.col(value) < 0).alias("__lost"))
    d = drawdown(df, keys, value, order).withColumn("halted", F.col("max_drawdown") <= -limit * capital)
    return d.join(last, keys).withColumn("loss_streak", F.col("__full") & F.col("__lost"))


def activity_band(df: DataFrame, series: str, date: str, count: str, window: int, least: int) -> DataFrame:
    """Floor and ceiling of the 0.5 and 99.5 percentiles of rolling sums; windows never cross series."""
    w = Window.partitionBy(series).orderBy(date).rowsBetween(-(window - 1), 0)
    sums = df.withColumn("__n", F.count("*").over(w)).withColumn("s", F.sum(count).over(w)).where(F.col("__n") == window)
    return sums.agg(F.floor(F.percentile("s", 0.005)).alias("low"), F.ceil(F.percentile("s", 0.995)).alias("high"), F.count("*").alias("n_windows")).withColumn("enough", F.col("n_windows") >= least)


def paired_test(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"))
    se = F.col("sd") / F.sqrt(F.col("n"))
    return out.withColumn("t_stat", F.when(se > 0, F.col("mean_diff") / se).otherwise(0.0)).withColumn("ci_low", F.col("mean_diff") - 1.96 * se).withColumn("ci_high", F.col("mean_diff") + 1.96 * se)


def wilson(df: DataFrame, keys: list[str], hit: Column, z: float = 1.959963984540054) -> DataFrame:
    o = df.groupBy(*keys).agg(F.count_if(hit).alias("hits"), F.count("*").alias("n")).withColumn("p", F.col("hits") / F.col("n"))
    den = 1 + z * z / F.col("n")
    mid = (F.col("p") + z * z / (2 * F.col("n"))) / den
    half = z * F.sqrt((F.col("p") * (1 - F.col("p")) + z * z / (4 * F.col("n"))) / F.col("n")) / den
    return o.withColumn("low", F.greatest(F.lit(0.0), mid - half)).withColumn("high", F.least(F.lit(1.0), mid + half))


#: Resampled statistics of drawn days: ``s`` is a day's sum, ``n`` its rows.
BOOTSTRAPS = {
    "pooled": lambda: F.sum("s") / F.sum("n"),
    "mean": lambda: F.avg("s"),
    "sharpe": lambda: F.when(F.stddev_samp("s") > 0, F.avg("s") / F.stddev_samp("s") * (252**0.5)).otherwise(0.0),
}


def bootstrap(df: DataFrame, keys: list[str], date: str, value: str, samples: int, confidence: float, statistic: str = "pooled", moving_block: bool = False, seed: int = 42) -> DataFrame:
    """Interval of a statistic of days (see BOOTSTRAPS) when days are drawn with replacement.

    Each (replicate, slot) draws a day by its own part of a SHA-256 digest, so draws are independent and reruns agree.
    With ``moving_block`` runs of floor(sqrt(days)) neighbouring days are drawn.  Replicates are joined to one row a day,
    so only sums move.
    """
    w = Window.partitionBy(*keys)
    days = df.groupBy(*keys, date).agg(F.sum(value).alias("s"), F.count("*").alias("n")).withColumn("i", F.row_number().over(w.orderBy(date)).cast("long") - 1).withColumn("days", F.count("*").over(w))
    block = F.floor(F.sqrt("days")) if moving_block else F.lit(1).cast("long")
    reps = days.select(*keys, F.col("i").alias("slot"), "days", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("rep"))
    name = F.concat_ws(",", F.lit(seed), "rep", F.floor(F.col("slot") / F.col("block")))
    start = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % (F.col("days") - F.col("block") + 1)
    drawn = reps.withColumn("i", start + F.col("slot") % F.col("block")).join(days.select(*keys, "i", "s", "n"), [*keys, "i"]).groupBy(*keys, "rep").agg(BOOTSTRAPS[statistic]().alias("mean"))
    r = drawn.withColumn("k", F.row_number().over(w.orderBy("mean", "rep")) - 1)
    low, high = int((1 - confidence) / 2 * (samples - 1)), int((1 - (1 - confidence) / 2) * (samples - 1))
    return r.groupBy(*keys).agg(F.max(F.when(F.col("k") == low, F.col("mean"))).alias("ci_low"), F.max(F.when(F.col("k") == high, F.col("mean"))).alias("ci_high"))


def confusion(df: DataFrame, keys: list[str], actual: str, predicted: str, classes: list) -> DataFrame:
    """For each class: its row of the confusion matrix (as_<class>), precision, recall and F1, and their means over the classes.

    A class without predictions or without rows has precision or recall 0; balanced accuracy is the mean recall.
    """
    n = df.groupBy(*keys, F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    every = df.select(*keys).distinct().withColumn("class", F.explode(F.array(*[F.lit(c) for c in classes])))
    counts = n.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when((F.col("a") == a) & (F.col("p") == p), F.col("n"))), F.lit(0)).alias(f"n_{i}_{j}") for i, a in enumerate(classes) for j, p in enumerate(classes)
    ])
    out = every.join(counts, keys)
    k = range(len(classes))

    def of_class(values: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.col("class") == c, v) for c, v in zip(classes, values, strict=True)])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    row = [sum((F.col(f"n_{i}_{j}") for j in k), F.lit(0)) for i in k]
    col = [sum((F.col(f"n_{i}_{j}") for i in k), F.lit(0)) for j in k]
    precision = [ratio(F.col(f"n_{i}_{i}"), col[i]) for i in k]
    recall = [ratio(F.col(f"n_{i}_{i}"), row[i]) for i in k]
    f1 = [ratio(2 * p * r, p + r) for p, r in zip(precision, recall, strict=True)]
    mean = {f"macro_{n}": sum(v, F.lit(0.0)) / len(classes) for n, v in (("precision", precision), ("recall", recall), ("f1", f1))}
    return out.select(
        *keys, "class", *[of_class([F.col(f"n_{i}_{j}") for i in k]).alias(f"as_{j}") for j in k],
        of_class(precision).alias("precision"), of_class(recall).alias("recall"), of_class(f1).alias("f1"), *[v.alias(n) for n, v in mean.items()],
    )


def trade_summary(df: DataFrame, keys: list[str], reason: str, value: str, date: str) -> DataFrame:
    """keys, metric, value: trades, net, annual Sharpe of daily sums, and ``exit_`` counts by reason; a missing value counts as 0."""
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    days = df.groupBy(*keys, date, F.coalesce(F.col(reason), F.lit("unknown")).alias("__reason")).agg(F.count("*").alias("n"), F.sum(v).alias("s"))
    exits = days.groupBy(*keys, F.concat(F.lit("exit_"), "__reason").alias("metric")).agg(F.sum("n").cast("double").alias("value"))
    by_day = days.groupBy(*keys, date).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = by_day.groupBy(*keys).agg(F.sum("n").cast("double").alias("trades"), F.sum("s").alias("net"), sharpe_of(F.col("s")).alias("daily_sharpe"))
    return whole.unpivot(list(keys), ["trades", "net", "daily_sharpe"], "metric", "value").unionByName(exits)


# How far a summary may be off its reference, as a share.
TOLERANCES = {"trades": 0.01, "net": 0.01, "exit_": 0.02}


def summary_deltas(actual: DataFrame, reference: DataFrame, keys: list[str], tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """Two tables of ``trade_summary`` side by side: actual, reference, delta, relative (to the reference; infinite where only that is 0) and passed.

    A metric that one side lacks counts as 0 there.  A metric whose name begins with
    none of ``tolerances`` is not tested: its passed is null.
    """
    on = [*keys, "metric"]
    j = actual.select(*on, F.col("value").alias("a")).join(reference.select(*on, F.col("value").alias("b")), on, "full_outer")
    j = j.select(*on, F.coalesce("a", F.lit(0.0)).alias("actual"), F.coalesce("b", F.lit(0.0)).alias("reference")).withColumn("delta", F.col("actual") - F.col("reference"))
    relative = F.when(F.col("reference") != 0, F.try_divide(F.col("delta"), F.col("reference"))).when(F.col("actual") == 0, 0.0).otherwise(float("inf"))
    limit = F.coalesce(*[F.when(F.startswith("metric", F.lit(n)), F.lit(t)) for n, t in tolerances.items()])
    return j.withColumn("relative", relative).withColumn("passed", F.abs("relative") <= limit)
