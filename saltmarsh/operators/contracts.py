"""Contract calendars against what was recorded: ladders, rolls, expiries, absent weekdays, day files and option surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NAMES = ("front", "next", "third")
# Bars that stand for a day's end, best first.
LAST_BARS = ("15:30:00", "15:29:00")


def contract_ladder(rows: DataFrame, day: str, expiry: str, ident: str, values: list[str], keys: list[str] = ()) -> DataFrame:
    """One row a day: the three nearest contracts not yet expired as front, next and third, each with id, expiry and ``values``.

    Order is by expiry, then id; of a contract's repeated rows the one with the least
    values is taken.  A contract that expires on the day is its front.
    """
    on = [*keys, day]
    one = rows.where(F.col(expiry) >= F.col(day)).groupBy(*on, expiry, ident).agg(F.min(F.struct(*values)).alias("__v"))
    r = one.withColumn("__r", F.row_number().over(Window.partitionBy(*on).orderBy(expiry, ident))).where("__r <= 3")
    pick = lambda i, c, n: F.max(F.when(F.col("__r") == i + 1, c)).alias(n)
    return r.groupBy(*on).agg(*[a for i, n in enumerate(NAMES) for a in (pick(i, F.col(ident), f"{n}_id"), pick(i, F.col(expiry), f"{n}_expiry"), *[pick(i, F.col(f"__v.{v}"), f"{n}_{v}") for v in values])])


def last_bars(bars: DataFrame, keys: list[str], at: str = "bar_ts") -> DataFrame:
    """One row a key and day: time, close and oi of the bar at 15:30, else at 15:29, else of the last one."""
    time = F.date_format(at, "HH:mm:ss")
    best = F.struct((time == LAST_BARS[0]).alias("a"), (time == LAST_BARS[1]).alias("b"), F.col(at).alias("t"))
    return bars.where(F.col(at).isNotNull()).groupBy(*keys, F.to_date(at).alias("trade_date")).agg(F.max_by(F.struct(time.alias("bar_time"), F.col("close").alias("bar_close"), F.col("oi").alias("bar_oi")), best).alias("__b")).select(*keys, "trade_date", "__b.*")


def _nearest(value: str, kind: str) -> Column:
    """Name of the contract of the ladder nearest to ``value`` by ``kind``; of equal ones the nearer expiry."""
    options = F.array(*[F.struct(F.abs(F.col(value) - F.col(f"{n}_{kind}")).alias("gap"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(NAMES)])
    return F.array_min(F.filter(options, lambda x: x["gap"].isNotNull()))["name"]


def roll_evidence(ladder: DataFrame, bars: DataFrame, keys: list[str] = (), at: str = "bar_ts") -> DataFrame:
    """For each expiry in the ladder's days, and the session after it: the contract nearest to the day's last bar by close and by open interest.

    ``ladder`` has keys, trade_date and the columns of ``contract_ladder`` for close and
    oi; the session after is the next trade_date of the ladder.  The expiring contract
    is expected on its expiry day, the next one (which the ladder then calls front) on
    the day after.  verdict: missing_bars, unusable (no close to compare), PASS or FAIL
    by close.
    """
    keys = list(keys)
    follow = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("trade_date")  # one row a day
    days = ladder.withColumn("__before", F.lag(F.struct("trade_date", "front_expiry")).over(follow)).withColumn("__last", F.lead("trade_date").over(follow).isNull())
    on_day = F.when((F.col("front_expiry") == F.col("trade_date")) & ~F.col("__last"), F.struct(F.lit("expiry_day").alias("role"), F.col("trade_date").alias("expiry")))
    after = F.when(F.col("__before.front_expiry") == F.col("__before.trade_date"), F.struct(F.lit("day_after").alias("role"), F.col("__before.trade_date").alias("expiry")))
    wanted = days.withColumn("__e", F.explode(F.filter(F.array(on_day, after), lambda x: x.isNotNull())))
    met = wanted.join(last_bars(bars, keys, at), [*keys, "trade_date"], "left")
    by_close, by_oi = _nearest("bar_close", "close"), _nearest("bar_oi", "oi")
    verdict = F.when(F.col("bar_time").isNull(), "missing_bars").when(by_close.isNull(), "unusable").when(by_close == "front", "PASS").otherwise("FAIL")
    return met.select(*keys, F.col("__e.expiry").alias("expiry"), F.col("__e.role").alias("role"), "trade_date", "bar_time", "bar_close", "bar_oi", by_close.alias("by_close"), by_oi.alias("by_oi"), verdict.alias("verdict"))


def expiry_sources(rows: DataFrame, day: str, expiry: str, ident: str, source: str, native: str) -> DataFrame:
    """One row an expiry: weekday (0 is Monday), first and last day, ids and sources joined with ``;``, and the weekday before where it changes.

    Ids are those of the ``native`` source where it has any, else all; both lists go by
    source, then id, with one entry for each pair.  An expiry has few contracts, so the
    sets are small at any size.
    """
    t = rows.groupBy(expiry).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.array_sort(F.collect_set(F.struct(F.col(source).alias("s"), F.col(ident).cast("string").alias("i")))).alias("__c"))
    own = F.filter("__c", lambda x: x["s"] == native)
    ids = F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("__c")), lambda x: x["i"])
    t = t.select(expiry, F.weekday(expiry).cast("long").alias("weekday"), "first_day", "last_day", F.array_join(ids, ";").alias("ids"), F.array_join(F.transform("__c", lambda x: x["s"]), ";").alias("sources"))
    before = F.lag("weekday").over(Window.partitionBy(F.lit(0)).orderBy(expiry))  # one row an expiry
    return t.withColumn("weekday_before", F.when(before != F.col("weekday"), before))


def expiry_weekdays(expiries: DataFrame, expiry: str) -> DataFrame:
    """Expiries by month and weekday."""
    return expiries.groupBy(F.trunc(expiry, "month").alias("month"), F.weekday(expiry).cast("long").alias("weekday")).agg(F.count("*").alias("n"))


def moved_ids(rows: DataFrame, ident: str, expiry: str) -> DataFrame:
    """Ids with more than one expiry."""
    return rows.groupBy(ident).agg(F.count_distinct(expiry).alias("n_expiries"), F.min(expiry).alias("first_expiry"), F.max(expiry).alias("last_expiry")).where("n_expiries > 1")


def absent_weekdays(days: DataFrame, day: str) -> DataFrame:
    """Mondays to Fridays between the first and the last day that ``days`` lacks, with their year."""
    d = days.select(F.col(day).alias("day")).where(F.col(day).isNotNull()).distinct()
    ends = d.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a IS NOT NULL")
    every = ends.select(F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return every.join(d, "day", "left_anti").withColumn("year", F.year("day").cast("long"))


def coverage_by_year(calendar: DataFrame, recorded: DataFrame, day: str) -> DataFrame:
    """Distinct calendar days, recorded days among those years, and days of the calendar without a record, by year."""
    a = calendar.select(F.col(day).alias("d")).distinct().withColumn("__in", F.lit(1))
    b = recorded.select(F.col(day).alias("d")).distinct().withColumn("__rec", F.lit(1))
    j = a.join(b, "d", "full_outer").groupBy(F.year("d").cast("long").alias("year"))
    return j.agg(F.count("__in").alias("calendar_days"), F.count("__rec").alias("recorded_days"), F.count_if(F.col("__in").isNotNull() & F.col("__rec").isNull()).alias("missing_days")).where("calendar_days > 0")


def backfill_forensics(bars: DataFrame, calendar: DataFrame, keys: list[str] = (), at: str = "bar_ts") -> DataFrame:
    """One row for each calendar row (keys, trade_date, front_close, front_volume, lot, front_oi): what was recorded, and its ratios to what was expected.

    The close observed is that of the last bar with volume, open interest that of the
    last bar with one that is not zero; each falls back to the last bar.  The zero tail
    is the bars at the day's end with an open interest of zero; a missing one ends it.
    A day without bars has found false and nulls.
    """
    on = [*keys, "trade_date"]
    b = bars.where(F.col(at).isNotNull()).withColumn("trade_date", F.to_date(at)).select(*on, F.col(at).alias("__t"), "close", F.col("volume").cast("double").alias("volume"), F.col("oi").cast("double").alias("oi"))
    held = F.max(F.when(F.coalesce(F.col("oi") != 0, F.lit(True)), F.col("__t"))).over(Window.partitionBy(*on))
    tail = F.coalesce(F.col("__t") > F.col("__held"), F.lit(True))
    traded, open_ = F.coalesce(F.col("volume") > 0, F.lit(False)), F.coalesce(F.col("oi") != 0, F.lit(False))
    of = lambda test, c: F.max_by(F.col(c), F.struct(test.alias("x"), F.col("__t").alias("t")))
    time = lambda c: F.date_format(c, "HH:mm:ss")
    days = b.withColumn("__held", held).groupBy(*on).agg(
        F.count("*").alias("bars"), time(F.min("__t")).alias("first_time"), time(F.max("__t")).alias("last_time"), F.max_by("close", "__t").alias("last_close"), F.max_by("oi", "__t").alias("last_oi"),
        time(of(traded, "__t")).alias("close_time"), of(traded, "close").alias("close_observed"), time(of(open_, "__t")).alias("oi_time"), of(open_, "oi").alias("oi_observed"), F.sum("volume").alias("volume_sum"),
        F.count_if(tail).alias("zero_tail"), time(F.min(F.when(tail, F.col("__t")))).alias("zero_from"), F.lit(True).alias("found"),
    )
    j = calendar.select(*on, "front_close", "front_volume", "lot", "front_oi").join(days, on, "left")
    off = lambda a, e: F.try_divide(F.col(a) - F.col(e), F.col(e).cast("double")).alias
    return j.select(
        *on, F.coalesce("found", F.lit(False)).alias("found"), *[c for c in days.columns if c not in (*on, "found")], off("close_observed", "front_close")("close_rel"), off("last_close", "front_close")("last_close_rel"), off("oi_observed", "front_oi")("oi_rel"),
        F.try_divide(F.col("volume_sum"), (F.col("front_volume") * F.col("lot")).cast("double")).alias("volume_ratio"), F.try_divide(F.col("volume_sum"), F.col("front_volume").cast("double")).alias("raw_volume_ratio"),
    )


def vintages(forensics: DataFrame, vintage: Column) -> DataFrame:
    """vintage, what, level, n: days by bar count and by last time, days that end on zero open interest, and days with a bar at 15:30."""
    d = forensics.where("found").select(vintage.alias("vintage"), F.col("bars").cast("string").alias("bars"), "last_time", (F.col("last_oi") == 0).alias("zero"), (F.col("last_time") >= LAST_BARS[0]).alias("late"))
    items = F.array(
        F.struct(F.lit("days").alias("what"), F.lit("").alias("level")), F.struct(F.lit("bars").alias("what"), F.col("bars").alias("level")), F.struct(F.lit("last_time").alias("what"), F.col("last_time").alias("level")),
        F.when(F.col("zero"), F.struct(F.lit("zero_last_oi").alias("what"), F.lit("").alias("level"))), F.when(F.col("late"), F.struct(F.lit("until_close").alias("what"), F.lit("").alias("level"))),
    )
    return d.select("vintage", F.explode(F.filter(items, lambda x: x.isNotNull())).alias("i")).groupBy("vintage", "i.what", "i.level").agg(F.count("*").alias("n"))


def surface_minutes(quotes: DataFrame, keys: list[str], at: str, strike: str, kind: str, price: str, least: int = 5) -> DataFrame:
    """One row a key and timestamp of parsed quotes: median active strike, distinct active strikes below and above it of calls (CE) and puts (PE), and whether all four are at least ``least``.

    Quotes with a price above zero are active; the median goes by quote.  A minute
    without active quotes is not valid.  Quotes are counted by strike and kind first, so
    a timestamp has as many rows as its chain has contracts.
    """
    on = [*keys, at]
    parsed = quotes.where(F.col(at).isNotNull() & F.col(strike).isNotNull() & F.col(kind).isNotNull())
    active = F.coalesce(F.col(price) > 0, F.lit(False))
    chain = parsed.groupBy(*on, F.col(strike).cast("double").alias("__k"), F.col(kind).alias("__kind")).agg(F.count_if(active).alias("__n"))
    w = Window.partitionBy(*on)
    upto = F.sum("__n").over(w.orderBy("__k", "__kind").rowsBetween(Window.unboundedPreceding, 0))
    c = chain.withColumn("__upto", upto).withColumn("__all", F.sum("__n").over(w))
    at_rank = lambda r: F.min(F.when((F.col("__n") > 0) & (F.col("__upto") > r), F.col("__k"))).over(w)
    c = c.withColumn("middle", (at_rank(F.floor((F.col("__all") - 1) / 2)) + at_rank(F.floor(F.col("__all") / 2))) / 2)
    sides = {f"{k.lower()}_{n}": F.count_distinct(F.when((F.col("__n") > 0) & (F.col("__kind") == k) & test, F.col("__k"))) for k in ("CE", "PE") for n, test in (("below", F.col("__k") < F.col("middle")), ("above", F.col("__k") > F.col("middle")))}
    out = c.groupBy(*on).agg(F.max("middle").alias("middle"), *[v.alias(n) for n, v in sides.items()])
    return out.withColumn("valid", F.least(*sides) >= least)


def surface_share(minutes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Minutes of a key with quotes, valid timestamps, and their share."""
    g = minutes.groupBy(*keys).agg(F.count_distinct(F.date_trunc("minute", at)).alias("session_minutes"), F.count_if("valid").alias("valid_minutes"))
    return g.withColumn("share", F.col("valid_minutes") / F.col("session_minutes"))


def series_faults(series: DataFrame, calendar: DataFrame, keys: list[str], day: str) -> DataFrame:
    """keys, day, fault, n: repeated days (identical or differing in any other column) and days of the calendar (keys, day) that the series lacks."""
    on = [*keys, day]
    rest = F.struct(*[c for c in series.columns if c not in on]) if set(series.columns) - set(on) else F.lit(0)
    held = series.groupBy(*on).agg(F.count("*").alias("n"), F.min(rest).eqNullSafe(F.max(rest)).alias("__same"))
    repeated = held.where("n > 1").select(*on, F.when(F.col("__same"), "identical").otherwise("differing").alias("fault"), "n")
    missing = calendar.select(*on).distinct().join(held.select(*on), on, "left_anti").select(*on, F.lit("missing").alias("fault"), F.lit(0).cast("long").alias("n"))
    return repeated.unionByName(missing)
