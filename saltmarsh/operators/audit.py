"""Checks of files, sessions, snapshots and ledgers as set operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saltmarsh.functions.normalise import reasons
from saltmarsh.operators.select import gates

# Parts of column names that no feature may have.
BLOCKED_TOKENS = ("future", "lead", "news", "headline", "sentiment", "gdelt", "event", "announcement", "published_at", "first_seen_at", "available_at")
# Domains of recommendation rows.
SIDES = ("LONG", "SHORT", "NO_TRADE")
STATUSES = ("PICK", "NO_TRADE", "HALTED", "EXPIRED")


def guard_columns(columns: Iterable[str], tokens: Iterable[str] = BLOCKED_TOKENS) -> list[str]:
    """The columns, or an error that names those with a blocked part."""
    columns = list(columns)
    blocked = sorted(c for c in columns if any(t in c.lower() for t in tokens))
    if blocked:
        raise ValueError(f"columns that no feature may use: {', '.join(blocked)}")
    return columns


def resolve_corrections(files: DataFrame, symbol: str, corrective: Column, valid: Column, schema: str, n: str, first: str, last: str) -> DataFrame:
    """A decision for each source file of a symbol.

    A single file is selected when its schema is valid.  One normal and one
    corrective file with the same schema, rows and bounds: the correction replaces
    the other.  Anything else is quarantined as a whole.
    """
    w = Window.partitionBy(symbol)
    d = files.withColumn("__c", F.coalesce(corrective, F.lit(False))).withColumn("__v", F.coalesce(valid, F.lit(False)))
    total, fixes = F.count("*").over(w), F.count_if("__c").over(w)
    same = F.bool_and("__v").over(w) & (F.min(n).over(w) > 0)
    for c in (schema, n, first, last):
        same = same & (F.count(c).over(w) == total) & (F.min(c).over(w) == F.max(c).over(w))
    chosen = F.when(F.col("__c"), "selected_corrected").otherwise("selected")
    d = d.withColumn("overlap", F.max(first).over(w) <= F.min(last).over(w)).withColumn(
        "decision",
        F.when(total == 1, F.when(F.col("__v"), chosen).otherwise("invalid_schema"))
        .when((total == 2) & (fixes == 1) & F.coalesce(same, F.lit(False)), F.when(F.col("__c"), "selected_corrected").otherwise("superseded"))
        .otherwise("quarantined"),
    )
    return d.drop("__c", "__v")


def session_scan(rows: DataFrame, keys: list[str], slot: str, arrival: str, first: int, last: int, short: int, special: Column | None = None) -> DataFrame:
    """One row per session: counts, order faults, gaps as text, constant prices, and what to do with it.

    A session has the slots ``first`` to ``last``; ``rows`` has close, volume and oi.
    Sets of slots are bounded by the session's length.
    """
    w = Window.partitionBy(*keys).orderBy(arrival)
    same = F.coalesce(F.col("close") == F.lag("close").over(w), F.lit(False))
    d = rows.withColumn("__same", same).withColumn("__back", F.lag(slot).over(w) > F.col(slot))
    # A run of equal closes counts its first row too.
    d = d.withColumn("__start", F.col("__same") & ~F.coalesce(F.lag("__same").over(w), F.lit(False)))
    a = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(slot).alias("first"), F.max(slot).alias("last"), (F.count("*") - F.count_distinct(slot)).alias("duplicates"), F.count_if("__back").alias("non_monotonic"),
        F.count_if(F.coalesce(F.col("volume"), F.lit(0)) == 0).alias("zero_volume"), F.count_if(F.col("close") == 0).alias("zero_price"),
        (F.count_if("__same") + F.count_if("__start")).alias("constant"), F.bool_and(F.coalesce(F.col("oi"), F.lit(0)) == 0).alias("oi_all_zero"), F.collect_set(F.col(slot).cast("long")).alias("__slots"),
        F.coalesce(F.bool_or(special), F.lit(False)).alias("__special") if special is not None else F.lit(False).alias("__special"),
    )
    a = a.withColumn("__missing", F.array_except(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), "__slots"))
    edge = lambda step: F.filter("__missing", lambda x: ~F.array_contains("__missing", x + step))
    text = F.zip_with(edge(-1), edge(1), lambda s, e: F.concat(s, F.lit("-"), e, F.lit(" ("), e - s + 1, F.lit(")")))
    a = a.withColumn("gap_segments", F.array_join(text, "; ")).withColumn("n_gaps", F.size(edge(-1)).cast("long"))
    want, n = last - first + 1, F.col("n")
    a = a.withColumn(
        "disposition",
        F.when(F.col("__special"), "keep_full").when((F.col("duplicates") > 0) & (n >= 2 * want), "drop_day")
        .when(n > want, "trim_to_regular_hours").when((n < want) & ((n < short) | (F.col("last") < last)), "drop_day")
        .when(n < want, "exclude_labels_near_close").when((F.col("n_gaps") == 0) & (F.col("duplicates") == 0), "keep_full").otherwise("exclude_training"),
    )
    return a.drop("__slots", "__missing", "__special")


def snapshot_faults(df: DataFrame, id: str, content: Column, stored: str, numbers: list[str]) -> DataFrame:
    """``faults`` of each record: digest that is not its content's, a number that is not finite, an id used twice."""
    bad = F.lit(False)
    for c in numbers:
        bad = bad | F.isnan(c) | F.abs(F.col(c)).eqNullSafe(F.lit(float("inf")))
    tests = {"hash": ~F.col(stored).eqNullSafe(F.sha2(content, 256)), "non_finite": F.coalesce(bad, F.lit(False)), "duplicate_id": F.count("*").over(Window.partitionBy(id)) > 1}
    return df.withColumn("faults", F.array_join(reasons(tests), ","))


def paper_ledger(signals: DataFrame, keys: list[str], order: list[str], fill: str, intended: str, expected: str) -> DataFrame:
    """The first signal of each key, how many were skipped, and how far its fill is from the expected one.

    A signal without a fill is taken to fill at its intended price.
    """
    rest = [c for c in signals.columns if c not in keys]
    first = signals.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count("*") - 1).alias("skipped"))
    got = F.coalesce(F.col(f"r.{fill}"), F.col(f"r.{intended}"))
    return first.select(*keys, "r.*", "skipped", got.alias("fill_price"), (got - F.col(f"r.{expected}")).alias("fill_divergence"))


def chain_hashes(entries: DataFrame, ledger: list[str], order: list[str], content: Column) -> DataFrame:
    """previous_hash and chain_hash of each entry: the digest of the hash before and the content, from GENESIS on.

    A chain is a fold by nature, so a ledger is one task's; its entries are sorted by
    Spark and stream through with one hash held, so that their number does not matter.
    """
    names = [*dict.fromkeys([*ledger, *order])]
    rows = entries.select(*names, content.alias("__text"))
    # The window leaves a ledger's entries in one task, together and in order.
    first = F.row_number().over(Window.partitionBy(*ledger).orderBy(*order, "__text")) == 1
    rows = rows.withColumn("__first", first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = "GENESIS"
        for b in batches:
            before, after = [], []
            for text, first in zip(b.column("__text").to_numpy(zero_copy_only=False).tolist(), b.column("__first").to_numpy(zero_copy_only=False).tolist(), strict=True):
                before.append("GENESIS" if first else h)
                h = hashlib.sha256((before[-1] if text is None else f"{before[-1]}|{text}").encode()).hexdigest()
                after.append(h)
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(before, pa.string()), pa.array(after, pa.string())], [*names, "previous_hash", "chain_hash"])

    return rows.mapInArrow(run, T.StructType([*entries.select(*names).schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("chain_hash", T.StringType())]))


def close_trades(trades: DataFrame, closes: DataFrame, keys: list[str], exit: str, side: Column, fill: str, quantity: str, costs: str) -> DataFrame:
    """OPEN trades with their PnL once a close event exists, then CLOSED; of several events of a key the one with the highest price counts."""
    c = closes.groupBy(*keys).agg(F.max(exit).alias("exit_price"))
    pnl = F.when(side.isin("SELL", "SHORT"), -1.0).otherwise(1.0) * (F.col("exit_price") - F.col(fill)) * F.col(quantity) - F.coalesce(F.col(costs), F.lit(0.0))
    return trades.join(c, keys, "left").withColumn("pnl", pnl).withColumn("status", F.when(F.col("exit_price").isNull(), "OPEN").otherwise("CLOSED"))


def recommendations(df: DataFrame, side: str, status: str, size: str) -> DataFrame:
    """Rows within the domains of side and status; others are quarantined.  No side means no size, a side means a pick."""
    ok = F.col(side).isin(*SIDES) & F.col(status).isin(*STATUSES)
    none = F.col(side) == "NO_TRADE"
    return df.withColumn("quarantined", ~F.coalesce(ok, F.lit(False))).withColumn(size, F.when(none, 0).otherwise(F.col(size))).withColumn(
        status, F.when(F.col("quarantined"), F.col(status)).when(none, "NO_TRADE").when(F.col(status) == "NO_TRADE", "PICK").otherwise(F.col(status))
    )


def graduation(ledger: DataFrame, by: str, date: str, pnl: str, divergence: str, p: str, y: str, incident: str, most_divergence: float, bins: int = 10) -> DataFrame:
    """Gates of a paper strategy: months, trades, lower bound of the mean, fills, calibration, and unexplained incidents."""
    cell = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    off = ledger.groupBy(by, cell.alias("__bin")).agg(F.abs(F.sum(p) - F.sum(y)).alias("off"), F.count(p).alias("k")).groupBy(by).agg(F.try_divide(F.sum("off"), F.sum("k")).alias("ece"))
    g = ledger.groupBy(by).agg(
        F.count("*").alias("n"), (F.datediff(F.max(date), F.min(date)) / 30.4375).alias("months"), F.avg(pnl).alias("ev"), F.stddev_samp(pnl).alias("sd"), F.max(F.abs(divergence)).alias("worst_fill"),
        F.count_if(F.col(incident) == "missed_signal").alias("missed"), F.count_if(F.col(incident) == "duplicate_signal").alias("repeated"),
    )
    g = g.join(off, by).withColumn("ci_low", F.col("ev") - F.coalesce(1.96 * F.col("sd") / F.sqrt("n"), F.lit(0.0)))
    return gates(g, {
        "months": F.col("months") >= 6, "trades": F.col("n") >= 200, "ci": F.col("ci_low") > 0, "fill": F.coalesce(F.col("worst_fill"), F.lit(0.0)) <= most_divergence,
        "ece": F.coalesce(F.col("ece") <= 0.10, F.lit(False)), "missed": F.col("missed") == 0, "repeated": F.col("repeated") == 0,
    })
