"""Universe rows with their metadata, and counts and checks of a table of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def universe_rows(members: DataFrame, sectors: DataFrame, indices: DataFrame, feeds: DataFrame) -> DataFrame:
    """``members`` (symbol, traded, days and more) with sector, sector_index, feed, available, context and mean_traded.

    ``sectors`` has symbol and sector, ``indices`` has sector, sector_index and feed (the
    index's name at its source, or null), ``feeds`` has feed, one row for each that is
    recorded.  A symbol without a sector, or a sector without an index, is an error that
    names up to five; a feed that is not recorded is a context that must not be promoted.
    """
    s = sectors.where(F.col("sector") != "").groupBy("symbol").agg(F.min("sector").alias("sector"))
    i = indices.where(F.col("sector_index") != "").groupBy("sector").agg(F.min(F.struct("sector_index", "feed")).alias("__i"))
    known = feeds.select(F.upper("feed").alias("__feed")).distinct()
    j = members.join(s, "symbol", "left").join(i, "sector", "left")
    bad = j.where(F.col("__i").isNull()).select("symbol", F.coalesce("sector", F.lit("no sector")).alias("why")).orderBy("symbol").limit(5).collect()
    if bad:
        raise ValueError("metadata is missing: " + ", ".join(f"{r['symbol']} ({r['why']})" for r in bad))
    j = j.withColumns({"sector_index": F.col("__i.sector_index"), "feed": F.col("__i.feed")}).join(known, F.upper("feed") == F.col("__feed"), "left")
    available = F.col("__feed").isNotNull()
    return j.withColumns({
        "available": available, "context": F.when(available, "available_context").otherwise("unavailable_context_not_promotable"), "mean_traded": F.try_divide(F.col("traded").cast("double"), F.col("days").cast("double")),
    }).drop("__i", "__feed")


def source_counts(sources: DataFrame, columns: list[str]) -> DataFrame:
    """what, level, n: sources by each of the columns, in one pass."""
    g = sources.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), *[F.grouping(c).alias(f"__g_{c}") for c in columns])
    pick = lambda f: F.coalesce(*[F.when(F.col(f"__g_{c}") == 0, f(c)) for c in columns])
    return g.select(pick(F.lit).alias("what"), pick(lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))).alias("level"), "n")


def source_checks(sources: DataFrame, role: str, decision: str, least: dict[str, tuple[list[str], int, bool]], quarantined: list[str]) -> DataFrame:
    """check, n, needed, passed, blocks, and ready (all that block pass).

    ``least`` names for each check the roles counted, how many sources they need, and
    whether it blocks.  The last check, ``quarantined``, counts sources of those roles
    whose decision does not begin with quarantine, of which there may be none.
    """
    by = sources.groupBy(F.col(role).alias("r"), F.coalesce(F.startswith(decision, F.lit("quarantine")), F.lit(False)).alias("q")).agg(F.count("*").alias("n"))
    total = lambda t: F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).cast("long")
    loose = by.agg(*[total(F.col("r").isin(roles)).alias(f"c_{n}") for n, (roles, _, _) in least.items()], total(F.col("r").isin(quarantined) & ~F.col("q")).alias("c_quarantined"))
    listed = [F.struct(F.lit(n).alias("check"), F.col(f"c_{n}").alias("n"), F.lit(k).cast("long").alias("needed"), (F.col(f"c_{n}") >= k).alias("passed"), F.lit(b).alias("blocks")) for n, (_, k, b) in least.items()]
    listed.append(F.struct(F.lit("quarantined").alias("check"), F.col("c_quarantined").alias("n"), F.lit(0).cast("long").alias("needed"), (F.col("c_quarantined") == 0).alias("passed"), F.lit(True).alias("blocks")))
    checks = loose.select(F.explode(F.array(*listed)).alias("c")).select("c.*")
    return checks.withColumn("ready", F.min(F.col("passed") | ~F.col("blocks")).over(Window.partitionBy(F.lit(0))))  # one row a check
