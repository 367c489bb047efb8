"""A filter over decisions by how the ones before them ended, as far as that was known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.operators.asof import as_of

RECENT, CAP = 10, 20


def resolved_rates(decisions: DataFrame, keys: list[str], at: str, exit_at: str, win: str, ident: str, recent: int = RECENT, cap: int = CAP) -> DataFrame:
    """``decisions`` with win_rate and maturity of their keys (symbol and side, say).

    The rate is that of the last ``recent`` decisions of the keys whose exit came
    before this decision's time, 0.5 where there is none; maturity is how many such
    there are, up to ``cap``, as a share of it.  A decision that is still open when
    the next one is made tells nothing about it.
    """
    ended = decisions.where(F.col(exit_at).isNotNull() & F.col(win).isNotNull())
    order = Window.partitionBy(*keys).orderBy(exit_at, ident)
    last, all_ = order.rowsBetween(-(recent - 1), 0), order.rowsBetween(-(cap - 1), 0)
    state = F.struct(F.avg(F.col(win).cast("double")).over(last).alias("rate"), (F.count("*").over(all_) / cap).alias("maturity"))
    known = ended.select(*keys, exit_at, ident, state.alias("state"))
    # Of decisions that end at one time, the last has seen the others.
    known = known.groupBy(*keys, F.col(exit_at).alias("known_at")).agg(F.max_by("state", ident).alias("state"))
    out = as_of(decisions, known, keys, at, "known_at", "state", strict=True)
    return out.withColumn("win_rate", F.coalesce("asof_value.rate", F.lit(0.5))).withColumn("maturity", F.coalesce("asof_value.maturity", F.lit(0.0))).drop("asof_value")


def filtered_actions(df: DataFrame, action: str, score: str, least: float) -> DataFrame:
    """``df`` whose actions with a score below ``least`` are NO_TRADE; without a score an action stands."""
    stands = F.col(score).isNull() | (F.col(score) >= least)
    return df.withColumn(action, F.when(stands, F.col(action)).otherwise(F.lit("NO_TRADE")))
