"""Mix sources to target weights by subset-sum budget fitting.

Sizes are counted per source and exact length, and each document may be taken up
to MAX_PASSES times.  A target is filled in proportion over the lengths, and a
bounded-knapsack dynamic program over what each length still offers closes the
gap; where it cannot, the fit starts again from fewer documents, at last from none.  Within a length the documents with
the smallest seeded hashes are taken once more than the others.

One group of copies may hold a third of a source at one length: the rank inside
a length is found through buckets of about BUCKET_ROWS rows, by counts and
prefix sums, so no task sorts a whole length.

Defined cases: a null text has size 0; a null source is one source, ordered last;
documents of size 0 are never taken; repeated rows are separate documents to
take; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents, word_count

WEIGHTS = (5, 2, 1)
#: The mix has SHARE_NUM / SHARE_DEN times the words of the corpus.
SHARE_NUM, SHARE_DEN = 3, 2
MAX_PASSES = 2
SEED = 20260
#: Steps that the dynamic program spans at first, and at most; a longer gap is first filled with long documents.
DP_SPAN, DP_CELLS = 1 << 15, 1 << 22
BUCKET_ROWS = 64


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> the same with target.

    With targets capped at MAX_PASSES times the size and the excess shared again
    by weight, target = min(level * weight, cap) for the one level that spends
    the budget.  Ordered by cap / weight, the capped sources come first.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", MAX_PASSES * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * SHARE_NUM / SHARE_DEN)
        .withColumn("w_all", F.sum("weight").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_left", F.col("w_all") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        .withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final", F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(everything))
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("final.level") * F.col("weight")))
    return s.select("source", "source_size", target.alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, cells: int = DP_CELLS) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to ``budget``, or as near below as can be.

    Starts in proportion to the counts.  Where the program cannot close the gap
    from there, it starts again with fewer of each size: 1, 2, 4 and so on, and
    at last with none, which is the exact program over the whole budget where that
    has at most ``cells`` steps of the sizes' common divisor.  A wider gap is first
    narrowed with the longest documents that fit, and what then remains is closed as
    near as can be, not always exactly: it takes documents of millions of words.
    """
    best = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    budget = min(int(budget), total)
    used = (sizes > 0) & (counts > 0)
    if budget <= 0 or not used.any():
        return best
    unit = int(np.gcd.reduce(sizes[used]))
    best_gap = budget
    even = np.array([int(c) * budget // total for c in counts.tolist()], np.int64) * used
    fewer = 0
    while best_gap >= unit:
        # A short program behind the longest documents that fit keeps the mix near the proportions.
        for n_cells in (DP_SPAN, cells):
            take = _fit_from(sizes, counts, np.maximum(0, even - fewer), budget, unit, n_cells)
            gap = budget - int((sizes * take).sum())
            if gap < best_gap:
                best, best_gap = take, gap
            if best_gap < unit:
                break
        if fewer >= even.max():
            break
        fewer = max(1, 2 * fewer)
    return best


def _fit_from(sizes: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int, unit: int, cells: int) -> np.ndarray:
    """``take`` made up to ``budget`` by dynamic programming over the gap in steps of ``unit``.

    A gap of more than ``cells`` steps is first filled with the longest that fit.
    """
    take = take.copy()
    rest = (budget - int((sizes * take).sum())) // unit
    steps = sizes // unit
    for k in np.argsort(-steps, kind="stable"):
        if rest <= cells:
            break
        if steps[k] > 0:
            n = min(int(counts[k] - take[k]), (rest - cells // 2) // int(steps[k]))
            take[k] += n
            rest -= n * int(steps[k])
    for k in np.argsort(-steps, kind="stable") if rest > DP_CELLS else ():
        if steps[k] > 0 and rest > DP_CELLS:
            n = min(int(counts[k] - take[k]), rest // int(steps[k]))
            take[k] += n
            rest -= n * int(steps[k])
    if rest > DP_CELLS:  # every document that is left is longer than the gap
        return take
    # reached[s]: some choice adds up to s; by[s]: the part that reached it first.
    reached, by, parts = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int32), []
    reached[0] = True
    for k in np.argsort(steps, kind="stable"):
        size, free = int(steps[k]), int(counts[k] - take[k])
        if size <= 0 or size > rest or reached[rest]:
            continue
        free, step = min(free, rest // size), 1
        while free > 0:
            n = min(step, free)
            new = np.zeros_like(reached)
            new[n * size :] = reached[: rest + 1 - n * size]
            new &= ~reached
            by[new] = len(parts)
            reached |= new
            parts.append((int(k), n))
            free -= n
            step *= 2
    s = int(np.flatnonzero(reached)[-1])
    while s > 0:
        k, n = parts[by[s]]
        take[k] += n
        s -= n * int(steps[k])
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each size of a source: passes that all its documents get, and how many get one more."""
    pdf = pdf.sort_values("size", kind="stable")
    sizes, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    take = fit_counts(sizes, MAX_PASSES * counts * (sizes > 0), int(round(float(pdf["target"].iloc[0]))))
    return pdf.assign(passes=take // counts, extra=take % counts)[["source", "size", "n", "source_size", "target", "passes", "extra"]]


def mix_plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and source."""
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id)).alias("h")))
    hist = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    targets = source_targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).select(F.col("source").alias("t_source"), "source_size", "target")
    fitted = cut(
        hist.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .groupBy("source")
        .applyInPandas(_fit_source, "source string, size long, n long, source_size long, target double, passes int, extra long")
    ).select(*[F.col(c).alias(f"p_{c}") for c in ("source", "size", "n", "source_size", "target", "passes", "extra")])
    planned = rows.join(fitted, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    planned = cut(planned.select("doc_id", "source", "size", "h", *[F.col(f"p_{c}").alias(c) for c in ("n", "source_size", "target", "passes", "extra")]))
    chosen = planned.where((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    bucketed = chosen.withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 16), F.ceil(F.col("n") / BUCKET_ROWS)))
    starts = (
        bucketed.groupBy("source", "size", "bucket").agg(F.count("*").alias("b_n"))
        .withColumn("start", F.coalesce(F.sum("b_n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), "start")
    )
    ranked = (
        bucketed.join(starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")))
        .withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")))
        .withColumn("more", (F.col("rank") <= F.col("extra")).cast("long"))
    )
    out = ["doc_id", "size", "source_size", "target", "taken", "source"]
    whole = planned.where((F.col("extra") <= 0) | (F.col("extra") >= F.col("n"))).withColumn("more", (F.col("extra") > 0).cast("long"))
    taken = (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken")
    pick = [taken if c == "taken" else F.col(c) for c in out]
    return whole.select(*pick).unionByName(ranked.select(*pick))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the plan takes it."""
    plan = mix_plan(docs, doc_id, text, source, seed)
    # Rows that share an id, size and source are interchangeable in the plan; their passes are added up and dealt out evenly.
    passes = cut(
        plan.groupBy("doc_id", "size", "source")
        .agg(F.sum(F.when(F.col("taken") > 0, F.col("taken") / F.col("size"))).cast("int").alias("passes"), F.count("*").alias("rows"))
        .where("passes > 0")
        .select(F.col("doc_id").alias("p_id"), F.col("size").alias("p_size"), F.col("source").alias("p_source"), "passes", "rows")
    )
    # The row travels as one value, so that no column of its own can clash with the working ones.
    whole = docs.select(
        F.col(doc_id).alias("id"), word_count(text).alias("words"), F.col(source).alias("of"), F.xxhash64(text).alias("order"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    )
    is_row = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("words") == F.col("p_size")) & F.col("of").eqNullSafe(F.col("p_source"))

    def copied(rows: DataFrame, copies: Column) -> DataFrame:
        return rows.withColumn("copies", copies.cast("int")).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")

    once = copied(whole.join(passes.where("rows = 1"), is_row), F.col("passes"))
    if passes.where("rows > 1").isEmpty():
        return once
    several = whole.join(passes.where("rows > 1"), is_row)
    rank = F.row_number().over(Window.partitionBy("p_id", "p_size", "p_source").orderBy("order"))
    dealt = F.floor(F.col("passes") / F.col("rows")) + (rank <= F.col("passes") % F.col("rows")).cast("int")
    return once.unionByName(copied(several, dealt))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir))
