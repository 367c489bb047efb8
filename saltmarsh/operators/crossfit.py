"""Out-of-fold scores over expanding folds with an embargo, from sums that folds share.

A ridge regression needs only sums of products of its inputs.  Each row belongs to
the first fold whose training it is in, one grouped pass sums the products by that
number, and the sums of a fold are those of all numbers up to its own.  So all
folds are fitted from one pass, and a second pass scores the rows of their
validation spans.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.operators.ranks import at_ranks


def expanding_folds(df: DataFrame, time: str, horizon_seconds: int, folds: int = 3) -> list[dict]:
    """Bounds of the folds by position in order of time: valid_from, valid_to (both within), cutoff; rows of one time are not parted.

    Training is what lies before the cutoff, the horizon ahead of the first row of
    the span, so that no label of it reaches into the span.  Folds without training
    or validation rows are left out, as are all where there are fewer than four rows.
    """
    if horizon_seconds <= 0:
        raise ValueError("the horizon must be positive")
    at = df.select(F.unix_micros(F.col(time).cast("timestamp")).alias("t"))
    n, first = at.agg(F.count("t"), F.min("t")).first()
    if n < 4:
        return []
    parts = min(folds, max(1, n // 2))
    edges = [int(e) for e in np.linspace(1, n - 1, parts + 1)][1:]
    wanted = df.sparkSession.createDataFrame([(str(e), e) for e in edges], "target string, rank long")
    found = {int(r["target"]): int(r["t"]) for r in at_ranks(at, [], "t", wanted).collect()}
    out = []
    for start, end in zip(edges, edges[1:], strict=False):
        lo, hi = found[start], found[end]
        cutoff = lo - horizon_seconds * 1_000_000
        if lo < hi and first < cutoff:
            out.append({"fold": len(out) + 1, "valid_from": lo, "valid_before": hi, "cutoff": cutoff})
    return out


def out_of_fold(df: DataFrame, time: str, inputs: list[str], label: str, horizon_seconds: int, folds: int = 3, ridge: float = 1.0) -> DataFrame:
    """``df``'s rows of the validation spans with ``fold`` and ``oof_score``.

    The score is that of a ridge regression on the inputs and a constant (which is
    not shrunk), fitted before the fold's cutoff.  Rows with a null input or label
    train nothing; with a null input they have no score.  What reaches the driver is
    a square of sums for each fold, as wide as the inputs.
    """
    spans = expanding_folds(df, time, horizon_seconds, folds)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    if not spans:
        return df.limit(0).withColumn("fold", F.lit(None).cast("int")).withColumn("oof_score", F.lit(None).cast("double"))
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in inputs]]
    number = F.coalesce(*[F.when(at < s["cutoff"], F.lit(s["fold"])) for s in spans])
    whole = F.lit(True)
    for c in (*inputs, label):
        whole = whole & F.col(c).isNotNull()
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = df.where(whole & number.isNotNull()).groupBy(number.alias("number")).agg(
        *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(x[i] * F.col(label).cast("double")).alias(f"b{i}") for i in range(len(x))],
    ).collect()
    score: Column = F.lit(None).cast("double")
    fold: Column = F.lit(None).cast("int")
    for s in spans:
        own = [r for r in sums if r["number"] <= s["fold"]]
        inside = (at >= s["valid_from"]) & (at < s["valid_before"])
        fold = F.when(inside, F.lit(s["fold"])).otherwise(fold)
        if not own:
            continue
        g, b = np.zeros((len(x), len(x))), np.array([sum(r[f"b{i}"] for r in own) for i in range(len(x))])
        for i, j in pairs:
            g[i, j] = g[j, i] = sum(r[f"g{i}_{j}"] for r in own)
        w = np.linalg.lstsq(g + ridge * np.diag([0.0, *[1.0] * len(inputs)]), b, rcond=None)[0]
        line = F.lit(float(w[0]))
        for c, v in zip(inputs, w[1:], strict=True):
            line = line + F.col(c).cast("double") * float(v)
        score = F.when(inside, line).otherwise(score)
    return df.withColumn("fold", fold).withColumn("oof_score", score).where("fold IS NOT NULL")
