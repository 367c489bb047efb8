"""Order statistics, choices in order, functions of the caller, and out-of-fold scores against plain Python."""

from __future__ import annotations

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import callers as U
from saltmarsh.operators import checks as Q
from saltmarsh.operators import crossfit as O
from saltmarsh.operators import labels as L
from saltmarsh.operators import ranks as K


def test_ranks_by_narrowing_brackets(spark):
    rng = random.Random(1)
    groups = {
        "uniform": [rng.random() for _ in range(3000)], "equal": [7.0] * 500, "one": [3.5], "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)],
        None: [float(rng.randrange(5)) for _ in range(300)], "ends": [-1.7e308, 1.7e308, 0.0, 5e-324],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("uniform", None), ("uniform", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    near = {r["k"]: r for r in K.nearest_rank(df, ["k"], "v", shares).collect()}
    between = {r["k"]: r for r in K.interpolated(df, ["k"], "v", shares).collect()}
    assert near.keys() == between.keys() == groups.keys()
    for k, vs in groups.items():
        s = sorted(vs)
        for n, p in shares.items():
            assert near[k][n] == s[int(np.floor(p * (len(s) - 1) + 0.5))], (k, n)
            low = int(np.floor(p * (len(s) - 1)))
            part, high = p * (len(s) - 1) - low, s[int(np.ceil(p * (len(s) - 1)))]
            assert between[k][n] == pytest.approx(s[low] + part * (high - s[low]), rel=1e-12)


def test_ranks_without_groups_and_past_the_end(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("v"))
    wanted = spark.createDataFrame([("a", 0), ("b", 555), ("c", 999), ("d", 1000), ("e", -1)], "target string, rank long")
    assert {r["target"]: r["v"] for r in K.at_ranks(df, [], "v", wanted).collect()} == {"a": 0.0, "b": 55.0, "c": 99.0}
    assert [tuple(r) for r in K.nearest_rank(df.limit(0), [], "v", {"p": 0.5}).collect()] == [(None,)]


def greedy(rows):
    until, out = -1, []
    for s, e in sorted(rows):
        if s > until:
            until = e
            out.append(s)
    return out


def test_disjoint_choice_in_long_groups(spark):
    rng = random.Random(4)
    groups = {("a", 1): 30_000, ("b", None): 500, (None, 2): 3}
    rows = [(*k, s := rng.randrange(n), s + rng.randrange(9)) for k, n in groups.items() for _ in range(n)]
    got = L.keep_disjoint(spark.createDataFrame(rows, "k string, j long, s long, e long").repartition(4), ["k", "j"], "s", "e").collect()
    for k in groups:
        assert sorted(r["s"] for r in got if (r["k"], r["j"]) == k) == greedy([r[2:] for r in rows if r[:2] == k])


def test_admission_in_order(spark):
    rng = random.Random(5)
    rows = [(d, i, rng.choice([None, -60.0, 10.0, -20.0])) for d in range(40) for i in range(12)]
    got = {(r["d"], r["o"]) for r in L.daily_admission(spark.createDataFrame(rows, "d long, o long, p double").repartition(3), ["d"], "o", "p", 3, -50.0).collect()}
    want = set()
    for d in range(40):
        n, total = 0, 0.0
        for _, o, p in sorted((r for r in rows if r[0] == d), key=lambda r: r[1]):
            if n < 3 and total > -50.0:
                n, total = n + 1, total + (p or 0.0)
                want.add((d, o))
    assert got == want


def test_a_function_of_the_caller(spark):
    def longest_rise(key, frame):
        """The longest rising run, which no aggregate gives; fold 3 fails."""
        if key["fold"] == 3:
            raise ArithmeticError("fold three")
        best = run = 0
        last = None
        for v in frame["v"]:
            run = run + 1 if last is not None and v > last else 1
            best, last = max(best, run), v
        return {"longest": best, "note": f"{key['fold']}"} if key["fold"] != 4 else {"longest": "many" if key["seed"] else 1.5, "note": "x"}

    rng = random.Random(6)
    rows = [(f, s, i, rng.random()) for f in range(5) for s in range(2) for i in range(60)] + [(7, 0, i, 1.0) for i in range(200)] + [(None, 1, 0, 2.0)]
    df = spark.createDataFrame(rows, "fold long, seed long, i long, v double").repartition(4)
    got = {(r["fold"], r["seed"]): r for r in U.evaluate(df, ["fold", "seed"], ["v"], longest_rise, "longest long, note string", ["i"], most_rows=100).collect()}
    assert len(got) == 12
    for f in range(3):
        for s in range(2):
            want = longest_rise({"fold": f, "seed": s}, {"v": [r[3] for r in rows if r[:2] == (f, s)]})
            assert (got[f, s]["longest"], got[f, s]["note"], got[f, s]["n_rows"], got[f, s]["error"]) == (want["longest"], str(f), 60, None)
    assert got[3, 0]["error"] == "ArithmeticError: fold three" and got[3, 0]["longest"] is None
    assert "Error" in got[4, 1]["error"] and "whole numbers" in got[4, 0]["error"] and got[4, 0]["longest"] is None
    assert got[7, 0]["error"] == "TooLarge: 200 rows, at most 100" and got[None, 1]["longest"] == 1
    with pytest.raises(ValueError, match="columns"):
        U.evaluate(df, ["fold"], ["w"], longest_rise, "longest long")
    with pytest.raises(ValueError, match="returns"):
        U.evaluate(df, ["fold"], ["v"], longest_rise, "fold long")


def test_map_batches_checks_what_comes_back(spark):
    df = spark.range(10)
    assert sorted(r["twice"] for r in U.map_batches(df, lambda b: b.assign(twice=b["id"] * 2)[["twice"]], "twice long").collect()) == list(range(0, 20, 2))
    with pytest.raises(Exception, match="not \\['twice'\\]"):
        U.map_batches(df, lambda b: b, "twice long").collect()


def test_out_of_fold_scores_equal_fits_fold_by_fold(spark):
    rng = np.random.default_rng(7)
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=int(m)), float(a), None if rng.random() < 0.05 else float(b), float(a - 2 * b + rng.normal())) for m, a, b in zip(rng.integers(0, 5000, 900), rng.normal(size=900), rng.normal(size=900), strict=True)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, y double").repartition(4)
    got = O.out_of_fold(df, "ts", ["a", "b"], "y", 3600, 4).collect()
    times = sorted(r[0] for r in rows)
    edges = [int(e) for e in np.linspace(1, 899, 5)][1:]
    n = 0
    for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False), 1):
        lo, hi = times[s], times[e]
        train = [r for r in rows if r[0] < lo - timedelta(hours=1) and r[2] is not None]
        x = np.array([[1, r[1], r[2]] for r in train])
        w = np.linalg.solve(x.T @ x + np.diag([0, 1, 1]), x.T @ np.array([r[3] for r in train]))
        own = {(r["ts"], r["a"]): r for r in got if r["fold"] == k}
        want = [r for r in rows if lo <= r[0] < hi]
        assert len(own) == len(want)
        for r in want:
            score = own[r[0], r[1]]["oof_score"]
            assert score is None if r[2] is None else score == pytest.approx(w @ [1, r[1], r[2]], rel=1e-9, abs=1e-9)
        n += len(want)
    assert n == len(got) and n > 500
    assert O.out_of_fold(df.limit(3), "ts", ["a"], "y", 60).collect() == []
    with pytest.raises(ValueError, match="positive"):
        O.out_of_fold(df, "ts", ["a"], "y", 0)


def test_outliers_of_sessions_against_plain_python(spark):
    rng = random.Random(9)
    rows, want = [], set()
    for source in ("wild", "flat", "few", None):
        n, price, returns = {"few": 4}.get(source, 60), 100.0, []
        for i in range(n):
            at = datetime(2024, 1, 1 + i // 20) + timedelta(minutes=i % 20)
            last, price = price, 100.0 * (1.0 if source == "flat" else 1 + rng.gauss(0, 0.001)) * (1.5 if i in (25, 45) else 1.0)
            key = len(rows)
            rows.append((source, at, key, price))
            if i % 20:
                returns.append((key, price / last - 1))
        values = [r for _, r in returns]
        if len(values) >= 5 and source is not None:
            mid = statistics.median(values)
            mad = statistics.median(abs(r - mid) for r in values)
            want |= {k for k, r in returns if (abs(r - mid) / (1.4826 * mad) > 8 if mad else abs(r - mid) > 0.05)}
    df = spark.createDataFrame(rows, "source string, at timestamp_ntz, key long, price double").repartition(3)
    got = Q.session_outliers(df, ["source"], "at", "key", "price").collect()
    assert len(got) == len(rows) and {r["key"] for r in got if r["outlier"]} == want and len(want) == 8
    none = Q.session_outliers(df.limit(0), ["source"], "at", "key", "price")
    assert none.count() == 0


def test_router_names_outliers_last(spark):
    rows = [("a", datetime(2024, 1, 1, 9, i), i, 100.0 if i != 7 else 200.0) for i in range(12)] + [("a", datetime(2024, 1, 1, 9, 7), 50, 900.0), ("a", datetime(2024, 1, 1, 9, 8), 51, -1.0)]
    df = spark.createDataFrame(rows, "source string, at timestamp_ntz, key long, price double")
    got = {r["key"]: r["reject_reason"] for r in Q.reject_router(df, {"negative": F.col("price") < 0}, ["source"], ["source", "at"], "at", "key", "price").collect()}
    assert {k: v for k, v in got.items() if v} == {7: "outlier_return", 8: "outlier_return", 50: "duplicate_timestamp", 51: "negative"} and len(got) == 14
