"""Candidates, sealed evaluation and gates against plain Python and by hand."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import study as Y

COLUMNS = "family string, symbol string, day date, long_p double, short_p double, long_edge double, short_edge double, long_net double, short_net double"
LONG, SHORT = [0.8, 0.5], [0.5, 0.7]


def _rows():
    rng = random.Random(5)
    out = []
    for i in range(700):
        p = rng.choice([None, 0.5, 0.7, 0.8, rng.random(), rng.random()])
        q = None if p is None else rng.choice([1 - p, rng.random()])
        edge = lambda x: None if x is None else rng.choice([0.0, x * 40 - (1 - x) * 30])
        out.append((rng.choice("ab"), rng.choice([None, "x", "y", "z"]), date(2024, 1, 1) + timedelta(rng.randrange(9)), p, q, edge(p), edge(q), rng.choice([None, 30.0, -20.0]), rng.choice([28.0, -22.0])))
        if i % 50 == 0:
            out.append(out[-1])
    return out


def _plain(rows, family, lt, st):
    taken = defaultdict(list)
    for f, s, d, lp, sp, le, se, ln, sn in rows:
        if f != family:
            continue
        is_long, is_short = lp is not None and lp >= lt and (le or 0) > 0, sp is not None and sp >= st and (se or 0) > 0
        if is_long and (not is_short or le >= se):
            side, net = "long", ln or 0.0
        elif is_short:
            side, net = "short", sn
        else:
            continue
        for name in ("all", side):
            taken[name].append((s, d, net))
    out = {}
    for side, ts in taken.items():
        n, by_day, names = len(ts), defaultdict(list), defaultdict(int)
        for s, d, net in ts:
            by_day[d].append(net)
            names[s] += 1
        ev = sum(t[2] for t in ts) / n
        spread = math.sqrt(sum((sum(v) - ev * len(v)) ** 2 for v in by_day.values())) / n
        gain, loss = sum(max(t[2], 0) for t in ts), sum(max(-t[2], 0) for t in ts)
        out[side] = (n, len(by_day), len(names), ev, ev - 1.96 * spread, gain / loss if loss else gain, max(names.values()) / n)
    return out


def test_candidates_equal_plain_python(spark):
    rows = _rows()
    got = {(r["family"], r["long_threshold"], r["short_threshold"], r["side"]): r for r in Y.candidates(spark.createDataFrame(rows, COLUMNS).repartition(3), LONG, SHORT).collect()}
    want = {(f, lt, st, side): v for f in "ab" for lt in LONG for st in SHORT for side, v in _plain(rows, f, lt, st).items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        r = got[k]
        assert (r["trades"], r["days"], r["symbols"]) == v[:3]
        assert [r[c] for c in ("ev", "ci_low", "profit_factor", "symbol_share")] == pytest.approx(v[3:], abs=1e-9)


def test_every_candidate_has_a_row_and_reasons(spark):
    df = spark.createDataFrame(_rows(), COLUMNS)
    idle = df.limit(1).withColumn("family", F.lit("idle")).withColumn("long_p", F.lit(0.1)).withColumn("short_p", F.lit(0.1))
    df = df.unionByName(idle)
    out = Y.robust_candidates(Y.candidates(df, LONG, SHORT), df, LONG, SHORT, Y.Robust(trades=5, days=10, symbol_share=1.0, symbols=1)).collect()
    assert len(out) == 3 * 4
    assert {r["reasons"] for r in out if r["family"] == "idle"} == {"all_trades"}
    assert all("all_days" in r["reasons"].split(",") and not r["eligible"] for r in out if r["family"] != "idle")


def test_no_rows(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert Y.candidates(empty, LONG, SHORT).count() == 0
    assert Y.choose(Y.robust_candidates(Y.candidates(empty, LONG, SHORT), empty, LONG, SHORT)).count() == 0


def _good(spark):
    """Ten days of longs that win, the last three of them for the test."""
    return spark.range(100).select(
        F.lit("a").alias("family"), F.concat(F.lit("s"), F.col("id") % 4).alias("symbol"), F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 10).cast("int")).alias("day"), F.lit(0.9).alias("long_p"), F.lit(0.1).alias("short_p"),
        F.lit(5.0).alias("long_edge"), F.lit(-5.0).alias("short_edge"), F.when(F.col("id") % 7 == 0, -4.0).otherwise(6.0).alias("long_net"), F.lit(0.0).alias("short_net"),
    )


NEED = Y.Robust(trades=20, days=5, symbol_share=0.5, symbols=2)
TEST = "day >= DATE '2024-01-08'"


def test_a_seal_is_written_and_spent_once(spark, tmp_path):
    df, sealed, result = _good(spark), str(tmp_path / "sealed"), str(tmp_path / "result")
    seen = df.where(f"NOT {TEST}")
    table = Y.robust_candidates(Y.candidates(seen, [0.5, 0.8], [0.5]), seen, [0.5, 0.8], [0.5], NEED)
    Y.seal(df, table, sealed)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        Y.seal(df, table, sealed)
    with pytest.raises(ValueError, match="not the rows"):
        Y.evaluate(spark, sealed, df.unionByName(df.limit(1)), TEST, result)
    out = {r["side"]: r for r in Y.evaluate(spark, sealed, df, F.expr(TEST), result).collect()}
    assert out.keys() == {"all", "long"} and out["all"]["trades"] == 30 and out["all"]["long_threshold"] == 0.5
    with pytest.raises(ValueError, match="spent"):
        Y.evaluate(spark, sealed, df, F.expr(TEST), result)
    gates = {r["gate"]: r for r in Y.acceptance(spark.read.parquet(sealed), spark.read.parquet(result), trades=30, days=3).collect()}
    assert len(gates) == 7 and all(r["passed"] and r["tradable"] for r in gates.values())
    gates = {r["gate"]: r for r in Y.acceptance(spark.read.parquet(sealed), spark.read.parquet(result)).collect()}
    assert not gates["trade_count"]["passed"] and gates["has_trades"]["passed"] and not gates["has_trades"]["tradable"]


def test_nothing_chosen_spends_nothing(spark, tmp_path):
    df, sealed = _good(spark), str(tmp_path / "sealed")
    Y.seal(df, Y.robust_candidates(Y.candidates(df, [0.5], [0.5]), df, [0.5], [0.5]), sealed)
    with pytest.raises(ValueError, match="nothing was chosen"):
        Y.evaluate(spark, sealed, df, F.expr(TEST), str(tmp_path / "result"))
    assert not (tmp_path / "result").exists()


def test_gates_without_trades(spark):
    sealed = spark.createDataFrame([("i",)], "identity string")
    nothing = spark.createDataFrame([], "side string, trades long, days long, ci_low double, profit_factor double, identity string")
    got = {r["gate"]: r["passed"] for r in Y.acceptance(sealed, nothing).collect()}
    assert [g for g, ok in got.items() if ok] == ["identity_present"]


def test_identity_counts_repeated_rows(spark):
    a, b = spark.createDataFrame([(1, None), (2, "x")], "k int, v string"), spark.createDataFrame([(2, "x"), (1, None)], "k int, v string")
    one = lambda d: Y.identity(d).first()[0]
    assert one(a) == one(b) and one(a) != one(a.union(b)) and one(a.limit(0)).startswith("0:")
