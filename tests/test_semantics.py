"""Hand-computed cases and the causality test."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import asof, features, labels, metrics, select
from saltmarsh.plans.views import Views

BAR = "symbol string, trade_date date, bar_ts timestamp_ntz, slot long, open double, high double, low double, close double, volume long, oi long"


def bars(spark, rows, symbol="X", start=datetime(2024, 1, 2, 9, 15)):
    out = []
    for i, (o, h, lo, c, *more) in enumerate(rows):
        ts = start + timedelta(minutes=i)
        out.append((symbol, ts.date(), ts, i, float(o), float(h), float(lo), float(c), more[0] if more else 10, 100))
    return spark.createDataFrame(out, BAR)


def by_slot(df, *cols):
    return {r["slot"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.select("slot", *cols).collect()}


def test_double_touch_is_a_stop(spark):
    df = labels.percent_barriers(bars(spark, [(100, 100, 100, 100), (101, 101, 101, 101), (101, 102, 100, 101)]), ["symbol", "trade_date"], "bar_ts", 5, 0.004, 0.003)
    got = by_slot(df, "outcome", "bars_held", "ambiguous")
    assert got[0] == ("stop", 2, True)
    assert got[2] == ("excluded", None, False)


def test_timeout_and_excursions(spark):
    df = labels.percent_barriers(bars(spark, [(100, 100, 100, 100), (100, 101, 99, 100.5), (100.5, 102, 100, 101)]), ["symbol", "trade_date"], "bar_ts", 5, 0.5, 0.5)
    outcome, gross, mfe, mae = by_slot(df, "outcome", "gross_bps", "mfe_bps", "mae_bps")[0]
    assert outcome == "timeout" and gross == pytest.approx(100) and mfe == pytest.approx(200) and mae == pytest.approx(-100)


def test_close_parity_labels(spark):
    df = labels.close_parity(bars(spark, [(c, c, c, c) for c in (100, 100, 100.4, 99.7)]), ["symbol", "trade_date"], "bar_ts", 60, 0.004, 0.003)
    got = by_slot(df, "long_label", "short_label")
    assert [got[i][0] for i in range(4)] == [1, 1, 0, 0] and got[2][1] == 1


def test_returns_are_zero_without_history(spark):
    got = by_slot(features.price_returns(bars(spark, [(1, 1, 1, 0), (1, 1, 1, 2), (1, 1, 1, 3)]), (1,)), "return_1")
    assert got == {0: 0.0, 1: 0.0, 2: 0.5}


def test_equal_close_in_streaks(spark):
    b = bars(spark, [(1, 1, 1, c) for c in (100, 101, 102, 102, 103)])
    assert by_slot(features.streak(b), "streak")[3] == -1
    assert by_slot(features.streak(b, True), "streak")[3] == 0


def test_profit_factor_without_losses(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    assert df.groupBy("k").agg(metrics.profit_factor(F.col("v")).alias("pf")).first()["pf"] == 3.0


def test_membership_is_half_open(spark):
    rows = spark.createDataFrame([("ABC", "2025-01-01"), ("ABC", "2025-01-31"), ("ABC", "2025-02-01"), ("XYZ", "2025-06-01")], "s string, d string").withColumn("d", F.to_date("d"))
    h = spark.createDataFrame([("ABC", "2025-01-01", "2025-02-01"), ("XYZ", "2025-03-01", None)], "s string, a string, b string").select("s", F.to_date("a").alias("effective_from"), F.to_date("b").alias("effective_to"))
    got = sorted((r["s"], str(r["d"])) for r in asof.active_members(rows, h, "s", "d").collect())
    assert got == [("ABC", "2025-01-01"), ("ABC", "2025-01-31"), ("XYZ", "2025-06-01")]


def test_overlapping_signals(spark):
    df = spark.createDataFrame([("x", 1, 4), ("x", 3, 5), ("x", 4, 6), ("x", 5, 9)], "k string, s long, e long")
    assert sorted(r["s"] for r in labels.keep_disjoint(df, ["k"], "s", "e").collect()) == [1, 5]


def test_sealed_days_never_take_all(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "d string")
    assert [r["split"] for r in select.sealed_split(df, "d", 1.0).orderBy("d").collect()] == ["select", "sealed"]


@pytest.mark.parametrize("build", [features.price_returns, features.atr, features.volume_z, features.streak, features.path_features, features.ema_slope, features.five_minute_block, features.oi_features, features.vwap_slope])
def test_the_future_does_not_change_the_past(spark, sf_dir, build):
    b = Views(spark, sf_dir).bars.where("symbol = 'click'").cache()
    cut = sorted(r["bar_ts"] for r in b.select("bar_ts").collect())[60]
    later = F.col("bar_ts") > F.lit(cut)
    changed = b.withColumns({c: F.when(later, F.col(c) * 3 + 1).otherwise(F.col(c)).cast(t) for c, t in b.dtypes if c in ("open", "high", "low", "close", "volume", "oi")})
    past = lambda df: sorted(map(repr, build(df).where(~later).collect()))
    assert past(b) == past(changed)


def test_feature_package_does_not_look_ahead():
    text = (Path(__file__).parent.parent / "saltmarsh/operators/features.py").read_text()
    label_side = text.index("def eligibility"), text.index("def forward_returns")
    assert text.count("F.lead(") == text[label_side[0] :].count("F.lead(") == 2


def test_registration_needs_no_session():
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr


def test_bootstrap_interval_has_the_width_of_theory(spark):
    import random

    from saltmarsh.operators import metrics

    rng = random.Random(1)
    n = 900
    df = spark.createDataFrame([("a", i, rng.gauss(1.0, 2.0)) for i in range(n)], "side string, date long, x double")
    half = 1.645 * 2.0 / n**0.5
    for statistic, block in (("pooled", False), ("mean", True)):
        r = metrics.bootstrap(df, ["side"], "date", "x", 200, 0.9, statistic, moving_block=block).first()
        assert 0.7 * 2 * half < r["ci_high"] - r["ci_low"] < 1.35 * 2 * half and r["ci_low"] < 1.15 and r["ci_high"] > 0.85
    s = metrics.bootstrap(df, ["side"], "date", "x", 200, 0.9, "sharpe").first()
    assert s["ci_low"] < 252**0.5 / 2 < s["ci_high"] and s["ci_high"] - s["ci_low"] > 0.7 * 2 * 1.645 * (252 / n) ** 0.5
