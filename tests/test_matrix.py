"""The registered matrices: pinned formulas, causality, refusals, and the run session by session."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import features as E
from saltmarsh.operators import matrix as X
from saltmarsh.streaming import sessions as S

BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, oi double"


def sessions_from(first: date, n: int) -> list[date]:
    days, d = [], first
    while len(days) < n:
        if d.weekday() < 5:
            days.append(d)
        d += timedelta(1)
    return days


def bars_of(days, symbol="f", minutes=375, scale=1.0):
    out = []
    for k, d in enumerate(days):
        before = 100 + max(k - 1, 0) * 0.5 + 0.02 * (minutes - 1)
        for m in range(minutes):
            close = (100 + k * 0.5 + m * 0.02 + (0.01 if m % 2 else 0.0)) * scale
            at = datetime(d.year, d.month, d.day, 9, 15) + timedelta(minutes=m)
            out.append((symbol, at, before + 1 if m == 0 else close - 0.01, close + 0.1, close - 0.1, close, 1000.0 + 10 * k + m, 1e5))
    return out


DAYS = sessions_from(date(2024, 1, 2), 22)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(bars_of(DAYS), BARS)


@pytest.fixture(scope="module")
def matrix(bars):
    return {(r["symbol"], r["bar_ts"]): r for r in X.feature_matrix(bars).collect()}


def at(matrix, day, hour, minute):
    return matrix["f", datetime(day.year, day.month, day.day, hour, minute)]


def test_columns_in_registered_order(bars):
    m = X.feature_matrix(bars)
    assert len(X.WIDE) == 33 and len(X.PATH) == 23
    assert X.wide(m).columns == [*X.KEYS, *X.WIDE, *X.ELIGIBILITY] and X.path(m).columns == [*X.KEYS, *X.PATH, *X.ELIGIBILITY]


def test_pinned_path_values(matrix):
    last = DAYS[-1]
    assert at(matrix, last, 9, 30)["opening_range_location"] == pytest.approx(0.41 / 0.48)
    assert at(matrix, last, 9, 29)["opening_range_location"] is None and at(matrix, last, 9, 29)["or_breakout_up"] is None
    row = at(matrix, last, 10, 0)
    assert row["trend_efficiency_15m"] == pytest.approx(1.0) and row["gap_fill_fraction"] == 1.0
    assert row["session_time_sin"] == pytest.approx(math.sin(2 * math.pi * 45 / 375))
    assert row["true_gap_pct"] == pytest.approx((100 + 20 * 0.5 + 0.02 * 374 + 1 - (100 + 20 * 0.5 + 374 * 0.02)) / (100 + 20 * 0.5 + 374 * 0.02))


def test_baselines_begin_with_the_twenty_first_session(matrix):
    assert at(matrix, DAYS[19], 10, 0)["volume_surprise_60d"] is None
    median = float(np.median([1000 + 10 * k + 45 for k in range(20)]))
    assert at(matrix, DAYS[20], 10, 0)["volume_surprise_60d"] == pytest.approx(math.log((1000 + 200 + 45) / median))
    assert at(matrix, DAYS[20], 10, 0)["range_expansion_15m"] == pytest.approx(1.0)
    devs = [at(matrix, d, 10, 0)["vwap_dev"] for d in DAYS[:20]]
    assert at(matrix, DAYS[20], 10, 0)["vwap_dev_z60"] == pytest.approx((at(matrix, DAYS[20], 10, 0)["vwap_dev"] - np.mean(devs)) / np.std(devs))


def test_eligibility(matrix):
    day = DAYS[3]
    want = {(9, 44): 0, (9, 45): 1, (10, 59): 1, (11, 0): 0, (11, 59): 0, (12, 0): 1, (14, 29): 1, (14, 30): 0}
    assert {k: at(matrix, day, *k)["is_decision_eligible"] for k in want} == want
    assert at(matrix, day, 14, 29)["has_contiguous_horizon_60m"] == 1 and at(matrix, day, 14, 30)["has_contiguous_horizon_60m"] == 0


def test_a_gap_in_the_minutes_ends_the_horizon(spark, bars):
    hole = bars.where(F.col("bar_ts") != F.lit(datetime(2024, 1, 2, 10, 30)))
    got = {r["bar_ts"]: r for r in X.feature_matrix(hole.where(F.to_date("bar_ts") == date(2024, 1, 2))).collect()}
    assert got[datetime(2024, 1, 2, 10, 0)]["has_contiguous_horizon_60m"] == 0 and got[datetime(2024, 1, 2, 10, 31)]["has_contiguous_horizon_60m"] == 1


def test_later_sessions_change_nothing_before(spark, bars, matrix):
    last = F.to_date("bar_ts") == DAYS[-1]
    changed = bars.withColumns({c: F.when(last, F.col(c) * 3).otherwise(F.col(c)) for c in ("high", "low", "close", "volume")})
    again = {(r["symbol"], r["bar_ts"]): r for r in X.feature_matrix(changed).collect()}
    assert all(again[k] == r for k, r in matrix.items() if r["session_date"] < DAYS[-1]) and any(again[k] != r for k, r in matrix.items())


def test_zoned_times_and_missing_columns_are_refused(bars):
    with pytest.raises(ValueError, match="without a zone"):
        X.feature_matrix(bars.withColumn("bar_ts", F.col("bar_ts").cast("timestamp")))
    with pytest.raises(ValueError, match="high"):
        X.feature_matrix(bars.drop("high"))


def test_special_sessions_and_other_minutes_are_left_out(spark):
    days = [date(2023, 11, 10), date(2023, 11, 12), date(2023, 11, 13)]
    out = X.feature_matrix(spark.createDataFrame(bars_of(days, minutes=380), BARS).drop("volume", "oi"))
    assert sorted((r["session_date"], r["n"]) for r in out.groupBy("session_date").agg(F.count("*").alias("n")).collect()) == [(days[0], 375), (days[2], 375)]
    first = out.where((F.col("session_date") == days[2]) & (F.col("minute_of_day") == 555)).first()
    before = 100 + 374 * 0.02
    assert first["true_gap_pct"] == pytest.approx((101.5 + 379 * 0.02 - before) / before)


def test_calendar_columns(spark):
    days = sessions_from(date(2025, 8, 1), 70)
    trading = spark.createDataFrame([(d,) for d in days], "date date")
    dates = trading.select(F.col("date").alias("trade_date"))
    got = {r["c_date"]: r["days_to_expiry"] for r in X.calendar_columns(dates, trading).collect()}
    expiries = [date(2025, 8, 28), date(2025, 9, 25), date(2025, 9, 30), date(2025, 10, 28), days[-1]]  # the last month ends with what was observed
    for d in days:
        front = min((e for e in expiries if e >= d), default=None)
        assert got[d] == (None if front is None else days.index(front) - days.index(d) + 1)
    known = spark.createDataFrame([(date(2025, 8, 4), date(2025, 8, 7)), (date(2025, 8, 5), None)], "trade_date date, front_expiry date")
    with_known = {r["c_date"]: (r["days_to_expiry"], r["expiry_week"]) for r in X.calendar_columns(dates, trading, calendar=known).collect()}
    assert with_known[date(2025, 8, 4)] == (4, 1.0) and with_known[date(2025, 8, 5)] == (None, None) and with_known[date(2025, 8, 6)][0] == got[date(2025, 8, 6)]


def test_index_of_the_day_before_only(spark):
    days = sessions_from(date(2023, 1, 2), 260)
    trading = spark.createDataFrame([(d,) for d in days], "date date")
    values = {d: 11.0 + k for k, d in enumerate(days)}
    del values[days[100]]
    vix = spark.createDataFrame(list(values.items()), "date date, close double")
    got = {r["c_date"]: r for r in X.calendar_columns(trading.select(F.col("date").alias("trade_date")), trading, vix=vix).collect()}
    assert got[days[-1]]["vix_t1_return"] == pytest.approx(math.log(values[days[-2]] / values[days[-3]]))
    assert got[days[101]]["vix_t1_return"] is None and got[days[0]]["vix_t1_return"] is None
    year = [values[d] for d in days[:-1] if d in values][-252:]
    assert got[days[-1]]["vix_t1_z252"] == pytest.approx((values[days[-2]] - np.mean(year)) / np.std(year)) and got[days[200]]["vix_t1_z252"] is None


@pytest.mark.parametrize("span", [1, 2, 9, 21, 400])
def test_exponential_mean_over_many_blocks(spark, span):
    rng = np.random.default_rng(span)
    x = {k: rng.normal(size=n) * 50 + 10 for k, n in (("a", 1300), ("b", 1), ("c", 700))}
    rows = [(k, i, float(v)) for k, vs in x.items() for i, v in enumerate(vs)]
    got = E.ema(spark.createDataFrame(rows, "k string, i long, x double"), "x", span, "e", ("k",), "i").collect()
    for k, vs in x.items():
        e, want = vs[0], []
        for v in vs:
            e = e + 2 / (span + 1) * (v - e)
            want.append(e)
        assert np.allclose([r["e"] for r in sorted(got, key=lambda r: r["i"]) if r["k"] == k], want, rtol=1e-10, atol=1e-9)


@pytest.fixture(scope="module")
def short(spark):
    return spark.createDataFrame(bars_of(DAYS, minutes=40) + bars_of(DAYS[3:], "g", 35, 2.0), BARS)


def names(short):
    return X.calendar_columns(short.select(F.to_date("bar_ts").alias("trade_date")).distinct(), short.select(F.to_date("bar_ts").alias("date")).distinct())


def test_session_by_session_equals_the_batch(spark, short, tmp_path):
    want = {(r["symbol"], r["bar_ts"]): r for r in X.feature_matrix(short).collect()}
    (tmp_path / "bars").mkdir()
    stream = spark.readStream.schema(short.schema).parquet(f"{tmp_path}/bars")
    for part in (DAYS[:21], DAYS[21:]):
        short.where(F.to_date("bar_ts").isin(part)).write.mode("append").parquet(f"{tmp_path}/bars")
        out = S.run_sessions(spark, stream, str(tmp_path), names(short)).collect()
    got = {(r["symbol"], r["bar_ts"]): r for r in out}
    assert len(out) == len(want) and got.keys() == want.keys()
    for k, w in want.items():
        for c in w.asDict():
            assert got[k][c] == (pytest.approx(w[c], rel=1e-9, abs=1e-12) if isinstance(w[c], float) else w[c]), (k, c)
    assert sum(w["volume_surprise_60d"] is not None for w in want.values()) > 0


def test_an_older_session_is_refused(spark, short, tmp_path):
    (tmp_path / "bars").mkdir()
    stream = spark.readStream.schema(short.schema).parquet(f"{tmp_path}/bars")
    one = lambda d: short.where((F.to_date("bar_ts") == d) & (F.col("symbol") == "f"))
    one(DAYS[1]).write.mode("append").parquet(f"{tmp_path}/bars")
    S.run_sessions(spark, stream, str(tmp_path), names(short))
    one(DAYS[0]).write.mode("append").parquet(f"{tmp_path}/bars")
    with pytest.raises(Exception, match="increasing order"):
        S.run_sessions(spark, stream, str(tmp_path), names(short))


def test_baselines_of_a_session_are_those_of_its_minutes():
    rng = np.random.default_rng(4)
    layers = [np.where(rng.random((X.MINUTES, 4)) < 0.4, np.nan, rng.normal(size=(X.MINUTES, 4))) for _ in range(34)]
    got = S._baselines(layers)
    for m in range(X.MINUTES):
        known = [v[np.isfinite(v)] for v in np.stack(layers)[:, m].T]
        known = [v if len(v) >= X.LEAST else np.array([np.nan]) for v in known]
        want = [*(np.median(known[i]) for i in (0, 2, 3)), known[1].mean(), known[1].std() if len(known[1]) > 1 else np.nan]
        np.testing.assert_allclose([g[m] for g in got], want, rtol=1e-12, atol=1e-12)
    assert all(np.isnan(g).all() for g in S._baselines(layers[: X.LEAST - 1]))
