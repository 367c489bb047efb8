"""Contract calendars, day files, surfaces and gates by hand."""

from __future__ import annotations

import math
import random
import statistics
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import contracts as X
from saltmarsh.operators import metrics as M
from saltmarsh.operators import select as C
from saltmarsh.sources import tables as T

D = date(2024, 1, 1)
LADDER_IN = "trade_date date, expiry date, id string, close double, oi double"
BARS = "bar_ts timestamp_ntz, close double, volume double, oi double"


def _at(day: int, time: str) -> datetime:
    h, m, s = map(int, time.split(":"))
    return datetime(2024, 1, day, h, m, s)


def _rows(spark):
    out = []
    for day in (1, 2, 3, 4):
        for k, expiry in enumerate((2, 9, 16, 23)):
            out += [(date(2024, 1, day), date(2024, 1, expiry), f"c{k}", 100.0 + 10 * k, 1000.0 * (k + 1))] * 2
    return spark.createDataFrame([*out, (D, date(2023, 12, 1), "old", 1.0, 1.0)], LADDER_IN)


def test_ladder_drops_expired_contracts_and_keeps_expiry_day(spark):
    got = {r["trade_date"].day: r for r in X.contract_ladder(_rows(spark), "trade_date", "expiry", "id", ["close", "oi"]).collect()}
    assert [got[2][f"{n}_id"] for n in X.NAMES] == ["c0", "c1", "c2"] and got[3]["front_id"] == "c1" and got[3]["third_oi"] == 4000.0
    few = X.contract_ladder(_rows(spark).where("id = 'c0'"), "trade_date", "expiry", "id", ["close", "oi"]).orderBy("trade_date").collect()
    assert [r["next_id"] for r in few] == [None, None] and len(few) == 2


@pytest.mark.parametrize(("bars", "want"), [
    ([(_at(2, "15:30:00"), 101.0, 1.0, 1900.0), (_at(2, "15:31:00"), 500.0, 1.0, 0.0), (_at(3, "15:29:00"), 119.0, 1.0, None)], {"expiry_day": ("15:30:00", "front", "next", "PASS"), "day_after": ("15:29:00", "next", None, "FAIL")}),
    ([(_at(3, "10:00:00"), None, 1.0, 2100.0)], {"expiry_day": (None, None, None, "missing_bars"), "day_after": ("10:00:00", None, "front", "unusable")}),
])
def test_roll_evidence(spark, bars, want):
    ladder = X.contract_ladder(_rows(spark), "trade_date", "expiry", "id", ["close", "oi"])
    got = {r["role"]: (r["bar_time"], r["by_close"], r["by_oi"], r["verdict"]) for r in X.roll_evidence(ladder, spark.createDataFrame(bars, BARS)).collect()}
    assert got == want


def test_an_expiry_on_the_last_day_of_the_ladder_has_no_evidence(spark):
    ladder = X.contract_ladder(_rows(spark).where("trade_date <= DATE '2024-01-02'"), "trade_date", "expiry", "id", ["close", "oi"])
    assert X.roll_evidence(ladder, spark.createDataFrame([], BARS)).count() == 0


def test_expiry_sources(spark):
    rows = [(D, date(2024, 1, 25), "7", "udiff"), (D, date(2024, 1, 25), "x", "legacy"), (D, date(2024, 1, 31), "y", "legacy"), (D + timedelta(1), date(2024, 1, 31), "y", "legacy"), (D, date(2024, 2, 7), "z", None)]
    got = {r["expiry"]: r for r in X.expiry_sources(spark.createDataFrame(rows, "day date, expiry date, id string, source string"), "day", "expiry", "id", "source", "udiff").collect()}
    assert (got[date(2024, 1, 25)]["ids"], got[date(2024, 1, 25)]["sources"], got[date(2024, 1, 25)]["weekday_before"]) == ("7", "legacy;udiff", None)
    assert (got[date(2024, 1, 31)]["weekday_before"], got[date(2024, 1, 31)]["last_day"]) == (3, D + timedelta(1))
    assert (got[date(2024, 2, 7)]["weekday_before"], got[date(2024, 2, 7)]["ids"]) == (None, "z")


def test_absent_weekdays_and_coverage(spark):
    days = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 5),), (date(2024, 1, 9),), (None,)], "day date")
    assert [r["day"] for r in X.absent_weekdays(days, "day").collect()] == [date(2024, 1, 8)]
    assert X.absent_weekdays(days.limit(0), "day").count() == 0
    other = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 3, 1),), (date(2025, 1, 1),)], "day date")
    assert [tuple(r) for r in X.coverage_by_year(days.where("day IS NOT NULL"), other, "day").collect()] == [(2024, 2, 2, 1)]


def test_backfill_forensics(spark):
    bars = [
        (_at(1, "09:15:00"), 10.0, 5.0, 100.0), (_at(1, "09:16:00"), 11.0, 5.0, 80.0), (_at(1, "15:28:00"), 12.0, 0.0, 0.0), (_at(1, "15:29:00"), 13.0, 0.0, 0.0),
        (_at(2, "09:15:00"), 10.0, 0.0, 0.0), (_at(2, "09:16:00"), 11.0, None, 0.0), (_at(3, "09:15:00"), 10.0, 1.0, 0.0), (_at(3, "09:16:00"), 10.0, 1.0, None), (_at(3, "09:17:00"), 10.0, 1.0, 0.0),
    ]
    calendar = [(date(2024, 1, d), 10.0, 2.0 if d != 3 else 0.0, 5, 100.0) for d in (1, 2, 3, 4)]
    got = {r["trade_date"].day: r for r in X.backfill_forensics(spark.createDataFrame(bars, BARS), spark.createDataFrame(calendar, "trade_date date, front_close double, front_volume double, lot int, front_oi double")).collect()}
    a = got[1]
    assert (a["close_time"], a["close_observed"], a["oi_time"], a["oi_observed"], a["zero_tail"], a["zero_from"]) == ("09:16:00", 11.0, "09:16:00", 80.0, 2, "15:28:00")
    assert [a[c] for c in ("close_rel", "last_close_rel", "oi_rel", "volume_ratio", "raw_volume_ratio")] == pytest.approx([0.1, 0.3, -0.2, 1.0, 5.0])
    assert (got[2]["zero_tail"], got[2]["close_time"], got[2]["oi_observed"]) == (2, "09:16:00", 0.0)
    assert (got[3]["zero_tail"], got[3]["zero_from"], got[3]["volume_ratio"]) == (1, "09:17:00", None)
    assert (got[4]["found"], got[4]["bars"], got[4]["zero_tail"]) == (False, None, None)
    report = {(r["what"], r["level"]): r["n"] for r in X.vintages(spark.createDataFrame([(True, 3, "15:30:00", 0.0), (True, 3, "15:29:00", 5.0), (False, None, None, None)], "found boolean, bars long, last_time string, last_oi double"), F.lit("v")).collect()}
    assert report == {("days", ""): 2, ("bars", "3"): 2, ("last_time", "15:30:00"): 1, ("last_time", "15:29:00"): 1, ("zero_last_oi", ""): 1, ("until_close", ""): 1}


def test_surface_against_plain_python(spark):
    rng = random.Random(3)
    quotes = [(_at(1, f"10:{m:02d}:00"), rng.choice([None, *range(1, 25)]), rng.choice([None, "CE", "PE"]), rng.choice([None, 0.0, 1.0, 2.0])) for m in range(12) for _ in range(rng.choice([3, 40, 160]))]
    quotes.append((_at(1, "11:00:00"), 5, "CE", 0.0))
    df = spark.createDataFrame(quotes, "at timestamp_ntz, strike int, kind string, price double").repartition(3)
    want = {}
    for at in {q[0] for q in quotes}:
        parsed = [q for q in quotes if q[0] == at and q[1] is not None and q[2] is not None]
        if parsed:
            active = [q for q in parsed if (q[3] or 0) > 0]
            mid = statistics.median(q[1] for q in active) if active else None
            sides = [len({q[1] for q in active if q[2] == k and (q[1] < mid if below else q[1] > mid)}) for k in ("CE", "PE") for below in (True, False)]
            want[at] = (mid, *sides, min(sides) >= 5)
    got = {r["at"]: tuple(r[c] for c in ("middle", "ce_below", "ce_above", "pe_below", "pe_above", "valid")) for r in X.surface_minutes(df, [], "at", "strike", "kind", "price").collect()}
    assert got == want and {v[-1] for v in want.values()} == {True, False}
    share = X.surface_share(X.surface_minutes(df, [], "at", "strike", "kind", "price"), [], "at").first()
    assert (share["session_minutes"], share["valid_minutes"]) == (len(want), sum(v[-1] for v in want.values()))


def test_series_faults(spark):
    s = spark.createDataFrame([("a", D, 1.0, None), ("a", D, 1.0, None), ("b", D, 1.0, "x"), ("b", D, 1.0, None), ("c", D, 1.0, "x")], "k string, day date, v double, w string")
    calendar = spark.createDataFrame([("a", D), ("c", D + timedelta(1))], "k string, day date")
    assert {(r["k"], r["day"], r["fault"], r["n"]) for r in X.series_faults(s, calendar, ["k"], "day").collect()} == {("a", D, "identical", 2), ("b", D, "differing", 2), ("c", D + timedelta(1), "missing", 0)}


def test_summary_deltas(spark):
    t = spark.createDataFrame([("a", D, "STOP", 1.0), ("a", D, "STOP", 3.0), ("a", D + timedelta(1), None, None)], "k string, day date, reason string, net double")
    one = {r["metric"]: r["value"] for r in M.trade_summary(t, ["k"], "reason", "net", "day").collect()}
    assert one == pytest.approx({"trades": 3.0, "net": 4.0, "exit_STOP": 2.0, "exit_unknown": 1.0, "daily_sharpe": 2 / statistics.stdev([4.0, 0.0]) * math.sqrt(252)})
    pair = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    got = {r["metric"]: (r["relative"], r["passed"]) for r in M.summary_deltas(pair([("trades", 101.0), ("net", 0.0), ("exit_STOP", 1.0), ("odd", 2.0)]), pair([("trades", 100.0), ("net", 0.0), ("exit_TIME", 4.0), ("odd", 1.0)]), []).collect()}
    assert got == {"trades": (pytest.approx(0.01), True), "net": (0.0, True), "exit_STOP": (math.inf, False), "exit_TIME": (-1.0, False), "odd": (1.0, None)}


def test_entries_gates_and_front_months(spark):
    times = ["09:44:00", "09:45:00", "10:59:00", "11:00:00", "11:59:00", "12:00:00", "14:54:00", "14:55:00"]
    rows = spark.createDataFrame([(_at(1, t), g) for t in times for g in (None, "trend", "compression")], "bar_ts timestamp_ntz, regime string")
    kept = [(r["bar_ts"].strftime("%H:%M"), r["regime"]) for r in C.entry_eligible(rows).collect()]
    assert sorted({t for t, _ in kept}) == ["09:45", "10:59", "12:00", "14:54"] and {g for _, g in kept} == {None, "trend"} and len(kept) == 8
    assert C.regime_gate(rows, F.col("regime"), None).count() == 24 and C.regime_gate(rows, F.col("regime"), ["trend"]).count() == 8 and C.regime_gate(rows, F.col("regime"), []).count() == 0
    s = spark.createDataFrame([("x", "A-I"), ("x", "A-II"), ("x", None), ("y", "B-II"), ("y", None), (None, "c-i "), (None, "C-II")], "g string, symbol string")
    assert sorted(map(str, ((r["g"], r["symbol"]) for r in C.front_month(s, ["g"]).collect()))) == sorted(map(str, [("x", "A-I"), ("y", "B-II"), ("y", None), (None, "c-i ")]))


def test_fill_is_blocked_by_drift(spark):
    source = spark.createDataFrame([(_at(1, "09:15:00"), D, 1.234), (_at(2, "09:14:00"), D + timedelta(1), 1.0), (_at(2, "15:29:00"), D + timedelta(1), 2.345)], "bar_ts timestamp_ntz, trade_date date, close double")
    overlap = lambda drift: spark.createDataFrame([(drift,)], "drift boolean")
    out = T.fill_archive(source, source.limit(1), ["trade_date"], overlap(False), ["close"]).collect()
    assert [(r["bar_ts"], r["close"]) for r in out] == [(_at(2, "15:29:00"), pytest.approx(2.35, abs=0.011))]
    with pytest.raises(ValueError, match="drift"):
        T.fill_archive(source, source.limit(1), ["trade_date"], overlap(True), ["close"])
