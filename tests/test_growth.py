"""Steps that must not depend on how many rows one key has: plans without a window over a key's rows, and results across stretches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from saltmarsh.operators import audit, metrics
from saltmarsh.streaming import jobs


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_drawdown_across_days(spark):
    rng = random.Random(3)
    rows = [("a", d, i, float(rng.randint(-9, 9))) for d in range(20) for i in range(15)] + [("b", 1, 1, None), ("b", 2, 1, -4.0), ("b", 3, 1, None)]
    total = peak = worst = 0.0
    for k, *_, v in rows:
        if k == "a":
            total += v
            peak, worst = max(peak, total), min(worst, total - max(peak, total))
    df = metrics.drawdown(spark.createDataFrame(rows, "k string, day long, i long, v double"), ["k"], "v", ["day", "i"])
    assert dict(map(tuple, df.collect())) == {"a": worst, "b": -4.0}
    assert "windowspecdefinition(k#" in plan(df) and ", day#" in plan(df).split("windowspecdefinition(k#")[-1][:20]


def test_distribution_counts_equal_values(spark):
    values = [float(i % 7) for i in range(100)]
    df = metrics.distribution(spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, i long, v double"), ["k"], "v", ["i"])
    s = sorted(values)
    assert tuple(df.first())[1:] == tuple(s[int(q * 99)] for q in (0, 0.05, 0.5, 0.95, 1))
    assert "row_number" not in plan(df)


def test_selection_folds_need_no_join(spark):
    df = metrics.selection_folds(spark.createDataFrame([("a", i % 12, 1.0) for i in range(24)], "k string, d int, v double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d"))), ["k"], "v")
    assert sorted((r["kind"], r["fold"], r["n"], r["days"]) for r in df.collect()) == [("bucket", "0", 10, 5), ("bucket", "1", 10, 5), ("bucket", "2", 4, 2)]
    assert "Join" not in plan(df)


def test_running_state_over_batches(spark, tmp_path):
    for n in range(2):
        spark.createDataFrame([(10 * n + i, f"2024-01-0{1 + n + i % 2} 00:00:0{i}", "k", float(10 * n + i)) for i in range(4)], "event_id long, t string, k string, v double").withColumn("t", F.col("t").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, t timestamp_ntz, k string, v double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {r["event_id"]: r["previous"] for r in jobs.running_state(stream, "k", "t", "v").collect()}
    assert got == {0: None, 2: 0.0, 1: 2.0, 3: 1.0, 10: 3.0, 12: 10.0, 11: 12.0, 13: 11.0}


def test_chains_stream(spark):
    df = audit.chain_hashes(spark.createDataFrame([(b, i) for b in "xy" for i in range(3000)], "b string, i long"), ["b"], ["i"], F.col("i").cast("string"))
    rows = sorted(map(tuple, df.collect()))
    assert all(a[3] == b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0]) and [r[2] for r in rows if r[1] == 0] == ["GENESIS"] * 2
    assert "collect_list" not in plan(df)
