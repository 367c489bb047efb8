"""Hand-computed cases of checks, archives and the label stream."""

from __future__ import annotations

import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from saltmarsh.operators import audit, labels, select
from saltmarsh.sources import archives
from saltmarsh.streaming import jobs


def test_guard_names_blocked_columns():
    assert audit.guard_columns(["close", "rsi"]) == ["close", "rsi"]
    with pytest.raises(ValueError, match="Future_ret, news_count"):
        audit.guard_columns(["close", "news_count", "Future_ret"])


def test_artifact_is_not_rewritten(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    path = archives.write_immutable(df, str(tmp_path), "x")
    assert archives.write_immutable(df.orderBy(F.desc("k")), str(tmp_path), "x") == path
    with pytest.raises(ValueError, match="other content"):
        archives.write_immutable(df.withColumn("k", F.col("k") + 1), str(tmp_path), "x")
    assert spark.read.parquet(path).count() == 2


def test_zip_files_are_read(spark, tmp_path):
    for n, members in (("a", {"m.csv": 'k, note\n1,"two\nlines"\n2,é\n', "readme.txt": "x"}), ("b", {"n.csv": "k,note\n"})):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            for name, text in members.items():
                z.writestr(name, text)
    got = archives.read_zips(spark, str(tmp_path)).select("cells.k", "cells.note").orderBy("k").collect()
    assert [tuple(r) for r in got] == [("1", "two\nlines"), ("2", "é")]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("none.txt", "")
    with pytest.raises(Exception, match="0 CSV members"):
        archives.read_zips(spark, str(tmp_path)).collect()


def test_grid_item_without_horizon_is_an_error(spark):
    ok = spark.createDataFrame([('[{"target_bps":1,"stop_bps":2,"horizon_bars":3},[4,5,6,0.5]]',)], "grid string")
    assert [tuple(r) for r in archives.grid_table(ok, "grid").collect()] == [("grid_0", 1.0, 2.0, 3, None), ("grid_1", 4.0, 5.0, 6, 0.5)]
    with pytest.raises(Exception, match="horizon_bars"):
        archives.grid_table(spark.createDataFrame([("[[4,5]]",)], "grid string"), "grid").collect()


def test_corrections(spark):
    rows = [("a", False, True, "s", 5, 1, 9), ("b", False, True, "s", 5, 1, 9), ("b", True, True, "s", 5, 1, 9), ("c", False, True, "s", 5, 1, 9), ("c", True, True, "s", 4, 1, 9), ("d", True, None, "s", 4, 1, 9), ("e", False, True, "s", 5, None, None), ("e", True, True, "s", 5, None, None)]
    df = spark.createDataFrame(rows, "symbol string, fix boolean, ok boolean, kind string, n long, first long, last long")
    got = audit.resolve_corrections(df, "symbol", F.col("fix"), F.col("ok"), "kind", "n", "first", "last").orderBy("symbol", "fix").collect()
    assert [r["decision"] for r in got] == ["selected", "superseded", "selected_corrected", "quarantined", "quarantined", "invalid_schema", "quarantined", "quarantined"]


def test_session_scan(spark):
    slots = [1, 2, 2, 6, 5, 10]
    df = spark.createDataFrame([("x", i, s, 7.0 if i < 3 else float(i), i % 2, 0) for i, s in enumerate(slots)], "k string, at long, slot long, close double, volume long, oi long")
    r = audit.session_scan(df, ["k"], "slot", "at", 1, 10, 3).first()
    assert (r["gap_segments"], r["n_gaps"], r["duplicates"], r["non_monotonic"], r["constant"], r["zero_volume"], r["oi_all_zero"]) == ("3-4 (2); 7-9 (3)", 2, 1, 1, 3, 3, True)
    assert r["disposition"] == "exclude_labels_near_close"


def test_nearest_expiry_needs_volume(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 5), ("a", 3, 9), ("b", 1, 0)], "k string, expiry long, volume long")
    assert [tuple(r) for r in select.nearest_expiry(df, ["k"], "expiry", "volume").collect()] == [("a", 2, 5)]


def test_label_stream_over_batches(spark, tmp_path):
    """Bars in three batches: the same labels as the batch form, and a key that falls silent is finished by the watermark."""
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=i), 100.0 + (i * 7) % 11, 112.0 + (i * 5) % 14, 97.0 - (i * 3) % 12, 101.0 + (i * 7) % 11) for k, n in (("x", 60), ("y", 7)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double")
    source = tmp_path / "bars"
    for i, (a, b) in enumerate(((0, 20), (20, 40), (40, 60))):
        df.where(F.col("bar_ts").between(start + timedelta(hours=a), start + timedelta(hours=b - 1))).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    got = {(r[0], r[1]): tuple(r)[2:] for r in jobs.run(jobs.label_stream(stream, "symbol", "bar_ts", 4, 0.2, 0.1, "1 hour", "10 hours")).collect()}
    want = {(r["symbol"], r["bar_ts"]): (r["outcome"], r["bars_held"], r["gross_bps"]) for r in labels.percent_barriers(df, ["symbol"], "bar_ts", 4, 0.2, 0.1).collect()}
    done = [k for k in want if k[0] == "y" or k[1] < start + timedelta(hours=56)]
    assert sorted(got) == sorted(done)
    assert len({got[k][0] for k in done}) > 2
    for k in done:
        assert got[k][:2] == want[k][:2]
        assert got[k][2] == (pytest.approx(want[k][2]) if want[k][2] is not None else None)
