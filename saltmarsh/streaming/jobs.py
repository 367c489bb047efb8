"""Structured Streaming jobs over file sources; each runs what is there and stops."""

from __future__ import annotations

import re
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession) -> str:
    """A new folder in ``spark.checkpoint.dir``; on one machine, where that is unset, in a folder of our own."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="streams-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write the stream to Parquet until the input is used up; the rows written."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def land(stream: DataFrame, raw: list[str], time: str, delay: str) -> DataFrame:
    """Append-only landing: the payload's digest, duplicates within the watermark skipped."""
    digest = F.sha2(F.concat_ws("|", *raw), 256)
    return stream.withColumn("digest", digest).withColumn("received", F.col(time).cast("timestamp")).withWatermark("received", delay).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """Counts and sums by window; rows later than the watermark are dropped, windows are written once closed."""
    s = stream.withColumn("at", F.col(time).cast("timestamp")).withWatermark("at", delay)
    return s.groupBy(F.window("at", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), key, "n", "total")


def latest(stream: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Newest record of each key over all batches: each batch is reduced, and the reduced rows meet at the end."""
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)

    def reduce_batch(df: DataFrame, _: int) -> None:
        df.groupBy(key).agg(F.max_by(F.struct(time, *columns), F.struct(time, *columns)).alias("r")).write.mode("append").parquet(f"{folder}/out")

    q = stream.writeStream.foreachBatch(reduce_batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy(key).agg(F.max_by("r", "r").alias("r")).select(key, "r.*")


def running_state(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Previous value of the key for each row, carried across batches: event_id, key, previous.

    A key's rows of a day are sorted by themselves; the first of them takes the last
    value of the day before, or that of the batches before, which each batch leaves
    under its number.  So no task has a key's rows of a batch, however many come.
    """
    spark, folder = stream.sparkSession, scratch(stream.sparkSession)
    state = T.StructType([T.StructField("s_key", stream.schema[key].dataType), T.StructField("last", T.StructType([T.StructField("v", stream.schema[value].dataType)])), T.StructField("batch", T.LongType())])

    def step(df: DataFrame, n: int) -> None:
        rows = df.select("event_id", F.col(key).alias("k"), F.col(time).alias("t"), F.col(value).alias("v"), F.to_date(time).alias("day"))
        ends = rows.groupBy("k", "day").agg(F.max_by(F.struct("v"), F.struct("t", "event_id")).alias("end"))
        # The folder of batch -1 is there from the start, with no rows.
        known = spark.read.schema(state).option("recursiveFileLookup", "true").parquet(f"{folder}/state").where(F.col("batch") < n).groupBy("s_key").agg(F.max_by("last", "batch").alias("last"))
        by_day = ends.withColumn("before", F.lag("end").over(Window.partitionBy("k").orderBy("day"))).join(F.broadcast(known), F.col("k").eqNullSafe(F.col("s_key")), "left")
        by_day = by_day.select(F.col("k").alias("d_k"), F.col("day").alias("d_day"), F.coalesce("before", "last")["v"].alias("carried"))
        w = Window.partitionBy("k", "day").orderBy("t", "event_id")
        inner = rows.withColumn("first", F.row_number().over(w) == 1).withColumn("lag", F.lag("v").over(w))
        out = inner.join(by_day, F.col("k").eqNullSafe(F.col("d_k")) & F.col("day").eqNullSafe(F.col("d_day")))
        out.select("event_id", F.col("k").alias(key), F.when(F.col("first"), F.col("carried")).otherwise(F.col("lag")).alias("previous")).write.mode("overwrite").parquet(f"{folder}/out/{n}")
        last = ends.groupBy(F.col("k").alias("s_key")).agg(F.max_by("end", F.struct("day")).alias("last"))
        last.select("s_key", "last", F.lit(n).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{folder}/state/{n}")

    spark.createDataFrame([], state).write.parquet(f"{folder}/state/-1")
    out = f"event_id long, {key} {stream.schema[key].dataType.simpleString()}, previous {stream.schema[value].dataType.simpleString()}"
    spark.createDataFrame([], out).write.parquet(f"{folder}/out/-1")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def chain_violations(log: DataFrame, key: str, order: str, content: str, stored: str, previous: str, rising: tuple[list[str], str] | None = None) -> DataFrame:
    """Rows whose stored digest is not that of their content, whose link is not the one before, or whose id repeats.

    With ``rising`` (keys, number) also rows whose number is not above the one before
    of those keys, as bars of a session must be.
    """
    w = Window.partitionBy(key).orderBy(order)
    bad_hash, bad_link = F.col(stored) != F.sha2(content, 256), ~F.col(previous).eqNullSafe(F.coalesce(F.lag(stored).over(w), F.lit("GENESIS")))
    repeated = F.count("*").over(Window.partitionBy(key, order)) > 1
    found = [F.when(bad_hash, F.lit("content")), F.when(bad_link, F.lit("link")), F.when(repeated, F.lit("duplicate"))]
    if rising:
        found.append(F.when(F.col(rising[1]) <= F.lag(rising[1]).over(Window.partitionBy(*rising[0]).orderBy(order)), F.lit("order")))
    reasons = F.filter(F.array(*found), lambda x: x.isNotNull())
    return log.withColumn("violations", F.array_join(reasons, ",")).where("violations <> ''")


def slot_baseline(stream: DataFrame, sessions: int, least: int) -> DataFrame:
    """Mean of the value at a (symbol, slot) over the sessions before, from a bounded list in keyed state.

    Rows of a key may come in several batches, in session order; an older session
    than the last one seen is not given a value.
    """

    def step(k: tuple, frames, state: GroupState):
        idx, val = (list(state.get[0]), list(state.get[1])) if state.exists else ([], [])
        out = []
        for r in pd.concat(frames).sort_values("session_idx").itertuples():
            seen = [v for i, v in zip(idx, val, strict=True) if r.session_idx - sessions <= i < r.session_idx]
            late = bool(idx) and r.session_idx <= idx[-1]
            out.append((k[0], k[1], r.session_idx, sum(seen) / len(seen) if len(seen) >= least and not late else None))
            if not late:
                idx, val = [*idx, int(r.session_idx)][-sessions:], [*val, float(r.value)][-sessions:]
        state.update((idx, val))
        yield pd.DataFrame(out, columns=["symbol", "slot", "session_idx", "base_mean"])

    schema = "symbol string, slot long, session_idx long, base_mean double"
    return stream.groupBy("symbol", "slot").applyInPandasWithState(step, schema, "idx array<long>, val array<double>", "append", GroupStateTimeout.NoTimeout)


def label_stream(stream: DataFrame, key: str, time: str, horizon: int, up: float, down: float, delay: str, hold: str) -> DataFrame:
    """First-touch labels of bars as soon as their horizon is complete; the live form of ``labels.percent_barriers``.

    The state of a key is its last ``horizon`` bars.  Batches come in order of time;
    a bar not after the last one seen is given the outcome ``late``.  Where no bar
    of the key comes until the watermark is ``hold`` past its last one, the bars
    held are labelled by the path they have, the very last one as ``excluded``.
    """
    kept = [time, "open", "high", "low", "close"]
    wait = pd.Timedelta(hold)

    def label(k: str, rows: list[tuple]) -> tuple:
        path, entry = rows[1 : horizon + 1], rows[1][1] if len(rows) > 1 else None
        if not path:
            return (k, rows[0][0], "excluded", None, None)
        target, stop = entry * (1 + up), entry * (1 - down)
        for i, (_, _, high, low, _) in enumerate(path, 1):
            if low <= stop or high >= target:
                hit = low <= stop
                return (k, rows[0][0], "stop" if hit else "target", i, ((stop if hit else target) / entry - 1) * 10_000)
        return (k, rows[0][0], "timeout", len(path), (path[-1][4] / entry - 1) * 10_000)

    def step(k: tuple, frames, state: GroupState):
        held = [tuple(r) for r in zip(*state.get, strict=True)] if state.exists else []
        out = []
        if state.hasTimedOut:
            out = [label(k[0], held[i:]) for i in range(len(held))]
            state.remove()
        else:
            for row in pd.concat(frames)[kept].sort_values(time).itertuples(index=False, name=None):
                if held and row[0] <= held[-1][0]:
                    out.append((k[0], row[0], "late", None, None))
                    continue
                held.append(row)
                if len(held) > horizon:
                    out.append(label(k[0], held))
                    del held[0]
            state.update(tuple(list(c) for c in zip(*held, strict=True)))
            state.setTimeoutTimestamp(max(int((held[-1][0] + wait).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, time, "outcome", "bars_held", "gross_bps"]).astype({"bars_held": "Int64", "gross_bps": "Float64"})

    out = f"{key} string, {time} timestamp, outcome string, bars_held long, gross_bps double"
    held = f"at array<timestamp>, {', '.join(f'{c} array<double>' for c in kept[1:])}"
    s = stream.select(key, F.col(time).cast("timestamp").alias(time), *kept[1:]).withWatermark(time, delay)
    return s.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_of(df: DataFrame) -> DataFrame:
    """A file stream over what ``df`` has now."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)
