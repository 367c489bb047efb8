"""The feature matrices session by session: keyed state in place of the batch's windows over earlier sessions.

Bars land session by session.  A first query computes, for each batch, what the
sessions say by themselves (``matrix.intraday``) and writes it under the batch's
number, so that a repeated batch replaces itself.  A second query adds, from
state, what earlier sessions say:

- for each symbol its last session, the number and close of that, and the opening
  range widths of the last 60 sessions; a session that is not after the last one
  is refused;
- for each symbol the compared values of the last 60 sessions, one array of all
  minutes a session, so that state is read and written once a symbol and batch.

A batch holds whole sessions.  State is bounded by 60 entries of 12 KB a symbol, and
a task takes one symbol's sessions of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from saltmarsh.operators import matrix as X

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SESSION_FIELDS = [T.StructField("session_idx", T.LongType()), T.StructField("prior_close", T.DoubleType()), T.StructField("opening_range_width_z60", T.DoubleType())]
_BASE_FIELDS = [T.StructField(c, T.DoubleType()) for c in ("volume_base", "rr_15_base", "rr_30_base", "vwap_dev_mean", "vwap_dev_sd")]


@contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    """State with several variables a key needs the RocksDB store; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _enough(values: list[float | None]) -> np.ndarray | None:
    known = np.array([v for v in values if v is not None and np.isfinite(v)])
    return known if len(known) >= X.LEAST else None


def _baselines(layers: list[np.ndarray]) -> list[np.ndarray]:
    """For each minute the medians of volume and ranges, and mean and deviation of vwap_dev, over the layers that know them."""
    if len(layers) < X.LEAST:
        return [np.full(X.MINUTES, np.nan)] * len(_BASE_FIELDS)
    values = np.sort(np.stack(layers), axis=0)  # NaN last
    n = np.isfinite(values).sum(0)
    middle = lambda at: np.take_along_axis(values, np.maximum(at, 0)[None], 0)[0]
    median = np.where(n >= X.LEAST, (middle((n - 1) // 2) + middle(n // 2)) / 2, np.nan)
    volume, vwap_dev, rr_15, rr_30 = range(len(X.COMPARED))
    dev, known = values[:, :, vwap_dev], n[:, vwap_dev]
    enough = np.where(known >= X.LEAST, known, np.nan)
    mean = np.nansum(dev, 0) / enough
    return [median[:, volume], median[:, rr_15], median[:, rr_30], mean, np.sqrt(np.nansum((dev - mean) ** 2, 0) / enough)]


class SymbolState(StatefulProcessor):
    """Numbers the sessions of a symbol; adds the prior close, the z-score of the opening range's width, and the minutes' baselines."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "trade_date date, session_idx long, day_close double")
        self.widths = handle.getListState("widths", "width double")
        self.seen = handle.getListState("seen", "session_idx long, layer binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.last.get() if self.last.exists() else None
        day, idx, close = last if last else (None, 0, None)
        widths = [w[0] for w in self.widths.get()] if self.widths.exists() else []
        seen = [(i, np.frombuffer(b).reshape(X.MINUTES, -1)) for i, b in self.seen.get()] if self.seen.exists() else []
        for session, part in pd.concat(rows).sort_values("bar_ts").groupby("trade_date", sort=True):
            if day is not None and session <= day:
                raise ValueError(f"session {session} of {key[0]} comes after {day}: sessions must arrive in increasing order")
            idx += 1
            width, known = float(part["width"].iloc[0]), _enough(widths)
            sd = known.std() if known is not None else 0.0
            z = (width - known.mean()) / sd if sd > 0 and np.isfinite(width) else np.nan
            seen = [s for s in seen if s[0] >= idx - X.BASELINE]
            at, base = part["minute_of_day"].to_numpy() - X.FIRST, _baselines([layer for _, layer in seen])
            yield part.assign(session_idx=idx, prior_close=np.nan if close is None else close, opening_range_width_z60=z, **{f.name: b[at] for f, b in zip(_BASE_FIELDS, base, strict=True)})
            values, nth = part[list(X.COMPARED)].to_numpy(np.float64), part.groupby("minute_of_day").cumcount().to_numpy()
            for k in range(nth.max() + 1):  # a second bar of a minute has a layer of its own
                layer = np.full((X.MINUTES, len(X.COMPARED)), np.nan)
                layer[at[nth == k]] = np.where(np.isfinite(values[nth == k]), values[nth == k], np.nan)
                seen.append((idx, layer))
            widths, day, close = [*widths, width][-X.BASELINE :], session, float(part["day_close"].iloc[0])
        self.last.update((day, idx, close))
        self.widths.put([(w,) for w in widths])
        self.seen.put([(i, layer.tobytes()) for i, layer in seen])

    def close(self) -> None:
        pass


def with_history(stream: DataFrame) -> DataFrame:
    """``intraday`` rows that arrive session by session, with the columns of ``session_history`` and ``minute_baselines``."""
    based = T.StructType([*stream.schema.fields, *_SESSION_FIELDS, *_BASE_FIELDS])
    return stream.groupBy("symbol").transformWithStateInPandas(SymbolState(), based, "append", "None")


def run_sessions(spark: SparkSession, bars: DataFrame, folder: str, named: DataFrame, special=X.SPECIAL_SESSIONS) -> DataFrame:
    """The matrix of all bars that have come so far; ``bars`` is a stream of whole sessions, ``named`` of ``calendar_columns``.

    ``folder`` keeps results and progress: called again after more sessions have
    landed, only those are computed.
    """

    def intraday(batch: DataFrame, batch_id: int) -> None:
        X.intraday(X.regular_bars(batch, special)).write.mode("overwrite").parquet(f"{folder}/intraday/batch={batch_id}")

    bars.writeStream.foreachBatch(intraday).option("checkpointLocation", f"{folder}/first").trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(f"{folder}/intraday").drop("batch")
    # A batch of the second query is one of the first: sessions come in the order in which they were written.
    stream = spark.readStream.schema(T.StructType([*written.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/intraday").drop("batch")
    with _state_store(spark):
        matrix = X.finish(with_history(stream).join(named, F.col("trade_date") == F.col("c_date"), "left"))
        query = matrix.writeStream.format("parquet").option("path", f"{folder}/matrix").option("checkpointLocation", f"{folder}/second").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{folder}/matrix")
