"""Functions of the caller over groups: by fold, scenario, seed or day."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a group that a function is given at most.
MOST_ROWS = 1_000_000


def evaluate(df: DataFrame, keys: list[str], columns: list[str], function: Callable[[dict, pd.DataFrame], dict], returns: str, order: list[str] = (), most_rows: int = MOST_ROWS) -> DataFrame:
    """One row a group: keys, the fields of ``returns``, n_rows and error.

    ``function`` gets the keys by name and the group's ``columns`` as a frame, sorted
    by ``order``, and gives one value for each field of ``returns``.  A group fails by
    itself: where the function raises, gives other fields, or a value that is not of
    the declared type, the fields are null and ``error`` says why; so does a group of
    more than ``most_rows`` rows, which is counted and never loaded.  Groups are split
    over tasks by their keys.
    """
    missing = sorted({*keys, *columns, *order} - set(df.columns))
    if missing:
        raise ValueError(f"no columns {missing}")
    fields = T._parse_datatype_string(returns)
    if not isinstance(fields, T.StructType) or {f.name for f in fields} & {*keys, "n_rows", "error"}:
        raise ValueError("returns must declare fields of other names than the keys, n_rows and error")
    names = [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]
    key_fields = [df.schema[k] for k in keys]
    out = T.StructType([*key_fields, *fields.fields, T.StructField("n_rows", T.LongType()), T.StructField("error", T.StringType())])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    large = sizes.where(F.col("__n") > most_rows)

    given_columns, needed = list(columns), [*dict.fromkeys([*keys, *columns])]

    def value(key: tuple, frame: pd.DataFrame) -> tuple[list, str | None]:
        try:
            given = function(dict(zip(keys, key, strict=True)), frame)
            if not isinstance(given, dict) or set(given) != set(names):
                raise TypeError(f"the function gave {sorted(given) if isinstance(given, dict) else type(given).__name__}, not {names}")
            cut = [n for n, t in zip(names, kinds, strict=True) if pa.types.is_integer(t) and given[n] is not None and given[n] != int(given[n])]
            if cut:
                raise TypeError(f"{cut} are no whole numbers")
            return [pa.array([given[n]], t) for n, t in zip(names, kinds, strict=True)], None
        except Exception as e:  # noqa: BLE001  (whatever the caller's function raises is its group's error)
            return [pa.nulls(1, t) for t in kinds], f"{type(e).__name__}: {e}"[:500]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups of sorted rows; many share a batch, and one may span several."""
        held: list[pa.Table] = []
        done: list[tuple] = []

        def close(frame: pd.DataFrame | None = None) -> None:
            if held:
                table = pa.concat_tables(held)
                key = tuple(table.column(k)[0].as_py() for k in keys)
                done.append((key, *value(key, table.select(given_columns).to_pandas() if frame is None else frame), table.num_rows))
                held.clear()

        def flush() -> pa.RecordBatch:
            columns_ = [pa.array([d[0][i] for d in done], to_arrow_type(f.dataType)) for i, f in enumerate(key_fields)]
            columns_ += [pa.concat_arrays([d[1][i] for d in done]) for i in range(len(names))]
            batch = pa.RecordBatch.from_arrays([*columns_, pa.array([d[3] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], out.names)
            done.clear()
            return batch

        for batch in batches:
            table = pa.Table.from_batches([batch.select([*needed, "__first"])])
            starts = np.flatnonzero(table.column("__first").to_numpy())
            edges = [*starts.tolist(), table.num_rows]
            if edges[0]:
                held.append(table.slice(0, edges[0]))
            # Integers with nulls become floats in pandas, which must not depend on the neighbours.
            plain = all(not c.null_count or pa.types.is_floating(c.type) or pa.types.is_string(c.type) for c in table.select(given_columns).columns)
            frame = table.select(given_columns).to_pandas() if plain else None
            for a, b in zip(edges, edges[1:], strict=False):
                close()
                held.append(table.slice(a, b - a))
                if b < table.num_rows and frame is not None:
                    close(frame.iloc[a:b].reset_index(drop=True))
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    marked = large.select(*[F.col(k).alias(f"__l{i}") for i, k in enumerate(keys)])
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__l{i}"))
    # The window leaves a group's rows in one task, together and in order; large groups are few by their size.
    small = df.select(*dict.fromkeys([*needed, *order])).join(F.broadcast(marked), on, "left_anti")
    w = Window.partitionBy(*keys).orderBy(*[F.col(o).asc_nulls_last() for o in order] or [F.lit(0)])
    sorted_rows = small.withColumn("__first", F.row_number().over(w) == 1)
    done = sorted_rows.mapInArrow(run, out)
    refused = large.select(*keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields], F.col("__n").alias("n_rows"), F.concat(F.lit("TooLarge: "), F.col("__n"), F.lit(f" rows, at most {most_rows}")).alias("error"))
    return done.unionByName(refused)


def map_batches(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], returns: str) -> DataFrame:
    """``function`` over frames of rows in no order, batch by batch; each gives a frame with the declared fields.

    For row-wise functions such as adapters of features and scores, and for splits of
    a row into several.  An error ends the job: what a batch holds is by chance, so
    none of it can be reported by itself.
    """
    names = T._parse_datatype_string(returns).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = function(b)
            if list(out.columns) != names:
                raise TypeError(f"the function gave {list(out.columns)}, not {names}")
            yield out

    return df.mapInPandas(run, returns)
