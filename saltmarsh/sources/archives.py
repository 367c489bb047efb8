"""ZIP members, grids of configurations, and artifacts that are never rewritten."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.sources.tables import fingerprints

#: CSV rows that a task holds at a time.
ROWS = 10_000


def unzip_csv(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path and cells (header -> text) of each row of the one CSV member of each archive; another number of members is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                with zipfile.ZipFile(io.BytesIO(b.column(1)[i].as_py())) as z:
                    names = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    if len(names) != 1:
                        raise ValueError(f"{b.column(0)[i]} has {len(names)} CSV members, not one")
                    with z.open(names[0]) as raw:
                        rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                        while part := list(islice(rows, ROWS)):
                            cells = pa.array([[(k.strip(), v) for k, v in r.items() if k is not None] for r in part], pa.map_(pa.string(), pa.string()))
                            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(part), pa.string()), cells], ["path", "cells"])

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "path string, cells map<string,string>")


def read_zips(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all ZIP archives under ``folder``."""
    return unzip_csv(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder))


def zip_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Archives (path, content) with one CSV member for each Arrow batch of ``df``, as exchanges deliver them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        for k, b in enumerate(batches):
            text, packed = io.StringIO(newline=""), io.BytesIO()
            out = csv.writer(text)
            out.writerow(columns)
            out.writerows(zip(*[b.column(c).to_pylist() for c in columns], strict=True))
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("rows.csv", text.getvalue())
            name = f"part-{pyspark.TaskContext.get().partitionId()}-{k}.zip"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([packed.getvalue()], pa.binary())], ["path", "content"])

    return df.select(*columns).mapInArrow(run, "path string, content binary")


def grid_table(docs: DataFrame, text: str) -> DataFrame:
    """Configurations of JSON grids as typed rows.

    An item is an object, or an array of target, stop, horizon and, if given, the
    least volatility; an item that lacks one of the first three is an error.  Items
    without an id are named by their position.
    """
    fields = "id string, target_bps double, stop_bps double, horizon_bars long, min_realized_vol double"
    d = docs.select("*", F.posexplode(F.from_json(text, "array<string>")).alias("pos", "item"))
    d = d.withColumn("o", F.when(~F.col("item").startswith("["), F.from_json("item", fields))).withColumn("a", F.when(F.col("item").startswith("["), F.from_json("item", "array<double>")))
    pick = lambda name, i: F.coalesce(F.col(f"o.{name}"), F.get("a", F.lit(i)))
    need = lambda name, i: F.coalesce(pick(name, i), F.raise_error(F.concat(F.lit(f"grid item without {name}: "), "item")).cast("double"))
    rest = [c for c in docs.columns if c != text]
    return d.select(
        *rest, F.coalesce("o.id", F.concat(F.lit("grid_"), "pos")).alias("id"), need("target_bps", 0).alias("target_bps"), need("stop_bps", 1).alias("stop_bps"),
        need("horizon_bars", 2).cast("long").alias("horizon_bars"), pick("min_realized_vol", 3).alias("min_realized_vol"),
    )


def write_immutable(df: DataFrame, folder: str, id: str) -> str:
    """Path of the artifact ``id``: written once; the same rows again change nothing, other rows are an error."""
    path, spark = f"{folder.rstrip('/')}/{id}", df.sparkSession
    try:
        df.write.mode("errorifexists").parquet(path)
        return path
    except AnalysisException as e:
        if e.getCondition() != "PATH_ALREADY_EXISTS":
            raise
    old, columns = spark.read.parquet(path), sorted(df.columns)
    if sorted(old.columns) != columns or fingerprints(old, [], columns).first() != fingerprints(df, [], columns).first():
        raise ValueError(f"artifact {id} exists with other content")
    return path
