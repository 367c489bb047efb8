"""Helpers that several training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes at a time, about.
SLICE_BYTES = 1 << 22


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as decimal text, modulo ``parts``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts))


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where the session names none, a folder of our own serves on one machine; on a
    cluster that is an error, as executors would not see each other's files.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", "")
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Shuffle files behind an earlier cut are of no more use; Spark deletes them
    when the driver's collectors find that nothing refers to them, so both run
    first.
    """
    sc = df.sparkSession.sparkContext
    gc.collect()
    sc._jvm.System.gc()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``most`` bytes of ``text``, or one row."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at)
            yield b.slice(at, n)
            at += n


def map_texts(docs: DataFrame, doc_id: str, text: str, to_columns: Callable[[list[str | None]], list[pa.Array]], schema: str) -> DataFrame:
    """doc_id and, for each text, the columns of ``schema``; ids stay in Arrow, so that a null id changes no other."""
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *to_columns(b.column("text").to_pylist())], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, {schema}")


def word_count(text: str | Column) -> Column:
    """Number of words in a text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")
