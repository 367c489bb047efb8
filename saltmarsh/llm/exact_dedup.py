"""Exact de-duplication: a two-pass Bloom filter decides which hashes must meet.

Pass one sets two filter positions for each text hash and keeps, as 4 KB
bitmaps, the positions that at least two rows set.  Pass two tests every row
against those bitmaps; a row both of whose positions were set twice is possibly
repeated, and only such rows are shuffled (hash and id, not the text).  All
others pass straight through.

Everything is built from DataFrame functions.  The broadcast bitmaps are bounded
by ``max_bits`` (2**28 bits for each of two filters: 64 MB); a corpus too large
for that only has more false candidates, which the exact grouping clears, so the
result is the same.

Defined cases: a null text counts as empty; empty texts equal each other; a null
id is less than any other and stays where a text has no other; rows that repeat
both doc_id and text are each returned and counted in ``group_size``, and
``drop_exact_copies`` keeps one of them; an empty table gives an empty result;
other columns, whatever their names, take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents

MAX_BITS = 1 << 28
MIN_BITS = 1 << 18
BITS_PER_ROW = 16
_CHUNK = 15  # bits of a position inside one bitmap of bitmap_construct_agg


def _positions(key: Column, n_bits: int) -> list[Column]:
    """The two filter positions of a 64-bit hash: one from either half."""
    mask = F.lit(n_bits - 1).cast("long")
    return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask)]


def filter_bits(n_rows: int, max_bits: int = MAX_BITS) -> int:
    """Size of a filter: the next power of two with BITS_PER_ROW bits a row, within bounds."""
    wanted = 1 << max(1, (max(1, n_rows) * BITS_PER_ROW - 1).bit_length())
    return max(min(MIN_BITS, max_bits), min(wanted, max_bits))


def repeat_filter(keys: DataFrame, n_bits: int, least: int = 2) -> DataFrame:
    """Bitmaps (which, chunk, bitmap) of the positions that ``least`` or more rows of ``keys.h`` set."""
    p = _positions(F.col("h"), n_bits)
    return (
        keys.select(F.explode(F.array(*[F.struct(F.lit(i).alias("which"), c.alias("pos")) for i, c in enumerate(p)])).alias("p"))
        .select("p.which", "p.pos")
        .groupBy("which", "pos")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= least)
        .groupBy("which", F.shiftright("pos", _CHUNK).alias("chunk"))
        .agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND(F.lit((1 << _CHUNK) - 1).cast("long"))).alias("bitmap"))
    )


def maybe_repeated(rows: DataFrame, bitmaps: DataFrame, n_bits: int, key: str) -> DataFrame:
    """``rows`` with a boolean ``__maybe``: whether the filter allows that another row has this key."""
    flag = F.lit(True)
    for i, pos in enumerate(_positions(F.col(key), n_bits)):
        own = bitmaps.where(F.col("which") == i).select(F.col("chunk").alias(f"__chunk{i}"), F.col("bitmap").alias(f"__bitmap{i}"))
        bit = pos.bitwiseAND(F.lit((1 << _CHUNK) - 1).cast("long")).cast("int")
        rows = rows.withColumn(f"__at{i}", F.shiftright(pos, _CHUNK)).join(F.broadcast(own), F.col(f"__at{i}") == F.col(f"__chunk{i}"), "left")
        byte = F.conv(F.hex(F.substring(F.col(f"__bitmap{i}"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
        flag = flag & F.coalesce(F.getbit(byte, bit.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.withColumn("__maybe", flag).drop(*[f"__{n}{i}" for i in (0, 1) for n in ("at", "chunk", "bitmap")])


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    return docs.select(F.col(doc_id).alias("doc_id"), sha.alias("sha")).withColumn("h", F.xxhash64("sha"))


def _groups(maybe: DataFrame) -> DataFrame:
    """Groups of at least two rows: sha, keep_id (largest doc_id), group_size."""
    return (
        maybe.groupBy("sha", "doc_id").agg(F.count("*").alias("n"))
        .groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .where("group_size > 1")
    )


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = cut(_hashed(docs, doc_id, text))
    n_bits = filter_bits(base.count(), max_bits)
    bitmaps = cut(repeat_filter(base, n_bits))
    tested = maybe_repeated(base, bitmaps, n_bits, "h")
    through = tested.where(~F.col("__maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    maybe = tested.where("__maybe").select("sha", "doc_id")
    # A written table on one side, plain rows on the other: a hot hash is split by AQE's skew join.
    groups = cut(_groups(maybe)).select(F.col("sha").alias("g_sha"), "keep_id", "group_size")
    met = (
        maybe.join(groups, F.col("sha") == F.col("g_sha"), "left")
        .select(
            "doc_id",
            F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("group_size", F.lit(1)).alias("group_size"),
            (F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id"))).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
    return through.unionByName(met)


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without repeated texts; of equal texts the row with the largest id stays."""
    base = cut(_hashed(docs, doc_id, text))
    n_bits = filter_bits(base.count(), max_bits)
    bitmaps = cut(repeat_filter(base, n_bits))
    groups = cut(_groups(maybe_repeated(base, bitmaps, n_bits, "h").where("__maybe"))).select(F.col("sha").alias("g_sha"), "keep_id")
    # The row travels as one value, so that no column of its own can clash with the working ones.
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).withColumn("h", F.xxhash64("sha"))
    tested = maybe_repeated(rows, bitmaps, n_bits, "h")
    winners = (
        tested.where("__maybe")
        .join(groups, F.col("sha") == F.col("g_sha"), "left")
        .where(F.col("g_sha").isNull() | F.col("keep_id").eqNullSafe(F.col("id")))
        .dropDuplicates(["sha", "id"])
    )
    return tested.where(~F.col("__maybe")).select("row.*").unionByName(winners.select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(documents(spark, sf_dir))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
