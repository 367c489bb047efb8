"""Removal of passages that documents with smaller ids have: a count-min prefilter, then exact groups.

A window is ``window`` consecutive words of a document.  A word is removed if a
window that covers it also starts in a document with a smaller id.

1. A window is counted under its least ``gram``-word string (its key, a hash), so
   that windows of equal words have equal keys and neighbouring windows mostly
   share one.  Windows in a row under one key form a run, known by the digest of
   the words it covers.  Texts are read once; keys, digests and places are written.
2. Each partition sums, for DEPTH rows of cells, how many documents have a key
   that falls on a cell; the partitions' sketches are merged by adding cells.  The
   least cell of a key is at least the number of documents with it, and that is at
   least the number with any of its windows: the sketch only overestimates.
3. Only runs whose key is estimated to be in two documents or more go on.  Equal
   digests are equal runs, and all but those in the document with the smallest id
   are removed as a whole.  Keys whose runs differ (the edges of a passage, an
   edited copy) are taken apart: one run of each kind sends the digests of its
   windows, which are grouped exactly.
4. Places go back to the documents.  Texts are shuffled only of documents that
   send windows or lose a part of their words.

A sketch has at most DEPTH * MAX_CELLS cells and is broadcast as one bit a cell
(64 MB); past about 10**8 keys more and more runs that occur once pass it, which
costs a shuffle of 32 bytes a run and changes no result.  Digests have 128 bits.

Defined cases: a null text has no words; a null id is smaller than any other;
documents that share an id do not remove each other's words, and rows that repeat
id and text each get the same result; texts of fewer words than a window lose
nothing; long texts are read in segments of about 4 MB, and a run that a segment
ends is two runs; an empty table gives an empty result; other columns, whatever
their names, take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents, slices
from saltmarsh.llm.suffix_dedup import _split_by_key

WINDOW, GRAM = 50, 16
DEPTH = 2
MIN_CELLS, MAX_CELLS, CELLS_PER_KEY = 1 << 18, 1 << 28, 8
_CHUNK = 15  # bits of a cell's number inside one bitmap
SEGMENT = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Windows of a run are counted in the low bits of its place, its first window stands above.
_RUN_BITS = 24


def segments(raw: bytes, window: int = WINDOW, most: int = SEGMENT) -> Iterator[tuple[int, list[bytes], list[bytes]]]:
    """(number of the first word, words, words that no earlier segment had): each window is whole in one segment."""
    at, n, tail = 0, 0, []
    while at < len(raw):
        end = len(raw)
        if at + most < end and (m := _SPACE.search(raw, at + most)):
            end = m.end()
        new = raw[at:end].split()
        words = tail + new
        yield n - len(tail), words, new
        n, tail, at = n + len(new), words[-(window - 1) :] if window > 1 else [], end


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all strings of ``n`` words, from those of the words: halves are put together."""
    if n == 1:
        return h
    half = _grams(h, n // 2)
    both = _mixed(half[: len(half) - n // 2], half[n // 2 :])
    return both if n % 2 == 0 else _mixed(both[: len(both) - 1], h[n - 1 :])


def _sliding_least(h: np.ndarray, span: int) -> np.ndarray:
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    rest = span - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


class _Line:
    """Words joined by spaces, and the bytes of any stretch of them."""

    def __init__(self, words: list[bytes]):
        self.raw = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def digests(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """128-bit digests of words first..last, as two longs each."""
        from xxhash import xxh3_128_digest

        raw = self.raw
        return np.frombuffer(b"".join([xxh3_128_digest(raw[a:b]) for a, b in zip(self.starts[first].tolist(), self.ends[last].tolist(), strict=True)]), "<i8").reshape(-1, 2)


def window_runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, key and digest (two longs) of each run."""
    from xxhash import xxh64_intdigest

    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.reshape(0, 2)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    least = _sliding_least(_grams(h, gram), window - gram + 1)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    count = np.diff(np.append(first, n))
    return first, count, least[first].view(np.int64), _Line(words).digests(first, first + count + window - 2)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and the row's key: doc (the order of ids) and rid (a hash of id and text)."""
    i, t = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    return docs.select(i.alias("doc_id"), t.alias("text"), F.coalesce(i, F.lit(-(1 << 63))).alias("doc"), F.xxhash64(i.isNull(), i, t).alias("rid"))


def read_runs(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, doc, rid, n_words, sha (of all words), and the runs as parallel arrays: key, d1, d2, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, shas, ends = [], [], [0]
            columns = {c: [np.zeros(0, np.int64)] for c in ("key", "d1", "d2", "place")}
            for text in b.column("text").to_pylist():
                sha, n, total = hashlib.sha256(), 0, 0
                for base, words, new in segments(text.encode("utf-8", "surrogatepass"), window):
                    if new:
                        sha.update((b" " if n else b"") + b" ".join(new))
                    n += len(new)
                    first, count, key, digest = window_runs(words, window, gram)
                    total += len(first)
                    for c, v in (("key", key), ("d1", digest[:, 0]), ("d2", digest[:, 1]), ("place", (first + base) << _RUN_BITS | count)):
                        columns[c].append(v)
                n_words.append(n)
                shas.append(sha.digest())
                ends.append(ends[-1] + total)
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v), pa.int64())) for v in columns.values()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc"), b.column("rid"), pa.array(n_words, pa.int64()), pa.array(shas, pa.binary()), *lists], ["doc_id", "doc", "rid", "n_words", "sha", *columns])

    return keyed.select("doc_id", "doc", "rid", "text").mapInArrow(run, "doc_id long, doc long, rid long, n_words long, sha binary, key array<long>, d1 array<long>, d2 array<long>, place array<long>")


def _cells(key: str, n_cells: int) -> list[Column]:
    """The cell of a key in each row of the sketch."""
    return [F.xxhash64(F.lit(row), key).bitwiseAND(F.lit(n_cells - 1).cast("long")) for row in range(DEPTH)]


def sketch_cells(n_keys: int, most: int = MAX_CELLS) -> int:
    """Cells in a row: the next power of two with CELLS_PER_KEY for each key, within bounds."""
    return max(min(MIN_CELLS, most), min(1 << (max(1, n_keys) * CELLS_PER_KEY - 1).bit_length(), most))


def count_min(keys: DataFrame, n_cells: int) -> DataFrame:
    """Sketch (row, cell, n) of ``keys.key``: each partition's cells are summed, then those of all partitions."""
    cells = F.posexplode(F.array(*_cells("key", n_cells))).alias("row", "cell")
    return keys.select(cells).groupBy("row", "cell").agg(F.count("*").alias("n"))


def estimated_repeated(rows: DataFrame, sketch: DataFrame, n_cells: int) -> DataFrame:
    """The ``rows`` whose key has two or more in each of its cells; the bits of such cells are broadcast."""
    low = F.lit((1 << _CHUNK) - 1).cast("long")
    bits = cut(sketch.where("n >= 2").groupBy("row", F.shiftright("cell", _CHUNK).alias("chunk")).agg(F.bitmap_construct_agg(F.col("cell").bitwiseAND(low)).alias("bits")))
    columns = rows.columns
    for i, cell in enumerate(_cells("key", n_cells)):
        own = bits.where(F.col("row") == i).select(F.col("chunk").alias(f"chunk{i}"), F.col("bits").alias(f"bits{i}"))
        at = cell.bitwiseAND(low).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"bits{i}"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        rows = rows.join(F.broadcast(own), F.shiftright(cell, _CHUNK) == F.col(f"chunk{i}")).where(F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1)
    return rows.select(*columns)


def _on(left: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in left:
        out = out & (F.col(c) == F.col(f"{prefix}{c}"))
    return out


def _window_digests(keyed: DataFrame, contexts: DataFrame, window: int) -> DataFrame:
    """key, d1, d2, doc, offset and digest (w1, w2) of the windows of the runs ``contexts`` (doc, rid, key, d1, d2, place)."""
    wanted = contexts.groupBy("doc", "rid").agg(F.collect_list(F.struct("key", "d1", "d2", "place")).alias("runs"))
    wanted = cut(wanted.select(F.col("doc").alias("w_doc"), F.col("rid").alias("w_rid"), "runs"))
    some, _ = _split_by_key(keyed, wanted.select(F.col("w_rid").alias("h")))
    names = ["key", "d1", "d2", "doc", "offset", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for doc, text, runs in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                runs.sort(key=lambda r: r["place"])
                at = 0
                for base, words, _ in segments(text.encode("utf-8", "surrogatepass"), window):
                    # A run lies in the segment in which its windows are whole.
                    own = []
                    while at < len(runs) and (runs[at]["place"] >> _RUN_BITS) - base + window <= len(words):
                        own.append(runs[at])
                        at += 1
                    if not own:
                        continue
                    first = np.array([(r["place"] >> _RUN_BITS) - base for r in own])
                    count = np.array([r["place"] & ((1 << _RUN_BITS) - 1) for r in own])
                    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    windows = np.repeat(first, count) + offset
                    digest = _Line(words).digests(windows, windows + window - 1)
                    columns = [*(np.repeat(np.array([r[c] for r in own]), count) for c in ("key", "d1", "d2")), np.full(len(windows), doc), offset, digest[:, 0], digest[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    met = some.join(wanted, (F.col("doc") == F.col("w_doc")) & (F.col("rid") == F.col("w_rid")))
    return met.select("doc", "text", "runs").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def removed_windows(keyed: DataFrame, base: DataFrame, window: int = WINDOW, most_cells: int = MAX_CELLS) -> DataFrame:
    """Spans (doc, rid, first, n) of windows that start in a document with a smaller id too; ``base`` is of read_runs."""
    keys = base.select(F.explode(F.array_distinct("key")).alias("key"))
    n_cells = sketch_cells(base.agg(F.sum(F.size("key"))).first()[0] or 0, most_cells)
    runs = base.select("doc", "rid", F.explode(F.arrays_zip("key", "d1", "d2", "place")).alias("r")).select("doc", "rid", "r.*")
    runs = cut(estimated_repeated(runs, count_min(keys, n_cells), n_cells))
    same = ["key", "d1", "d2"]
    contexts = cut(runs.groupBy(*same).agg(F.min(F.struct("doc", "rid", "place")).alias("r"), F.max("doc").alias("hi")))
    named = contexts.select(*[F.col(c).alias(f"c_{c}") for c in same], F.col("r.doc").alias("lo"), "hi")
    whole = runs.join(named.where("lo < hi"), _on(same, "c_")).where("doc > lo").select("doc", "rid", "place", F.lit(None).cast("long").alias("offset"))
    several = cut(contexts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("s_key")))
    apart = contexts.join(several, F.col("key") == F.col("s_key"), "left_semi").select("r.doc", "r.rid", "r.place", *same)
    windows = cut(_window_digests(keyed, cut(apart), window))
    # A written table on one side, so that AQE can split a window that very many runs have.
    least = cut(windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(F.col("w1").alias("l_w1"), F.col("w2").alias("l_w2"), "lo"))
    parts = windows.join(least, _on(["w1", "w2"], "l_")).where("doc > lo").select(*[F.col(c).alias(f"p_{c}") for c in same], F.col("doc").alias("p_doc"), "offset")
    # The run that sent its windows, and others of the same words in its document; later documents lose the run as a whole.
    single = runs.join(cut(parts.distinct()), _on(same, "p_") & (F.col("doc") == F.col("p_doc"))).select("doc", "rid", "place", "offset")
    first = F.shiftright("place", _RUN_BITS)
    n = F.when(F.col("offset").isNull(), F.col("place").bitwiseAND(F.lit((1 << _RUN_BITS) - 1).cast("long"))).otherwise(F.lit(1).cast("long"))
    return whole.unionByName(single).select("doc", "rid", (first + F.coalesce("offset", F.lit(0).cast("long"))).alias("first"), n.alias("n"))


def _stretches(spans: list[dict], window: int) -> list[tuple[int, int]]:
    """Covered words [first, last) of windows, merged and in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["first"] + s["n"] + window - 1) for s in spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def remove_copied(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, most_cells: int = MAX_CELLS) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256, and removed: the stretches of words (first, last) that go."""
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    keyed = _keyed(docs, doc_id, text)
    base = cut(read_runs(keyed, window, gram))
    spans = removed_windows(keyed, base, window, most_cells).groupBy("doc", "rid").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    spans = spans.select(F.col("doc").alias("s_doc"), F.col("rid").alias("s_rid"), "spans")
    stretch = "array<struct<first:long,last:long>>"
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    nothing = hashlib.sha256().digest()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = [_stretches(s or [], window) for s in b.column("spans").to_pylist()]
            n_removed = [sum(last - first for first, last in g) for g in gone]
            sha = [s if not r else nothing if r == n else None for s, r, n in zip(b.column("sha").to_pylist(), n_removed, b.column("n_words").to_pylist(), strict=True)]
            lists = pa.array([[{"first": f, "last": x} for f, x in g] for g in gone], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("doc"), b.column("rid"), b.column("n_words"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.binary()), lists], ["doc_id", "doc", "rid", "n_words", "n_removed", "sha", "removed"])

    met = base.join(spans, (F.col("doc") == F.col("s_doc")) & (F.col("rid") == F.col("s_rid")), "left")
    rows = cut(met.select("doc_id", "doc", "rid", "n_words", "sha", "spans").mapInArrow(judged, f"doc_id long, doc long, rid long, n_words long, n_removed long, sha binary, removed {stretch}"))
    hexed = F.lower(F.hex("sha")).alias("kept_sha256")
    decided = rows.where("sha IS NOT NULL").select("doc_id", "n_words", "n_removed", hexed, "removed")
    # Only documents that lose a part of their words need their texts again.
    partly = rows.where("sha IS NULL").dropDuplicates(["doc", "rid"]).select(F.col("doc").alias("r_doc"), F.col("rid").alias("r_rid"), "n_words", "n_removed", "removed")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            shas = []
            for raw, gone in zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True):
                sha, at, empty = hashlib.sha256(), 0, True
                for _, _, words in segments(raw.encode("utf-8", "surrogatepass"), 1):
                    edges = [0, *(e for g in gone for e in (g["first"] - at, g["last"] - at)), len(words)]
                    kept = [w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[max(0, a) : max(0, z)]]
                    if kept:
                        sha.update((b"" if empty else b" ") + b" ".join(kept))
                        empty = False
                    at += len(words)
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_removed"), pa.array(shas), b.column("removed")], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    some, _ = _split_by_key(keyed, partly.select(F.col("r_rid").alias("h")))
    with_text = some.join(partly, (F.col("doc") == F.col("r_doc")) & (F.col("rid") == F.col("r_rid"))).select("doc_id", "text", "n_words", "n_removed", "removed")
    return decided.unionByName(with_text.mapInArrow(cut_out, f"doc_id long, n_words long, n_removed long, kept_sha256 string, removed {stretch}"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copied(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
