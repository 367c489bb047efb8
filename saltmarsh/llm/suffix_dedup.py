"""Removal of long repeated passages by a logarithmic family of suffix arrays.

Every byte is removed that lies in a string of ``width`` bytes which also starts
at another place of the corpus.

Comparing all starts of a corpus would move each byte many times, so the starts
are first put into runs.  The anchor of a window is the smallest hash among its
``gram``-byte strings; equal windows have equal anchors at equal offsets, so only
windows whose anchor strings are equal can be equal.  Neighbouring windows with
one anchor form a run, and a run is known by its anchor (class) and its bytes
(context).

1. Runs of all documents are written out: class, context digest, place.
2. Classes with one run are unique; runs whose context occurs twice are repeated
   as a whole.  Neither needs its bytes compared.
3. For classes with several contexts, one run of each context sends its bytes.
   A short passage in very many documents makes a class too large for one task.
   Such a class is split by longer strings: windows have their anchor at one of
   ``width - gram + 1`` offsets, and all windows of a range of offsets hold the
   bytes that the range has in common.  A context is cut in two, by the lower and
   the upper half of the offsets, and each half goes to the class of its common
   bytes; equal windows have equal offsets and so stay together.  Halves that
   are equal as a whole are repeated and need no comparing, a half alone in its
   class is unique, and large classes are split again.  A range of one offset
   holds the whole window, so the splitting ends.
4. A task takes the contexts of its classes in batches.  A batch gets a suffix
   array over its window starts, is merge-scanned against the arrays of the
   existing levels, marking starts that agree over ``width`` bytes, and becomes
   the lowest level; levels of equal size are merged, so there are
   logarithmically many.  Classes share no window, so a family of levels ends
   with a class once it has FAMILY contexts.
5. Marks go back to the runs, runs to documents, and the covered bytes are cut.

Defined cases: a null text is empty; a null id is carried as null; texts shorter
than ``width`` lose nothing; rows that repeat doc_id and text repeat each other's
strings; bytes are removed without regard to characters, so the kept bytes need
not be valid UTF-8; an empty table gives an empty result; other columns, whatever
their names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents, slices
from saltmarsh.llm.exact_dedup import filter_bits, maybe_repeated, repeat_filter

WIDTH = 200
GRAM = 64
#: Contexts of a class beyond which it is split by longer strings.
LARGE = 256
#: Contexts in a batch and in a family of levels, and keys of a level in memory at once while it is scanned.
BATCH, FAMILY, BLOCK = 1024, 4096, 1 << 14
_SEGMENT = 1 << 22  # window starts of a text handled at once


def window_runs(raw: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start, anchor's place and hash of each run of ``raw``; ``gram`` is a multiple of 8."""
    starts, lasts, places, hashes = [], [], [], []
    span = width - gram + 1
    for base in range(0, len(raw) - width + 1, _SEGMENT):
        x = np.frombuffer(raw[base : base + _SEGMENT + width - 1] + bytes(8), np.uint8)
        n = len(x) - 8
        word = np.zeros(n, np.uint64)
        for j in range(8):
            word |= x[j : j + n].astype(np.uint64) << np.uint64(8 * j)
        m = n - gram + 1
        h = np.zeros(m, np.uint64)
        for j in range(0, gram, 8):
            h = (h ^ word[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        # Hash above, place below: the smallest has the leftmost of equal hashes.
        key = np.full(-(-m // span) * span, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(m, dtype=np.uint64)
        blocks = key.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, 1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
        n_starts = n - width + 1
        least = np.minimum(behind[:n_starts], ahead[span - 1 : span - 1 + n_starts])
        change = np.flatnonzero(np.diff(least)) + 1
        first = np.concatenate([[0], change])
        starts.append(first + base)
        lasts.append(np.concatenate([change - 1, [n_starts - 1]]) + base)
        place = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        places.append(place + base)
        hashes.append(h[place])
    if not starts:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    return np.concatenate(starts), np.concatenate(lasts), np.concatenate(places), np.concatenate(hashes)


def _runs(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """doc, rid, loc (first start << 20 | anchor's offset from it << 10 | windows), cls, ctx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches):
            doc, rid = (b.column(c).to_numpy() for c in ("doc", "rid"))
            loc, cls, ctx, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
            for text in b.column("text").to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                first, last, place, h = window_runs(raw, width, gram)
                times.append(len(first))
                if len(first):
                    x = np.fromiter((digest(raw[s:e]) for s, e in zip(first.tolist(), (last + width).tolist(), strict=True)), np.uint64, len(first))
                    loc.append((first << 20) | ((place - first) << 10) | (last - first + 1))
                    cls.append(h.view(np.int64))
                    ctx.append(x.view(np.int64))
            columns = {"doc": np.repeat(doc, times), "rid": np.repeat(rid, times), "loc": np.concatenate(loc), "cls": np.concatenate(cls), "ctx": np.concatenate(ctx)}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return docs.mapInArrow(run, "doc long, rid long, loc long, cls long, ctx long")


class SuffixLevels:
    """Suffix arrays over contexts, compared to a depth of ``width`` bytes, in levels of growing size."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bytes, sorted starts, global numbers of the starts
        self.hit = np.zeros(0, bool)

    def _keys(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(data, self.width)[at]
        return np.ascontiguousarray(rows).view(f"S{self.width}").ravel()

    def _mark_equal(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        same = np.flatnonzero(keys[1:] == keys[:-1])
        self.hit[numbers[same]] = True
        self.hit[numbers[same + 1]] = True

    def add(self, contexts: list[bytes]) -> None:
        """One batch: build, merge-scan, insert."""
        if not contexts:
            return
        data = np.frombuffer(b"".join(contexts), np.uint8)
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        offsets, windows = np.cumsum(sizes) - sizes, sizes - self.width + 1
        at = np.repeat(offsets - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        numbers = len(self.hit) + np.arange(len(at))
        self.hit = np.concatenate([self.hit, np.zeros(len(at), bool)])
        keys = self._keys(data, at)
        order = np.argsort(keys, kind="stable")
        at, numbers, keys = at[order], numbers[order], keys[order]
        self._mark_equal(keys, numbers)
        for l_data, l_at, l_numbers in self.levels:
            for i in range(0, len(l_at), BLOCK):
                theirs = self._keys(l_data, l_at[i : i + BLOCK])
                place = np.minimum(np.searchsorted(keys, theirs), len(keys) - 1)
                met = keys[place] == theirs
                self.hit[l_numbers[i : i + BLOCK][met]] = True
                # Equal starts inside the batch are marked already, so one of them is enough.
                self.hit[numbers[place[met]]] = True
        self.levels.append((data, at, numbers))
        while len(self.levels) > 1 and len(self.levels[-2][1]) <= len(self.levels[-1][1]) * 3 // 2:
            self._merge()

    def _merge(self) -> None:
        (d1, a1, n1), (d2, a2, n2) = self.levels[-2:]
        at, numbers, i, j = [], [], 0, 0
        while i < len(a1) and j < len(a2):
            k1, k2 = self._keys(d1, a1[i : i + BLOCK]), self._keys(d2, a2[j : j + BLOCK])
            last = min(k1[-1], k2[-1])
            t1, t2 = int(np.searchsorted(k1, last, "right")), int(np.searchsorted(k2, last, "right"))
            order = np.argsort(np.concatenate([k1[:t1], k2[:t2]]), kind="stable")
            at.append(np.concatenate([a1[i : i + t1], a2[j : j + t2] + len(d1)])[order])
            numbers.append(np.concatenate([n1[i : i + t1], n2[j : j + t2]])[order])
            i, j = i + t1, j + t2
        at += [a1[i:], a2[j:] + len(d1)]
        numbers += [n1[i:], n2[j:]]
        self.levels[-2:] = [(np.concatenate([d1, d2]), np.concatenate(at), np.concatenate(numbers))]


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _scan(contexts: DataFrame, width: int) -> DataFrame:
    """Spans of window starts that another context of the class has too; contexts has group, cls, ctx, base, bytes."""

    def found(index: SuffixLevels, kept: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        out, at = [], 0
        for cls, ctx, base, n in kept:
            out += [(cls, ctx, base + s, base + e) for s, e in _spans(index.hit[at : at + n])]
            at += n
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["cls", "ctx", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, kept, waiting, group = SuffixLevels(width), [], [], None
        for b in batches:
            for g, cls, ctx, base, raw in zip(*(b.column(c).to_pylist() for c in ("group", "cls", "ctx", "base", "bytes")), strict=True):
                if g != group and len(kept) >= FAMILY:
                    index.add(waiting)
                    yield found(index, kept)
                    index, kept, waiting = SuffixLevels(width), [], []
                group = g
                waiting.append(raw)
                kept.append((cls, ctx, base, len(raw) - width + 1))
                if len(waiting) == BATCH:
                    index.add(waiting)
                    waiting = []
        index.add(waiting)
        yield found(index, kept)

    return contexts.repartition("group").sortWithinPartitions("group").mapInArrow(run, "cls long, ctx long, first int, last int")


def _halves(parts: DataFrame, width: int) -> DataFrame:
    """Each part (of windows with their anchor at offsets low..high) in two, by the lower and the upper half of the offsets."""
    sides = F.expr("explode(array(struct(low AS a, (low + high) div 2 AS b), struct((low + high) div 2 + 1 AS a, high AS b)))")
    # Window k of the context has its anchor at offset at - k; low < high, as a range of one offset has no two digests.
    halves = (
        parts.select("*", sides.alias("side")).select("*", F.col("side.a").cast("int").alias("a"), F.col("side.b").cast("int").alias("b"))
        .withColumn("k0", F.greatest(F.col("base"), F.col("at") - F.col("b")))
        .withColumn("k1", F.least(F.col("base") + F.length("bytes") - width, F.col("at") - F.col("a")))
        .where("k0 <= k1")
    )
    common = F.substring(F.col("bytes"), F.col("at") - F.col("a") - F.col("base") + 1, width - F.col("b") + F.col("a"))
    own = F.substring(F.col("bytes"), F.col("k0") - F.col("base") + 1, F.col("k1") - F.col("k0") + width)
    return halves.select(
        F.xxhash64("group", "a", "b", common).alias("group"), "cls", "ctx", "at", F.col("k0").alias("base"), F.col("k1").alias("last"), F.col("a").alias("low"), F.col("b").alias("high"), own.alias("bytes"),
    ).withColumn("digest", F.xxhash64("bytes"))


def _compare(contexts: DataFrame, width: int, gram: int) -> DataFrame:
    """Spans (cls, ctx, first, last) of windows that several contexts of a class have; contexts has cls, ctx, at, bytes."""
    parts = contexts.select(F.col("cls").alias("group"), "cls", "ctx", "at", F.lit(0).alias("base"), "bytes")
    parts, ready, whole = parts.withColumns({"low": F.lit(0), "high": F.lit(width - gram)}), [], []
    while True:
        large = cut(parts.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > LARGE)).select(F.col("group").alias("l_group"))
        in_large = F.col("group") == F.col("l_group")
        ready.append(parts.join(large, in_large, "left_anti").select("group", "cls", "ctx", "base", "bytes"))
        if large.isEmpty():
            break
        split = _halves(parts.join(large, in_large, "left_semi"), width)
        # The halves are written without their bytes; only those that go on send them.
        narrow = cut(split.select("group", "digest", "cls", "ctx", "base", "last"))
        digests = narrow.groupBy("group", "digest").agg(F.count("*").alias("n"), F.min(F.struct("cls", "ctx")).alias("r"))
        digests = cut(digests.select(F.col("group").alias("d_group"), F.col("digest").alias("d_digest"), "n", F.col("r.cls").alias("r_cls"), F.col("r.ctx").alias("r_ctx")))
        # A written table on one side, so that AQE can split a digest that very many contexts have.
        same = (F.col("group") == F.col("d_group")) & (F.col("digest") == F.col("d_digest"))
        whole.append(cut(narrow.join(digests.where("n > 1"), same).select("cls", "ctx", F.col("base").alias("first"), "last")))
        several = digests.groupBy(F.col("d_group").alias("s_group")).agg(F.count("*").alias("n_digests")).where("n_digests > 1")
        sent = cut(digests.join(several, F.col("d_group") == F.col("s_group")).select("d_group", "d_digest", "r_cls", "r_ctx"))
        parts = cut(split.join(sent, same & (F.col("cls") == F.col("r_cls")) & (F.col("ctx") == F.col("r_ctx"))).select("group", "cls", "ctx", "at", "base", "low", "high", "bytes"))
        del split, narrow, digests, several, sent
    compared = ready[0]
    for r in ready[1:]:
        compared = compared.unionByName(r)
    out = _scan(compared, width)
    for w in whole:
        out = out.unionByName(w)
    return out


def _split_by_key(keyed: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose rid may be among ``keys.h``, the others), by a bounded, broadcast Bloom filter.

    Only the first need to be shuffled to meet what is stored under their rid.
    """
    n_bits = filter_bits(keys.count())
    tested = maybe_repeated(keyed, cut(repeat_filter(keys, n_bits, 1)), n_bits, "rid")
    return tested.where("__maybe").drop("__maybe"), tested.where("NOT __maybe").drop("__maybe")


def _context_bytes(keyed: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """cls, ctx, at (the anchor's place) and bytes of the wanted runs (doc, rid, loc, cls, ctx)."""
    of_doc = cut(wanted.groupBy("doc", "rid").agg(F.collect_list(F.struct("loc", "cls", "ctx")).alias("runs")).withColumnsRenamed({"rid": "w_rid", "doc": "w_doc"}))
    keyed, _ = _split_by_key(keyed, of_doc.select(F.col("w_rid").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"cls": pa.int64(), "ctx": pa.int64(), "at": pa.int32(), "bytes": pa.binary()}
        for b in slices(batches):
            out = []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for r in runs:
                    s, at, n = r["loc"] >> 20, r["loc"] >> 10 & 0x3FF, r["loc"] & 0x3FF
                    out.append((r["cls"], r["ctx"], at, raw[s : s + n - 1 + width]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    met = keyed.join(of_doc, (F.col("rid") == F.col("w_rid")) & (F.col("doc") == F.col("w_doc")))
    return met.select("text", "runs").mapInArrow(run, "cls long, ctx long, at int, bytes binary")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents keyed by doc and rid, spans (doc, rid, first, last) of repeated window starts)."""
    if not 0 < gram < width <= 1023:
        raise ValueError("gram and width must be 0 < gram < width < 1024")
    i, t = F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit(""))
    # Rows with equal id and text are one key; two texts under one id would need equal hashes to be taken for one.
    keyed = docs.select(i.alias("doc_id"), t.alias("text"), F.coalesce(i, F.lit(0)).alias("doc"), F.xxhash64(i.isNull(), i, t).alias("rid"))
    runs = cut(_runs(keyed.select("doc", "rid", "text"), width, gram))
    classes = runs.groupBy("cls").agg(F.count("*").alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi")).where("n > 1").select(F.col("cls").alias("k_cls"), (F.col("lo") != F.col("hi")).alias("several"))
    classes = cut(classes)
    repeated = cut(runs.join(classes, F.col("cls") == F.col("k_cls")).drop("k_cls"))
    del runs, classes
    contexts = cut(repeated.groupBy("cls", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "rid", "loc")).alias("r"), F.max("several").alias("several")))
    wanted = contexts.where("several").select("r.doc", "r.rid", "r.loc", "cls", "ctx")
    # Rows that repeat doc_id and text send a context twice, but such a context is repeated as a whole anyway.
    sent_bytes = cut(_context_bytes(keyed, wanted, width))
    whole = contexts.where("n > 1").select("cls", "ctx", F.lit(0).alias("first"), F.lit(-1).alias("last"))
    found = (
        _compare(sent_bytes, width, gram).unionByName(whole).groupBy("cls", "ctx").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        .select(F.col("cls").alias("f_cls"), F.col("ctx").alias("f_ctx"), "spans")
    )
    start, count = F.shiftright("loc", 20), F.col("loc").bitwiseAND(F.lit(0x3FF).cast("long"))
    spans = (
        repeated.join(cut(found), (F.col("cls") == F.col("f_cls")) & (F.col("ctx") == F.col("f_ctx")))
        .select("doc", "rid", start.alias("start"), count.alias("count"), F.explode("spans").alias("s"))
        .select("doc", "rid", (F.col("start") + F.col("s.first")).alias("first"), (F.col("start") + F.when(F.col("s.last") < 0, F.col("count") - 1).otherwise(F.col("s.last"))).alias("last"))
    )
    return keyed, spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that remain)."""
    keyed, spans = repeated_spans(docs, doc_id, text, width, gram)
    of_doc = cut(spans.groupBy("doc", "rid").agg(F.collect_list(F.struct("first", "last")).alias("spans")).withColumnsRenamed({"rid": "s_rid", "doc": "s_doc"}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text_, spans_ in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw, kept, at, n_spans, end = text_.encode("utf-8", "surrogatepass"), [], 0, 0, -1
                for first, last in sorted((s["first"], s["last"] + width) for s in (spans_ or ())):
                    if first > end:
                        n_spans += 1
                        kept.append(raw[at:first])
                    at = end = max(end, last)
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((len(raw), len(raw) - len(rest), n_spans, rest))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    del spans
    some, others = _split_by_key(keyed, of_doc.select(F.col("s_rid").alias("h")))
    met = some.join(of_doc, (F.col("rid") == F.col("s_rid")) & (F.col("doc") == F.col("s_doc")), "left").select("doc_id", "text", "spans")
    joined = met.unionByName(others.select("doc_id", "text", F.lit(None).cast(met.schema["spans"].dataType).alias("spans")))
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
