"""Pack tokenised documents into fixed windows by non-negative least squares.

1. Every text is tokenised once; ids, length, and the rank of its tail length
   within the input partition are written to the shared folder.  Whole windows
   inside a document need no packing; a tail is what is left after them.
2. The histogram of tail lengths of all documents (window - 1 bins) goes to the
   driver.  All pairs and triples of lengths that fill the window exactly are
   enumerated; non-negative least squares fits their repeat counts to the
   histogram; counts are rounded, and the remaining tails are packed greedily:
   longest first with exact partners, and what has none is laid end to end and
   cut at the borders of windows.
3. A tail's global rank among equal lengths (prefix sums over partitions) gives
   its window and offset.  Nothing but the histogram reaches the driver.

Padding is at most one window in all, as every other window is filled exactly.

Defined cases: a null text is empty and has only the end token; a null id is
carried as null; repeated rows are packed separately; very long texts are encoded
and batches are taken a few megabytes at a time; an empty table gives an empty
result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import base64
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents, slices

WINDOW = 1024
END_ID = 0
NNLS_STEPS = 300
#: Characters that are encoded at a time, about.
STRETCH = 1 << 20

#: The vocabulary's own split never joins text across a single space between two words.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
#: A long run of white space (by Unicode) is one piece up to its last character, which goes with what follows;
#: the split's own expression is too deep for such runs.
_LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


class Tokenizer:
    """Ids of the public byte-level BPE vocabulary, as little-endian unsigned 16-bit integers."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self._tokens = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        a = array("H", ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def _stretches(self, text: str, stretch: int) -> Iterator[bytes]:
        at = 0
        while len(text) - at > stretch and (m := _BETWEEN.search(text, at + stretch)):
            yield self._bytes(self._tokens.encode_ordinary(text[at : m.start()]))
            at = m.start()
        yield self._bytes(self._tokens.encode_ordinary(text[at:]))

    def encode(self, text: str, stretch: int = STRETCH) -> bytes:
        out, at = [], 0
        for m in _LONG_GAP.finditer(text):
            last = m.end() if m.end() == len(text) else m.end() - 1
            out += [*self._stretches(text[at : m.start()], stretch), self._bytes(self._tokens._encode_single_piece(text[m.start() : last]))]
            at = last
        return b"".join([*out, *self._stretches(text[at:], stretch)])

    def encode_with(self, added: dict[str, int], text: str) -> bytes:
        """As ``encode``, with each literal of ``added`` as its own id; the texts around it are encoded apart."""
        if not any(a in text for a in added):
            return self.encode(text)
        # Longer literals first, as the library takes the leftmost and longest.
        parts = re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text)
        return b"".join(np.array([added[p]], "<u2").tobytes() if p in added else self.encode(p) for p in parts if p)


_tokenizers: dict[str, Tokenizer] = {}


def _tokenizer(ranks_path: str | None) -> Tokenizer:
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path, public_tokenizers.PATTERN)
    return _tokenizers[path]


def added_tokens() -> dict[str, int]:
    """The vocabulary's added tokens, which its library finds in texts before anything else."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def tokenize(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """doc_id, ids, doc_tokens, part, tail, tail_rank, windows, windows_before (the last three within the part)."""
    added = added_tokens()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seen, before = _tokenizer(ranks_path), TaskContext.get().partitionId(), {}, 0
        end = np.array([END_ID], "<u2").tobytes()
        for b in slices(batches):
            ids = [tok.encode_with(added, t or "") + end for t in b.column("text").to_pylist()]
            n = np.array([len(x) // 2 for x in ids], np.int64)
            tail, whole = n % window, n // window
            rank = np.zeros(len(n), np.int64)
            for i, t in enumerate(tail.tolist()):
                rank[i] = seen.get(t, 0)
                seen[t] = rank[i] + 1
            starts = before + np.cumsum(whole) - whole
            before += int(whole.sum())
            columns = {"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary()), "doc_tokens": n, "part": np.full(len(n), part, np.int32), "tail": tail, "tail_rank": rank, "windows": whole, "windows_before": starts}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    schema = "doc_id long, ids binary, doc_tokens long, part int, tail long, tail_rank long, windows long, windows_before long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def exact_patterns(window: int) -> np.ndarray:
    """All combinations of two or three lengths below ``window`` that add up to it; 0 fills the third place of a pair."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    x, y = np.meshgrid(np.arange(1, window // 3 + 1), np.arange(1, window // 2 + 1), indexing="ij")
    z = window - x - y
    ok = (x <= y) & (y <= z)
    return np.concatenate([pairs, np.stack([x[ok], y[ok], z[ok]], 1)])


def nnls(patterns: np.ndarray, hist: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Counts x >= 0 with small ||Ax - hist||, by accelerated projected gradient; A counts lengths in patterns."""
    used = (hist[patterns] > 0) | (patterns == 0)
    live = np.flatnonzero(used.all(1))
    x_all = np.zeros(len(patterns))
    if not len(live):
        return x_all
    p = patterns[live]
    valid = (p > 0).astype(float)
    n_bins = len(hist)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(p.ravel(), (x[:, None] * valid).ravel(), n_bins)

    # The largest column sum of A'A bounds the step.
    step = 1.0 / max(1e-9, (forward(np.ones(len(p)))[p] * valid).sum(1).max())
    x = y = np.zeros(len(p))
    t = 1.0
    scale = max(1.0, hist.max())
    goal = hist / scale
    for _ in range(steps):
        grad = ((forward(y) - goal)[p] * valid).sum(1)
        new = np.maximum(0.0, y - step * grad)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    x_all[live] = x * scale
    return x_all


def plan_windows(hist: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """((a, b, c), repeats) rows whose lengths fill the window, and the counts of each length that are left."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[tuple[int, ...], int]] = []
    patterns = exact_patterns(window)
    x = nnls(patterns, left.astype(float))

    def take(lengths: tuple[int, ...], n: int) -> None:
        need: dict[int, int] = {}
        for v in lengths:
            need[v] = need.get(v, 0) + 1
        n = min([n, *(int(left[v]) // k for v, k in need.items())])
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            plan.append((lengths, n))

    order = np.argsort(-x, kind="stable")
    for i in order[: int((x >= 0.5).sum())]:
        take(tuple(int(v) for v in patterns[i] if v), int(round(x[i])))
    for a in range(window - 1, 0, -1):
        if left[a]:
            take((a, window - a), int(left[a]))
        while left[a]:
            rest = window - a
            b = np.arange(1, rest // 2 + 1)
            b = b[(left[b] > 0) & (left[rest - b] > 0)]
            done = len(plan)
            for v in b[::-1].tolist():
                take((a, v, rest - v), int(left[a]))
                if len(plan) > done:
                    break
            if len(plan) == done:
                break
    return plan, left


class _Places:
    """Where the tail of a length and global rank goes."""

    def __init__(self, plan: list, left: np.ndarray, window: int, first: int):
        used, rows, seq = {}, [], first
        for lengths, n in plan:
            at = 0
            for v in lengths:
                rows.append((v, used.get(v, 0), seq, at))
                used[v] = used.get(v, 0) + n
                at += v
            seq += n
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.start, self.seq, self.at = (a[:, 0] << 50) | a[:, 1], a[:, 1], a[:, 2], a[:, 3]
        self.used = np.zeros(len(left), np.int64)
        for v, n in used.items():
            self.used[v] = n
        tokens = left * np.arange(len(left))
        self.base = np.cumsum(tokens) - tokens
        self.rest_seq, self.window = seq, window

    def of(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of each piece."""
        if rank < self.used[length]:
            i = int(np.searchsorted(self.key, (length << 50) | rank, "right")) - 1
            return [(length, int(self.seq[i] + rank - self.start[i]), int(self.at[i]))]
        pos, out = int(self.base[length] + (rank - self.used[length]) * length), []
        while length:
            n = min(length, self.window - pos % self.window)
            out.append((n, self.rest_seq + pos // self.window, pos % self.window))
            pos, length = pos + n, length - n
        return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset."""
    tokens = cut(tokenize(docs, doc_id, text, window, ranks_path))
    counts = cut(tokens.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum("windows").alias("w")))
    hist = np.zeros(window, np.int64)
    total_windows = 0
    for r in counts.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect():  # at most one row a length
        hist[r["tail"]] = r["n"]
        total_windows += r["w"]
    plan, left = plan_windows(hist, window)
    places = docs.sparkSession.sparkContext.broadcast(_Places(plan, left, window, total_windows))
    by_part = counts.groupBy("part").agg(F.sum("w").alias("w"))
    bases = by_part.select(F.col("part").alias("b_part"), F.coalesce(F.sum("w").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("window_base"))
    starts = counts.select(
        F.col("part").alias("s_part"), F.col("tail").alias("s_tail"),
        F.coalesce(F.sum("n").over(Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_base"),
    ).join(bases, F.col("s_part") == F.col("b_part"))
    placed = tokens.join(cut(starts), (F.col("part") == F.col("s_part")) & (F.col("tail") == F.col("s_tail")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = places.value
        types = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids": pa.binary(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64()}
        for b in slices(batches, "ids"):
            out = []
            for doc, ids, n, tail, rank, whole, seq in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "doc_tokens", "tail", "rank", "windows", "sequence")), strict=True):
                wide = np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                for k in range(whole):
                    out.append((doc, k * window, window, wide[4 * k * window : 4 * (k + 1) * window], n, seq + k, 0))
                start = whole * window
                for length, s, at in where.of(tail, rank) if tail else ():
                    out.append((doc, start, length, wide[4 * start : 4 * (start + length)], n, s, at))
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types.values(), strict=True)], list(types))

    return placed.select(
        "doc_id", "ids", "doc_tokens", "tail", (F.col("tail_rank") + F.col("rank_base")).alias("rank"), "windows", (F.col("windows_before") + F.col("window_base")).alias("sequence")
    ).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digest(docs: DataFrame, **kw) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    p = pack_documents(docs, **kw)
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(documents(spark, sf_dir))
