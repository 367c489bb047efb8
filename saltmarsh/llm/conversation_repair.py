"""Conversation structure repair by Four-Russians block tables.

A conversation is repaired by the cheapest edits after which its roles read
``(s?(ua)+)?``: an optional system turn, then user and assistant in turn.  Keeping
a turn costs 0, giving it the role that the place needs 1, deleting it 2, and
inserting an empty turn 5; a turn that ends without punctuation and is not deleted
costs 5 more; blank and duplicate turns must be deleted.  Of equally cheap scripts
the least in ASCII order of its letters (D, I, K, R) is taken.

Each turn is one of nine symbols (delete only, or role initial with and without
truncation), and what remains to be paid from a place on is a vector of four costs:
nothing written yet, after the system turn, after a user, after an assistant.  Less
their least entry, only a few dozen such vectors occur, so a table holds, for each
of them and every block of BLOCK symbols, the vector before the block and what was
taken off.  A conversation goes through the table from its last block to its first;
then each block is expanded backward from the vector on its right, and its cheapest
letters are read off forward.  As the vectors say what the rest costs, the first
letter that keeps the least cost is that of the ASCII-least script.

Turns are compared by a digest of their text, equal ones are counted before
anything is shuffled, and a conversation's turns come to one task twice, in order:
first a symbol for each distinct turn, then the turns themselves, one by one.  What
a task holds of a conversation is one byte a turn and its script, which is an
output value; texts stream through.  The digest of a repaired conversation is one
SHA-256 over its turns in order, so a conversation ends in one task, however long.

Defined cases: null roles and texts count as one space; a null conversation id is
a conversation; null turns come first; turns that share a number are ordered by
role, then by the SHA-256 of their text; a role's first character counts, an empty
role has none and can only be deleted or given another; empty texts are blank;
texts of any length are taken whole; repeated rows are duplicates; an empty table
gives an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import count, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 3
SPACES = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of leaving a truncated turn in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Places in the pattern: nothing yet, after a system, user or assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Place after the turn that is needed next, and that turn's role.
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Place after keeping a turn with this initial; places that do not take it are left out.
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
#: Symbols: 0 is delete only, then initial and truncation.
_INITIALS = ("s", "u", "a", "")
N_SYMBOLS = 1 + 2 * len(_INITIALS)


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with insertions before the next turn allowed."""
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


_END = _closed([0, 99, 99, 0])


def _edits(symbol: int, place: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next place of the edits of a turn, in ASCII order."""
    yield "D", DELETE, place
    if symbol:
        initial, truncated = _INITIALS[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        if place in _KEEP[initial]:
            yield "K", truncated, _KEEP[initial][place]
        yield "R", REROLE + truncated, _NEXT[place]


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Costs from before a turn on, given those from after it."""
    return _closed([min(cost + after[to] for _, cost, to in _edits(symbol, q)) for q in range(4)])


class Tables:
    """Vectors less their least entry, and the transitions of symbols and blocks among them."""

    def __init__(self, block: int = BLOCK):
        self.block, self.vectors, number, steps = block, [_END], {_END: 0}, []
        for v in self.vectors:  # grows while it is walked
            row = []
            for s in range(N_SYMBOLS):
                w = _before(v, s)
                low = min(w)
                w = tuple(c - low for c in w)
                if w not in number:
                    number[w] = len(self.vectors)
                    self.vectors.append(w)
                row.append((number[w], low))
            steps.append(row)
        self.step = np.array([[t for t, _ in r] for r in steps])
        taken = np.array([[low for _, low in r] for r in steps])
        # Row v, column of a block (its symbols as digits, first one highest): the last symbol is applied first.
        to, off = [], []
        for symbols in product(range(N_SYMBOLS), repeat=block):
            v, total = np.arange(len(self.vectors)), np.zeros(len(self.vectors), int)
            for s in reversed(symbols):
                v, total = self.step[v, s], total + taken[v, s]
            to.append(v)
            off.append(total)
        self.to, self.off = np.stack(to, 1).tolist(), np.stack(off, 1).tolist()
        self.taken, self.step = taken.tolist(), self.step.tolist()
        self._expanded: dict[tuple[tuple[int, ...], int, int], tuple[str, int]] = {}

    def expand(self, symbols: tuple[int, ...], right: int, place: int) -> tuple[str, int]:
        """Letters of a block entered at ``place``, and the place after it; ``right`` is the vector after the block."""
        key = (symbols, right, place)
        if key not in self._expanded:
            after = [right]
            for s in reversed(symbols):
                after.append(self.step[after[-1]][s])
            letters = []
            for s, v in zip(symbols, reversed(after[:-1]), strict=True):
                rest = self.vectors[v]
                before = _before(rest, s)
                while True:
                    done = [(letter, to) for letter, cost, to in _edits(s, place) if cost + rest[to] == before[place]]
                    inserts = INSERT + before[_NEXT[place]] == before[place]
                    if inserts and not (done and done[0][0] < "I"):
                        letters.append("I")
                        place = _NEXT[place]
                        continue
                    letters.append(done[0][0])
                    place = done[0][1]
                    break
            self._expanded[key] = ("".join(letters), place)
        return self._expanded[key]

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """Least cost and its ASCII-least script."""
        n = len(symbols)
        whole = n - n % self.block
        rights, v, cost = [0], 0, 0
        for s in reversed(symbols[whole:]):
            cost += self.taken[v][s]
            v = self.step[v][s]
        blocks = np.frombuffer(symbols[:whole], np.uint8).reshape(-1, self.block).astype(np.int64)
        for b in (blocks @ (N_SYMBOLS ** np.arange(self.block)[::-1]))[::-1].tolist():
            rights.append(v)
            cost += self.off[v][b]
            v = self.to[v][b]
        place, letters = START, []
        for i in range(0, whole, self.block):
            piece, place = self.expand(tuple(symbols[i : i + self.block]), rights.pop(), place)
            letters.append(piece)
        piece, place = self.expand(tuple(symbols[whole:]), 0, place)
        letters.append(piece)
        while _END[place]:
            letters.append("I")
            place = _NEXT[place]
        return cost + self.vectors[v][START], "".join(letters)


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


def damage(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text with faults put in, for tests: by the CRC of conversation and turn, modulo 20."""
    named = F.concat(F.coalesce(F.col(conv_id).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn).cast("string"), F.lit(" ")))
    kind = F.col("kind")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("kind"),
    )
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _in_order(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns by conversation in order: first a row (tag 0) for each distinct one with its symbol, then (tag 1) the turns with their texts."""
    blankless = F.rtrim(F.col("text"), F.lit(SPACES))
    turns = conversations.select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    last = F.substring(blankless, -1, 1)
    fault = F.when(blankless == "", F.lit("blank")).when(~last.isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    distinct = turns.groupBy("conv", "turn", "role", "digest").agg(F.max(fault).alias("fault"), F.count("*").alias("n"))
    # Only turns that recur under several numbers need to meet; equal rows of one number are counted above.
    again = distinct.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    again = again.select(F.col("conv").alias("a_conv"), F.col("role").alias("a_role"), F.col("digest").alias("a_digest"), F.col("first.turn").alias("first"), F.lit(True).alias("recurs"))
    same = F.col("conv").eqNullSafe(F.col("a_conv")) & (F.col("role") == F.col("a_role")) & (F.col("digest") == F.col("a_digest"))
    later = F.coalesce("recurs", F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("first"))
    found = F.when(F.col("fault") == "blank", F.lit("blank")).when(later, F.lit("duplicate")).otherwise(F.col("fault"))
    symbols = distinct.join(again, same, "left").select("conv", F.lit(0).alias("tag"), "turn", "role", "digest", F.lit(None).cast("string").alias("text"), found.alias("fault"), "n")
    texts = turns.select("conv", F.lit(1).alias("tag"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("fault"), F.lit(1).cast("long").alias("n"))
    return symbols.unionByName(texts).repartition("conv").sortWithinPartitions("conv", "tag", "turn", "role", "digest")


class _Conversation:
    """What is known of the conversation whose turns come in."""

    def __init__(self, conv: int | None, sink: Callable[[str, str], None]):
        self.conv, self.symbols, self.last, self.sink = conv, bytearray(), None, sink
        self.low = self.high = self.turn = None
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.cost = 0
        self.audit, self.at, self.place = None, 0, START

    def symbol(self, turn: int | None, role: str, fault: str, n: int) -> None:
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.illegal += n - 1
        self.last = initial
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
            self.distinct += 1
        if fault in ("blank", "duplicate"):
            setattr(self, fault, getattr(self, fault) + n)
            self.symbols += bytes(n)
            return
        self.truncated += fault == "truncated"
        self.duplicate += n - 1
        self.symbols.append(1 + 2 * (_INITIALS.index(initial) if initial in _INITIALS else 3) + (fault == "truncated"))
        self.symbols += bytes(n - 1)

    def solve(self) -> None:
        self.cost, self.audit = tables().solve(bytes(self.symbols))
        self.symbols = bytearray()

    def _inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.place = _NEXT[self.place]
            self.sink(_ROLE[self.place], "")
            self.at += 1

    def turn_text(self, role: str, text: str) -> None:
        if self.audit is None:
            self.solve()
        self._inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.place = _NEXT[self.place]
            self.sink(_ROLE[self.place], text)
        elif letter == "K":
            self.place = _KEEP[role[:1]][self.place]
            self.sink(role, text)

    def end(self) -> None:
        self._inserts()

    @property
    def gaps(self) -> int:
        return self.high - self.low + 1 - self.distinct if self.distinct else 0


def _walk(batches: Iterator[pa.RecordBatch], sink: Callable[[int | None], Callable[[str, str], None]]) -> Iterator[_Conversation | None]:
    """Conversations as they end; None after each batch.  ``sink`` makes the receiver of a conversation's repaired turns."""
    now: _Conversation | None = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv", "tag", "turn", "role", "text", "fault", "n")]
        for conv, tag, turn, role, text, fault, n in zip(*columns, strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    now.end()
                    yield now
                now = _Conversation(conv, sink(conv))
            if tag:
                now.turn_text(role, text)
            else:
                now.symbol(turn, role, fault, n)
        yield None
    if now is not None:
        now.end()
        yield now


_WALKED = ("conv", "tag", "turn", "role", "text", "fault", "n")


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [c for c, _ in kinds])


def repaired_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text."""
    kinds = [("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def receiver(conv: int | None) -> Callable[[str, str], None]:
            position = count()
            return lambda role_, text_: out.append((conv, next(position), role_, text_))

        for ended in _walk(batches, receiver):
            if ended is None and out:
                yield _batch(out, kinds)
                out.clear()
        yield _batch(out, kinds)

    return _in_order(conversations, conv_id, turn, role, text).select(*_WALKED).mapInArrow(run, "conv_id long, position long, role string, text string")


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Digest:
    """SHA-256 of the repaired turns as lines."""

    def __init__(self):
        self.sha, self.before = hashlib.sha256(), ""

    def __call__(self, role: str, text: str) -> None:
        self.sha.update(f"{self.before}{role}:{text}".encode())
        self.before = "\n"


def repair_report(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its faults, the least cost, the script, and the SHA-256 of the repaired ``role:text`` lines."""
    kinds = [(c, pa.string() if kind == "string" else pa.int64()) for c, kind in (f.split() for f in _REPORT.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for c in _walk(batches, lambda _: _Digest()):
            if c is not None:
                out.append((c.conv, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, c.cost, c.audit, c.sink.sha.hexdigest()))
            elif out:
                yield _batch(out, kinds)
                out.clear()
        yield _batch(out, kinds)

    return _in_order(conversations, conv_id, turn, role, text).select(*_WALKED).mapInArrow(run, _REPORT)


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    report = repair_report(damage(conversations)).withColumnRenamed("conv_id", "r_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    return every.join(report, F.col("conv_id").eqNullSafe(F.col("r_conv")), "left").select(
        "conv_id", *[_or_zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
