"""Near copies for the pipeline's stage: texts whose five-word shingles have Jaccard similarity 0.8 or more.

Candidates come from operator 7's SimHash and pivots, and every link is verified by
the exact similarity of the two sets of shingles.  Pairs at that similarity differ
in about a seventh of the bits, which blocks of 64 bits cannot find without
comparing nearly everything; so fingerprints are wide, and their pivot tables give
the candidates (see simhash.pivot_keys).  A pair at similarity 0.8 has a key in
common in one table of ten with a chance of 0.84, so none in all with a chance of
about one in a million by simulation; closer pairs are missed less often still.
Candidates whose first 256 bits differ in more than MAX_BITS are discarded, and so
are those whose sketches show that they cannot be links (see linkable); that bound
is exact, and leaves few pairs of a large family of texts that are almost similar
enough.

Equal sets are collapsed first.  Documents that share a key with few others (DENSE,
ROOM) are compared in pairs.  Under fuller keys each document is compared with one
of them, the centre, which joins up large families; then all documents of a key that
are not in one group yet are compared by their sketches, block by block (see
_of_full).  That looks at as many pairs as the square of a family that hardly has
links; they are spread over tasks that hold two blocks each, and few of them are left
to verify.  Centres of the first table's keys come before all else, and what is in
one group is not compared again.

Defined cases: a null text is empty; texts without words are copies of each other;
texts with fewer words than a shingle have the whole sequence as their shingle;
rows with a null id are left alone; rows that repeat an id stay or go together; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, map_texts
from saltmarsh.llm.simhash import PROBES, SEED, TABLES, WIDE, components, margins, pivot_keys, wide_masks

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILAR_NUM, SIMILAR_DEN = 4, 5
#: Of the first 256 bits, those in which candidates may differ: 38 are expected at similarity 0.8, with a deviation of 5.7.
MAX_BITS = 64
#: The columns of those bits.
PRINT = ("f0", "f1", "f2", "f3")
#: The columns of a sketch: 16 bits have the size of the set, at most FULL, and each other bit is the parity of how many of its hashes fall there.
SKETCH = ("s0", "s1", "s2", "s3")
FULL, _PLACES = (1 << 16) - 1, 64 * len(SKETCH) - 16
#: Documents that may share a key and still be compared in pairs.
DENSE = 16
#: As many times more of them once large families are joined up: what is in one group gives no pairs, and sketches leave few of the others.  Not where a set has more than LONG elements, of which sketches say little.
ROOM, LONG = 16, 450
#: Most bits of a long set's own sketch, which has two to four for each element below that.
WIDEST = 1 << 15
#: Documents of a full key in a block, about.
BLOCK = 1 << 13
#: Orders by which fuller keys choose the document that the others are compared with.
CENTRES = 3
#: Tables whose keys are shuffled at a time, so that the keys of all do not lie on disk together.
AT_A_TIME = 5
#: Fingerprints that are turned into keys at a time, and keys that a task sorts, about.
_STRETCH, _SORTED = 64, 1 << 22


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the distinct word shingles, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n))


def sketch(s: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes, as signed longs."""
    odd = np.bincount((s % np.uint64(_PLACES)).astype(np.int64), minlength=_PLACES) & 1
    return np.concatenate([np.array([min(len(s), FULL)], "<u2").view(np.uint8), np.packbits(odd.astype(bool), bitorder="little")]).view("<i8")


def linkable(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets with the sketches ``x`` and ``y``, row by row, can be similar enough; never false for a link.

    At similarity p / q or more, sets of n and m elements differ in at most
    (n + m) (q - p) / (q + p), and each element that only one of them has turns
    one bit; so no more bits can differ.  Beyond some 450 elements this says little.
    """
    n, m = x[:, 0] & FULL, y[:, 0] & FULL
    other = x ^ y
    other[:, 0] &= ~FULL
    bits = np.bitwise_count(other.view(np.uint64)).sum(1, dtype=np.int64)
    sizes = SIMILAR_NUM * np.maximum(n, m) <= SIMILAR_DEN * np.minimum(n, m)
    return (np.maximum(n, m) == FULL) | sizes & ((SIMILAR_DEN + SIMILAR_NUM) * bits <= (SIMILAR_DEN - SIMILAR_NUM) * (n + m))


def long_sketch(s: np.ndarray) -> bytes | None:
    """Parities as in ``sketch``, of more bits, for a set of more than LONG hashes; None for others."""
    if len(s) <= LONG:
        return None
    places = min(WIDEST, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s % np.uint64(places)).astype(np.int64), minlength=places) & 1, bitorder="little").tobytes()


def _folded(long: bytes | None) -> dict[int, int]:
    """A long sketch by its number of bytes, and the sketches of half as many, and so on, that it has in it."""
    out = {}
    if long is not None:
        v, n = int.from_bytes(long, "little"), len(long)
        while 8 * n > LONG:
            out[n] = v
            n //= 2
            v = (v >> 8 * n) ^ (v & ((1 << 8 * n) - 1))
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node (the id), digest of the set of shingles, its margins as signed bytes, the first bits of its fingerprint, its sketch, and its long sketch."""

    def to_columns(texts: list[str | None]) -> list[pa.Array]:
        import xxhash

        digests, longs, weights = [], [], np.zeros((len(texts), WIDE), np.int8)
        sketches = np.zeros((len(texts), len(SKETCH)), np.int64)
        for i, t in enumerate(texts):
            s = shingle_set(t)
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches[i] = sketch(s)
            longs.append(long_sketch(s))
            m = margins(s)
            weights[i] = np.sign(m) * np.ceil(127 * np.abs(m) / max(1, np.abs(m).max()))
        bits = np.packbits(weights[:, : 64 * len(PRINT)] > 0, axis=1, bitorder="little").view("<i8")
        return [pa.array(digests, pa.binary()), pa.array([w.tobytes() for w in weights], pa.binary()), *(pa.array(b) for b in bits.T), *(pa.array(b) for b in sketches.T), pa.array(longs, pa.binary())]

    return map_texts(docs.where(F.col(doc_id).isNotNull()), doc_id, text, to_columns, f"digest binary, weights binary, {', '.join(f'{c} long' for c in PRINT + SKETCH)}, longer binary").withColumnRenamed("doc_id", "node")


def _keys(distinct: DataFrame, masks: np.ndarray, table: int = 0) -> DataFrame:
    """node, PRINT, SKETCH, label and key, a row for each of a fingerprint's pivot keys; ``masks`` has some tables, from ``table`` on."""
    first = table * (2 * masks[0].size) ** 2

    names = ["node", *PRINT, *SKETCH, "label", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, _STRETCH):
                b = batch.slice(i, _STRETCH)
                weights = np.frombuffer(b"".join(b.column("weights").to_pylist()), np.int8).reshape(-1, WIDE)
                of = np.repeat(np.arange(b.num_rows), len(masks) // 2 * PROBES)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of)) for c in names[:-1]), pa.array(first + pivot_keys(weights, masks).ravel())], names)

    return distinct.select(*names[:-1], "weights").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame) -> DataFrame:
    """node, and its set of shingles as signed longs; ``docs`` has node, text."""

    return map_texts(docs, "node", "text", lambda texts: [pa.array([shingle_set(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], "s array<long>").withColumnRenamed("doc_id", "node")


def _compared(batches: Iterator[pa.RecordBatch], dense: int, of_long: int = 0) -> Iterator[pa.RecordBatch]:
    """Candidates among rows (key, node, label, PRINT, and SKETCH if ``of_long``) that come in order of keys.

    Of keys with at most ``dense`` rows, or ``of_long`` where one has a long set: the pairs (a, b) that are near enough and have
    not one label, with a null key.  Of fuller ones: each row (a) with the first one (b), their key, and
    whether that holds for them.  Holds one batch, and the key that goes on in the next.
    """
    names, columns = ["a", "b", "key", "near"], ["key", "node", "label", *PRINT, *(SKETCH if of_long else ())]
    held, centre = np.zeros((0, len(columns)), np.int64), None  # rows of an unfinished key, or the first row of one that is full already

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        bits, rest = slice(3, 3 + len(PRINT)), slice(3 + len(PRINT), None)
        found = (np.bitwise_count((x[:, bits] ^ y[:, bits]).view(np.uint64)).sum(1, dtype=np.int64) <= MAX_BITS) & (x[:, 2] != y[:, 2])
        if of_long:
            found[found] = linkable(x[found, rest], y[found, rest])
        return found

    def of_full(rows: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(first[:, 1]), pa.array(rows[:, 0]), pa.array(near(rows, first))], names)

    def of_runs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
        length = np.diff(starts, append=len(rows))
        first, n = np.repeat(starts, length), np.repeat(length, length)
        full = n > dense
        if of_long:
            full |= (n > of_long) & np.repeat(np.maximum.reduceat(rows[:, 3 + len(PRINT)] & FULL, starts) > LONG, length)
        if full.any():
            yield of_full(rows[full], rows[first[full]])
        few = np.flatnonzero((n > 1) & ~full)
        left = n[few] - 1 - (few - first[few])  # rows of its key behind each row
        for d in range(1, dense):
            few, left = few[left >= d], left[left >= d]
            if not len(few):
                break
            x, y = rows[few], rows[few + d]
            keep = near(x, y) & (x[:, 1] != y[:, 1])
            a, b = x[keep, 1], y[keep, 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.nulls(len(a), pa.int64()), pa.array(np.ones(len(a), bool))], names)

    for batch in batches:
        rows = np.column_stack([batch.column(c).to_numpy() for c in columns])
        if centre is not None and len(rows):
            n = int(np.searchsorted(rows[:, 0], centre[0, 0], "right"))
            if n:
                yield of_full(rows[:n], np.repeat(centre, n, 0))
            rows = rows[n:]
        rows = np.concatenate([held, rows])
        if not len(rows):
            continue
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if len(rows) - last > dense:
            held, centre = rows[:0], rows[last : last + 1]
        else:
            held, centre, rows = rows[last:].copy(), None, rows[:last]
        if len(rows):
            yield from of_runs(rows)
    if len(held):
        yield from of_runs(held)


def _candidates(side: DataFrame, n_keys: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to verify, and the members (node, key, centre, near) of keys too full for pairs; ``side`` has node, PRINT, SKETCH, label and some ``n_keys`` rows by key."""
    few, parts = DENSE, n_keys // _SORTED + 1
    # Keys choose their centres by one of CENTRES orders, so that a family is compared with as many of its members.
    order = F.xxhash64("node", F.pmod(F.xxhash64("key"), F.lit(CENTRES)))
    more = parts > int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = side.repartition(parts, "key") if more else side.repartition("key")
    ordered = dealt.sortWithinPartitions("key", order, "node").select("key", "node", "label", *PRINT, *SKETCH)
    found = cut(ordered.mapInArrow(lambda batches: _compared(batches, dense, few), "a long, b long, key long, near boolean"))
    pairs = found.where("near and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return cut(pairs.distinct()), found.where("key is not null").select(F.col("a").alias("node"), "key", F.col("b").alias("centre"), "near")


def _of_tables(side: DataFrame, masks: np.ndarray, n_sets: int) -> tuple[DataFrame, DataFrame]:
    """_candidates of all tables; ``side`` has node, weights, PRINT, SKETCH, label."""
    found = []
    for table in range(0, TABLES, AT_A_TIME):
        some = masks[2 * table : 2 * (table + AT_A_TIME)]
        found.append(_candidates(_keys(side, some, table), n_sets * len(some) // 2 * PROBES, DENSE * ROOM))
    pairs, full = (reduce(DataFrame.unionByName, x) for x in zip(*found, strict=True))
    return cut(pairs.distinct()), full


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of a document of block ``lo`` and one of block ``hi`` that have not one label and whose sketches do not show that they cannot be links."""
    rows = pa.Table.from_batches(list(batches))
    node, label, block = (rows.column(c).to_numpy() for c in ("node", "label", "block"))
    sketches = np.column_stack([rows.column(c).to_numpy() for c in SKETCH])
    lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
    left, right = (np.flatnonzero(block == x) for x in (lo, hi))
    longer, there = [_folded(x) for x in rows.column("longer").to_pylist()], sketches[right]
    for k, i in enumerate(left):
        at = k + 1 if lo == hi else 0
        of = right[at:][linkable(sketches[i : i + 1], there[at:]) & (label[right[at:]] != label[i])]
        if len(of) and (x := longer[i]):
            most = (sketches[i, 0] & FULL) + (sketches[of, 0] & FULL)
            common = [max(x.keys() & longer[j].keys(), default=0) for j in of]
            bits = np.array([(x[n] ^ longer[j][n]).bit_count() if n else 0 for n, j in zip(common, of, strict=True)])
            unknown = np.maximum(sketches[i, 0] & FULL, sketches[of, 0] & FULL) == FULL
            of = of[unknown | ((SIMILAR_DEN + SIMILAR_NUM) * bits <= (SIMILAR_DEN - SIMILAR_NUM) * most)]
        if len(of):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[of])), pa.array(np.maximum(node[i], node[of]))], ["a", "b"])


def _of_full(full: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs (a, b) to verify among all that share a key of ``full`` (node, key, label) and have not one label; ``prints`` has node, SKETCH, longer.

    A key's most frequent label is left out of account with itself.  Its documents, and the others,
    are dealt into blocks of about BLOCK, and each pair of blocks is compared by itself.
    """
    counts = full.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("of_main"), (F.sum("n") - F.max("n")).alias("others"))
    blocks = lambda n: F.ceil(F.col(n) / F.lit(BLOCK))
    counts = cut(counts.where("others > 0").select(F.col("key").alias("c_key"), "main", blocks("of_main").alias("n_main"), blocks("others").alias("n_others")))
    rows = full.join(counts, F.col("key") == F.col("c_key")).join(prints.withColumnRenamed("node", "p_node"), F.col("node") == F.col("p_node"))
    main, dealt = F.col("label") == F.col("main"), F.xxhash64("node")
    block = F.when(main, F.col("n_others") + F.pmod(dealt, F.col("n_main"))).otherwise(F.pmod(dealt, F.col("n_others")))
    last = F.when(main, F.col("n_others")).otherwise(F.col("n_others") + F.col("n_main")) - 1
    met = rows.select("key", "node", "label", *SKETCH, "longer", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
    met = met.select("*", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    met = met.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "lo", "hi")
    return cut(met.groupBy("key", "lo", "hi").applyInArrow(_across, "a long, b long").distinct())


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs whose sets are similar enough; ``docs`` has node, text."""
    wanted = pairs.select(F.col("a").alias("w")).union(pairs.select("b")).distinct()
    sets = cut(_sets(docs.join(wanted, F.col("node") == F.col("w"), "left_semi")).dropDuplicates(["node"]))
    a, b = (sets.select(F.col("node").alias(f"{x}_node"), F.col("s").alias(f"{x}_s")) for x in "ab")
    both = pairs.join(a, F.col("a") == F.col("a_node")).join(b, F.col("b") == F.col("b_node"))
    both = both.select("a", "b", F.size("a_s").alias("n_a"), F.size("b_s").alias("n_b"), F.size(F.array_intersect("a_s", "b_s")).alias("n"))
    return cut(both.where(SIMILAR_DEN * F.col("n") >= SIMILAR_NUM * (F.col("n_a") + F.col("n_b") - F.col("n"))).select("a", "b"))


def _with_label(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with the label of their group, the node itself where it is in none."""
    known = label.select(F.col("node").alias("k_node"), F.col("label").alias("k_label"))
    return rows.join(known, F.col("node") == F.col("k_node"), "left").withColumn("label", F.coalesce("k_label", "node")).drop("k_node", "k_label")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """node -> component_id, the least id of its group of near copies; one row per id that is not null."""
    rows = cut(signatures(docs, doc_id, text))
    distinct = cut(rows.groupBy("digest").agg(F.min(F.struct("node", "weights", *PRINT, *SKETCH)).alias("r")).select("digest", "r.*"))
    n_sets = distinct.count()
    masks = wide_masks(n_sets)
    texts = docs.select(F.col(doc_id).alias("node"), F.col(text).alias("text"))
    _, full = _candidates(_keys(distinct.withColumn("label", F.col("node")), masks[:2]), n_sets * PROBES, DENSE)
    stars = full.where("near and node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    families = _verified(cut(stars.distinct()), texts)
    pairs, full = _of_tables(cut(_with_label(distinct, components(families))), masks, n_sets)
    label = components(families.unionByName(_verified(pairs, texts)))
    # Long sketches go only with documents of full keys; an id that repeats with other texts has none.
    members = cut(_with_label(full.select("node", "key").distinct(), label))
    longer = rows.join(members.select(F.col("node").alias("m_node")).distinct(), F.col("node") == F.col("m_node"), "left_semi")
    longer = longer.groupBy(F.col("node").alias("l_node")).agg(F.when(F.min("digest") == F.max("digest"), F.min("longer")).alias("longer"))
    prints = distinct.join(longer, F.col("node") == F.col("l_node"), "left").select("node", *SKETCH, "longer")
    more = _of_full(members, prints)
    tried = pairs.select(F.col("a").alias("t_a"), F.col("b").alias("t_b"))
    more = cut(more.join(tried, (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti"))
    # What is linked already counts as one node from here on.
    ends = _verified(more, texts)
    for x in "ab":
        known = label.select(F.col("node").alias("k_node"), F.col("label").alias("k_label"))
        ends = ends.join(known, F.col(x) == F.col("k_node"), "left").withColumn(x, F.coalesce("k_label", x)).drop("k_node", "k_label")
    joined = components(ends.where(F.col("a") != F.col("b"))).select(F.col("node").alias("j_node"), F.col("label").alias("j_label"))
    first = label.select(F.col("node").alias("c_node"), F.col("label").alias("c_label"))
    known = distinct.join(first, F.col("node") == F.col("c_node"), "left").select("digest", F.coalesce("c_label", "node").alias("label"))
    of_set = cut(known.join(joined, F.col("label") == F.col("j_node"), "left").select(F.col("digest").alias("c_digest"), F.coalesce("j_label", "label").alias("component_id")))
    return rows.join(of_set, F.col("digest") == F.col("c_digest")).select("node", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id."""
    gone = cut(near_groups(docs, doc_id, text).where("node <> component_id").select("node").distinct())
    rows = docs.select(F.col(doc_id).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("id") == F.col("node"), "left_anti").select("row.*")
