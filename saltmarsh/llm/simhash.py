"""SimHash near-duplicates: pivot distance tables over exact block candidates.

Fingerprints within ``max_bits`` differing bits are linked, and documents are
grouped by reachability.

Equal fingerprints are collapsed first.  Two fingerprints with at most d
differing bits agree on at least b - d of b blocks, so pairs are sought only
among those that agree on b - d whole blocks, for each choice of blocks: no pair
is lost, and none is found by comparing everything.  Pivots alone cannot give
candidates without comparing all pairs, as distances to a reference crowd around
half the bits; they do their work on the candidates: the table of distances to
the reference fingerprints discards each pair whose largest coordinate difference
exceeds d (the triangle inequality), and the survivors are verified.  Blocks that
many fingerprints share belong to large families of near copies; these are linked
without pairs (see _dense_links), with the same components.

Defined cases: a null text is empty; a text without words has fingerprint zero
and links like any other; texts with fewer words than a shingle hash the whole
sequence; repeated rows share a fingerprint, also under one id with other texts;
rows with a null id connect others and have their group's smallest id, null where
no row of the group has one; texts of any length are read whole; other columns,
whatever their names, take no part; an empty table gives an empty result.

Looser similarities need wide fingerprints (margins, pivot_keys): of WIDE bits, each
weighed by its margin, how far its count is from half.  Distances so weighed no
longer crowd, and the pivots near a fingerprint do give candidates: two texts are
candidates if they have near pivots in common in each of two rotations.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents, map_texts

SHINGLE = 4
MAX_BITS = 4
SEED = 42
N_PIVOTS = 12
#: Fingerprints that may share a block and still be compared in pairs.
DENSE = 32
#: Bits of a wide fingerprint.
WIDE = 512
#: Pivot tables of wide fingerprints, of two rotations each; near pivots of a rotation; pairs of them that a table takes.
TABLES, NEAREST, PROBES = 10, 5, 12


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 hashes of all word shingles, unsigned."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    h = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)), np.uint64, n)
    set_in = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        set_in += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def to_columns(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return map_texts(docs, doc_id, text, to_columns, "fp long")


def block_masks(n_rows: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of all choices of whole blocks that a linked pair must share.

    More rows take more, narrower blocks, so that chance agreements stay few.
    """
    kept = 1
    while kept < 5 and 64 * kept // (max_bits + kept) < max(1, n_rows).bit_length():
        kept += 1
    n_blocks = max_bits + kept
    edges = [64 * i // n_blocks for i in range(n_blocks + 1)]
    blocks = [((1 << b) - (1 << a)) for a, b in zip(edges, edges[1:], strict=False)]
    return [reduce(int.__or__, c) for c in combinations(blocks, kept)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def pivots(n: int = N_PIVOTS) -> list[int]:
    """Reference fingerprints, from a fixed seed."""
    return [int(v) for v in np.random.default_rng(7).integers(0, 1 << 64, n, dtype=np.uint64)]


def _centres(max_bits: int) -> list[int]:
    """Masks that flip up to half of ``max_bits`` bits."""
    return [reduce(int.__or__, (1 << i for i in c), 0) for n in range(max_bits // 2 + 1) for c in combinations(range(64), n)]


def _dense_links(dense: DataFrame, max_bits: int) -> DataFrame:
    """Links that join up what is within ``max_bits`` bits among ``dense`` (fp, node), without forming pairs.

    Two fingerprints at most 2r bits apart have a value between them that is at
    most r bits from both, and all fingerprints at most r bits from one value are
    at most 2r apart.  So those around each value are linked to the smallest.
    """
    if max_bits % 2:
        raise ValueError("dense groups need an even number of bits")
    around = F.explode(F.array(*[F.lit(_signed(m)) for m in _centres(max_bits)]))
    near = dense.select("fp", "node", around.alias("m")).select("node", F.col("fp").bitwiseXOR(F.col("m")).alias("centre"))
    least = cut(near.groupBy("centre").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select(F.col("centre").alias("l_centre"), "least"))
    return near.join(least, (F.col("centre") == F.col("l_centre")) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between nodes that connect all fingerprints within ``max_bits`` bits; ``distinct`` has fp, node.

    Blocks that at most DENSE fingerprints share give pairs, which are verified.
    Fingerprints that share a fuller block are linked by _dense_links, so that a
    large family of near copies costs no pairs within it.
    """
    masks = block_masks(distinct.count(), max_bits)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    side = distinct.select("fp", "node", tables.alias("k")).select("fp", "node", F.col("k.t").alias("t"), F.col("k.key").alias("key"))
    full = cut(side.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE)).select(F.col("t").alias("f_t"), F.col("key").alias("f_key"))
    in_full = (F.col("t") == F.col("f_t")) & (F.col("key") == F.col("f_key"))
    dense = cut(side.join(full, in_full, "left_semi").select("fp", "node").distinct())
    far = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("int") for p in pivots()]
    side = side.join(full, in_full, "left_anti").select("*", *[d.alias(f"d{i}") for i, d in enumerate(far)])
    left = side.select(*[F.col(c).alias(f"l_{c}") for c in side.columns])
    right = side.select(*[F.col(c).alias(f"r_{c}") for c in side.columns])
    near = [F.abs(F.col(f"l_d{i}") - F.col(f"r_d{i}")) <= max_bits for i in range(N_PIVOTS)]
    same = (F.col("l_t") == F.col("r_t")) & (F.col("l_key") == F.col("r_key")) & (F.col("l_fp") < F.col("r_fp"))
    verified = F.bit_count(F.col("l_fp").bitwiseXOR(F.col("r_fp"))) <= max_bits
    pairs = left.join(right, same & reduce(lambda a, b: a & b, near) & verified).select(F.col("l_node").alias("a"), F.col("r_node").alias("b")).distinct()
    return pairs.unionByName(_dense_links(dense, max_bits))


def components(edges: DataFrame) -> DataFrame:
    """node -> smallest node reachable, for the nodes of ``edges`` (a, b).

    Each round takes the smallest label among the neighbours, then the label of
    that label; rounds are cut by checkpoints.
    """
    both = cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("best"))
        lower = label.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "best").alias("label"))
        lower = cut(lower)
        up = lower.select(F.col("node").alias("u_node"), F.col("label").alias("u_label"))
        new = cut(lower.join(up, F.col("label") == F.col("u_node"), "left").select("node", "old", F.least("label", F.coalesce("u_label", "label")).alias("label")))
        changed = new.where("old <> label").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            return label


def margins(hashes: np.ndarray) -> np.ndarray:
    """WIDE counts of set less unset bits over ``hashes``; the sign of each is a bit of the fingerprint, as in ``fingerprint``."""
    step = np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    set_in = np.zeros(WIDE, np.int64)
    for i in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        h = hashes[i : i + 255, None] + step
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        set_in += np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return 2 * set_in - len(hashes)


def wide_masks(n_rows: int) -> np.ndarray:
    """Signs of the reference fingerprints, by rotation and mask; more rows take more masks, so that chance agreements stay few."""
    n_masks = 2
    while (2 * WIDE * n_masks) ** 2 < n_rows:
        n_masks *= 2
    return np.random.default_rng(7).choice(np.array([-1, 1], np.float32), (2 * TABLES, n_masks, WIDE))


def _hadamard(n: int) -> np.ndarray:
    return reduce(np.kron, [np.array([[1, 1], [1, -1]], np.float32)] * (n.bit_length() - 1))


def pivot_keys(weights: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """PROBES keys of each table, of two rotations of ``masks``, for each row of ``weights`` (margins): table, and a pivot of each of its two rotations.

    The pivots of a rotation are the rows of a Hadamard matrix under each mask, and
    their complements.  A fingerprint's distance to a pivot, each bit weighed by its
    margin, is half of the margins' sum less their product with the pivot, and a
    Walsh-Hadamard transform has all products at once.  Each table takes the PROBES
    pairs of near pivots whose distances together are least.
    """
    n, (rotations, n_masks, _) = len(weights), masks.shape
    tables = rotations // 2
    x = (weights.astype(np.float32)[:, None, None, :] * masks).reshape(-1, 16, WIDE // 16)
    x = np.matmul(_hadamard(16), x @ _hadamard(WIDE // 16)).reshape(n * rotations, n_masks * WIDE)
    size = np.abs(x)
    at = np.argpartition(-size, NEAREST, axis=1)[:, :NEAREST]
    number = (2 * at + (np.take_along_axis(x, at, 1) > 0)).reshape(n, tables, 2, NEAREST)
    size = np.take_along_axis(size, at, 1).reshape(n, tables, 2, NEAREST)
    n_pivots = 2 * n_masks * WIDE
    pairs = (np.arange(tables)[:, None, None] * n_pivots + number[:, :, 0, :, None]) * n_pivots + number[:, :, 1, None, :]
    both = (size[:, :, 0, :, None] + size[:, :, 1, None, :]).reshape(n, tables, -1)
    best = np.argpartition(-both, PROBES, axis=2)[:, :, :PROBES]
    return np.take_along_axis(pairs.reshape(n, tables, -1), best, 2).reshape(n, -1)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id."""
    rows = cut(fingerprints(docs, doc_id, text, shingle))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # A node is known by its smallest id and its fingerprint, so that one whose ids are all null still connects others.
    distinct = distinct.select("fp", F.struct(F.col("least").isNull().alias("none"), "least", "fp").alias("node"))
    label = components(links(distinct, max_bits)).select(F.col("node").alias("c_node"), "label")
    # A written table against plain rows, so that AQE can split a fingerprint that many copies share.
    of_fp = cut(distinct.join(label, F.col("node") == F.col("c_node"), "left").select(F.col("fp").alias("c_fp"), F.coalesce("label", "node")["least"].alias("component_id")))
    return rows.join(of_fp, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id."""
    gone = cut(near_duplicates(docs, doc_id, text, shingle, max_bits).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct())
    rows = docs.select(F.col(doc_id).alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
