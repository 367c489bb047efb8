"""The pipeline's near-copy stage against brute force over all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from test_operators import SCHEMA, make_rows, words

from saltmarsh.llm import near_copies, simhash


def naive_survivors(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                old, new = sorted((label[a], label[b]))[::-1]
                label = {k: new if v == old else v for k, v in label.items()}
    return sorted(i for i, *_ in rows if label[i] == i)


def edited(rng, text, n):
    w = text.split()
    for k in rng.sample(range(len(w)), n):
        w[k] = "changed" + str(rng.randint(0, 999))
    return " ".join(w)


@pytest.mark.parametrize("dense", [16, 1])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, dense):
    monkeypatch.setattr(near_copies, "DENSE", dense)
    rng = random.Random(12)
    rows = make_rows()
    for base in range(12):  # pairs on both sides of similarity 0.8, most of them beyond 4 bits
        text = words(rng, 150)
        rows += [(1000 + 10 * base, text, "en", "s1", 0), (1001 + 10 * base, edited(rng, text, 1 + base % 6), "en", "s1", 0)]
    text = words(rng, 300)
    rows += [(2000 + i, edited(rng, text, 2), "en", "s2", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == naive_survivors(rows)


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A b  c d e f"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] or 0 for r in near_copies.drop_near_copies(docs).collect()) == [0, 1, 3]
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_pivot_keys_are_the_nearest_pivots():
    rng = np.random.default_rng(3)
    masks = simhash.wide_masks(100)
    hadamard = np.array([[(-1) ** (i & j).bit_count() for j in range(simhash.WIDE)] for i in range(simhash.WIDE)])
    for weights in (rng.integers(-127, 128, simhash.WIDE), simhash.margins(rng.integers(0, 1 << 63, 40, dtype=np.uint64))):
        keys = simhash.pivot_keys(weights[None, :], masks)[0].reshape(simhash.TABLES, simhash.PROBES)
        assert len(set(keys.ravel())) == keys.size
        far = []  # of each rotation: weighted distances to its pivots and their complements
        for r in masks:
            pivots = np.concatenate([m * hadamard for m in r])
            wrong = np.stack([(pivots == np.where(weights > 0, 1, -1)), (pivots == np.where(weights > 0, -1, 1))], 1)
            far.append((wrong.reshape(-1, simhash.WIDE) * np.abs(weights)).sum(1))
        n = len(far[0])
        for t in range(simhash.TABLES):
            x, y = (np.sort(f)[: simhash.NEAREST] for f in far[2 * t : 2 * t + 2])
            least = sorted((x[:, None] + y[None, :]).ravel())[: simhash.PROBES]
            assert sorted(far[2 * t][k // n % n] + far[2 * t + 1][k % n] for k in keys[t]) == least
            assert set(keys[t] // (n * n)) == {t}


def test_pairs_at_the_least_similarity_share_a_key_and_are_near():
    rng = np.random.default_rng(8)
    masks, bits = simhash.wide_masks(1 << 24), 64 * len(near_copies.PRINT)
    for n in (5, 20, 150) * 30:
        every = rng.integers(0, 1 << 63, 10 * n, dtype=np.uint64)
        a, b = (simhash.margins(s) for s in (every[: 9 * n], every[n:]))
        assert np.intersect1d(*simhash.pivot_keys(np.stack([a, b]), masks)).size
        assert ((a[:bits] > 0) != (b[:bits] > 0)).sum() <= near_copies.MAX_BITS


@pytest.mark.parametrize("step", [1, 3, 7, 100])
def test_keys_that_span_batches(step):
    rng = random.Random(2)
    rows = sorted((key, node, rng.choice([node, 7]), *[rng.choice([0, -1]) for _ in near_copies.PRINT]) for key, n in enumerate((1, 2, 9, 3, 4, 1, 12)) for node in rng.sample(range(50), n))
    want = []
    for key in range(7):
        of_key = [r for r in rows if r[0] == key]
        near = lambda x, y: x[2] != y[2] and sum((a ^ b) % (1 << 64) > 0 for a, b in zip(x[3:], y[3:], strict=True)) <= 1
        if len(of_key) > 3:
            want += [(r[1], of_key[0][1], key, near(r, of_key[0])) for r in of_key]
        else:
            want += [(x[1], y[1], None, True) for i, x in enumerate(of_key) for y in of_key[i + 1 :] if near(x, y)]
    names = ["key", "node", "label", *near_copies.PRINT]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + step]]) for i in range(0, len(rows), step)]
    got = [tuple(r.values()) for b in near_copies._compared(iter(batches), 3) for r in b.to_pylist()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_link_is_beyond_its_sketches():
    rng = np.random.default_rng(11)
    every = rng.integers(0, 1 << 63, 200_000, dtype=np.uint64)
    row = lambda s: near_copies.sketch(s)[None, :]
    for n in (0, 1, 4, 5, 9, 60, 150, 700, 7_282, 66_000):
        for own_a, own_b in ((0, n // 4), (n // 4, 0), (n // 8, n // 8), (n // 9, n // 8), (n, 0), (n, n)):
            a, b = every[: n + own_a], np.concatenate([every[:n], every[150_000 : 150_000 + own_b]])
            if 5 * n >= 4 * (n + own_a + own_b):
                assert near_copies.linkable(row(a), row(b))[0]
    for n in (20, 150, 400):  # without a hash in common, and of sizes that are not near enough
        assert not near_copies.linkable(row(every[:n]), row(every[n : 2 * n]))[0]
        assert not near_copies.linkable(row(every[:n]), row(every[: n + n // 4 + 1]))[0]


def test_a_family_below_the_least_similarity_has_few_pairs(spark, monkeypatch):
    rng, n_docs = random.Random(5), 200
    text = words(rng, 150)
    # Similarities of about 0.6: hardly a link, but near pivots and fingerprints in common.
    rows = [(i, edited(rng, text, 4), "en", "s1", 0) for i in range(n_docs)]
    docs = spark.createDataFrame(rows, SCHEMA)
    counts, verified = [], near_copies._verified

    def counted(pairs, texts):
        counts.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(near_copies, "_verified", counted)
    kept = near_copies.drop_near_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == naive_survivors(rows)
    assert sum(counts) <= n_docs


def test_short_sets_have_more_room_and_long_ones_do_not():
    rng = np.random.default_rng(4)
    every = rng.integers(0, 1 << 63, 2_000, dtype=np.uint64)
    names = ["key", "node", "label", *near_copies.PRINT, *near_copies.SKETCH]
    # Under key 0, six sets of 100; under key 1, six of 1000: of either any two differ in two elements.
    rows = [(key, i, i, 0, 0, 0, 0, *near_copies.sketch(np.append(every[: n - 1], every[-1 - i]))) for key, n in enumerate((100, 1000)) for i in range(6)]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, map(int, r), strict=True)) for r in rows])
    got = [r for b in near_copies._compared(iter([batch]), 8, 3) for r in b.to_pylist()]
    assert sorted((r["a"], r["b"]) for r in got if r["key"] is None) == [(a, b) for a in range(6) for b in range(a + 1, 6)]
    assert sorted((r["a"], r["b"], r["near"]) for r in got if r["key"] == 1) == [(a, 0, a > 0) for a in range(6)]


def test_links_within_full_keys_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "DENSE", 2)
    monkeypatch.setattr(near_copies, "ROOM", 1)
    rng, rows = random.Random(6), []
    text = words(rng, 150)
    for i in range(150):  # each with a copy of one more edit; similarities of others are on both sides of 0.8
        one = edited(rng, text, 2)
        rows += [(i, one, "en", "s1", 0), (1000 + (7 * i) % 150, edited(rng, one, 1), "en", "s1", 0)]
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(r["doc_id"] for r in kept.collect()) == naive_survivors(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_full_keys_are_compared_whole(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(9)
    every = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    # Sets of 100, 1000 and 1100 hashes; pairs of them at similarities around 0.8 and 0.5.
    sets = [np.append(every[:n], every[5_000 + 300 * i :][: n // k]) for i, (n, k) in enumerate([(100, 9), (100, 2), (1000, 9), (1000, 8), (1100, 9), (1000, 2)] * 6)]
    label = lambda i: 3 if i % 5 == 3 else i
    prints = spark.createDataFrame([(i, *map(int, near_copies.sketch(s)), near_copies.long_sketch(s)) for i, s in enumerate(sets)], ", ".join(["node long", *(f"{c} long" for c in near_copies.SKETCH), "longer binary"]))
    keys = {0: range(36), 1: range(10, 30), 2: [3, 8, 13]}
    full = spark.createDataFrame([(i, key, label(i)) for key, of in keys.items() for i in of], "node long, key long, label long")
    got = sorted(map(tuple, near_copies._of_full(full, prints).collect()))
    similar = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a in range(36) for b in range(a + 1, 36)}
    assert len(set(got)) == len(got) and all(label(a) != label(b) and similar[a, b] > 0.6 for a, b in got)
    links = {p for p, x in similar.items() if x >= 0.8 and label(p[0]) != label(p[1])}
    assert len(links) > 50 and links <= set(got)


def test_no_link_is_beyond_its_long_sketches():
    rng = np.random.default_rng(12)
    every = rng.integers(0, 1 << 63, 90_000, dtype=np.uint64)
    bits = lambda a, b: (a[n := max(a.keys() & b.keys())] ^ b[n]).bit_count()
    for n in (451, 500, 700, 1_000, 4_000, 20_000):
        for own_a, own_b in ((0, n // 4), (n // 9, n // 8), (n // 5, 0), (n // 2, n // 2)):
            a, b = every[: n + own_a], np.append(every[:n], every[50_000 : 50_000 + own_b])
            x, y = (near_copies._folded(near_copies.long_sketch(s)) for s in (a, b))
            link = 5 * n >= 4 * (n + own_a + own_b)
            if link or n < 5_000:  # the largest have less than two bits an element
                assert (9 * bits(x, y) <= len(a) + len(b)) == link
    assert near_copies.long_sketch(every[:450]) is None and near_copies._folded(None) == {}
