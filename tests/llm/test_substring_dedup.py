"""Substring de-duplication against brute force over all windows, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from saltmarsh.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, lang string, key string, doc string, rid string, place string"


def expected(rows, window=D.WINDOW):
    """doc_id, n_words, n_removed, kept_sha256 of each row, from the sets of windows of each id."""
    order = lambda i: -(1 << 63) if i is None else i
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            least[w] = min(order(i), least.get(w, order(i)))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def make_rows(seed, n, vocabulary=30):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(vocabulary)]
    some = lambda k: [rng.choice(words) for _ in range(k)]
    passages = [some(rng.randint(5, 90)) for _ in range(6)] + [["same"] * 70, ["ab", "cd"] * 60]
    rows = [(None, None), (3, ""), (3, " \n\t "), (4, "one"), (None, " ".join(passages[0] * 2)), (-7, " ".join(passages[1] * 2))]
    for i in range(n):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += some(rng.randint(0, 40)) + rng.choice(passages)
        if rng.random() < 0.3:
            text[rng.randrange(len(text))] = f"edit{i}"
        rows.append((rng.choice([i, i, i % 7]), rng.choice([" ", "\n", " \x0b"]).join(text)))
    return rows + rows[10:14] + [rows[12]] * 3


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize(("window", "gram", "cells"), [(50, 16, D.MAX_CELLS), (50, 16, 1 << 4), (6, 2, D.MAX_CELLS), (5, 5, D.MAX_CELLS)])
def test_equals_brute_force_however_small_the_sketch(spark, window, gram, cells):
    rows = make_rows(window, 60)
    assert got(D.remove_copied(frame(spark, rows), window=window, gram=gram, most_cells=cells)) == expected(rows, window)


def test_query_over_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = expected(rows)
    assert got(D.op12_substring_dedup(spark, sf_dir)) == want and sum(r[2] for r in want) > 0


def test_removed_stretches_are_the_words_that_go(spark):
    rows = make_rows(9, 40)
    for r, (_, text) in [(r, t) for r in D.remove_copied(frame(spark, rows[:20])).collect() for t in rows[:20] if t[0] == r["doc_id"]]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) == r["n_words"]:
            kept = [w for k, w in enumerate(words) if not any(g["first"] <= k < g["last"] for g in r["removed"])]
            assert len(words) - len(kept) == r["n_removed"]


def test_sketch_only_overestimates(spark):
    rng = random.Random(2)
    keys = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)]
    rows = [k for k in keys for _ in range(rng.choice([1, 1, 2, 3]))]
    df = spark.createDataFrame([(k,) for k in rows], "key long").repartition(3)
    for n_cells in (1 << 6, 1 << 12):
        left = {r["key"] for r in D.estimated_repeated(df, D.count_min(df, n_cells), n_cells).collect()}
        assert {k for k in keys if rows.count(k) > 1} <= left
    assert len(left) < 0.75 * len(set(keys)) + 50


def test_segments_hold_each_window_once():
    rng = random.Random(5)
    raw = b"".join(rng.choice([b"ab", b"c", b" ", b"\n ", b"\t"]) for _ in range(3000))
    words = raw.split()
    for most in (1, 7, 100, 5000):
        seen = [tuple(w[k : k + 9]) for _, w, _ in D.segments(raw, 9, most) for k in range(len(w) - 8)]
        assert seen == [tuple(words[k : k + 9]) for k in range(len(words) - 8)]
        assert [w for _, _, new in D.segments(raw, 9, most) for w in new] == words
    assert list(D.segments(b"", 9)) == [] and all(not w for _, w, _ in D.segments(b"  \n ", 9))


def test_texts_longer_than_a_segment(spark):
    rng = random.Random(8)
    long = [str(rng.randrange(10**6)) for _ in range(900_000)]
    assert len(" ".join(long)) > D.SEGMENT
    rows = [(1, " ".join(long[599_000:700_000])), (2, " ".join(long)), (3, "x " + " ".join(long[650_000:650_060]) + " y")]
    result = {r[0]: r for r in got(D.remove_copied(frame(spark, rows)))}
    kept = " ".join(long[:599_000] + long[700_000:])
    assert result[2] == (2, 900_000, 101_000, hashlib.sha256(kept.encode()).hexdigest())
    assert result[3][1:3] == (62, 60) and result[1][2] == 0


def test_empty_table(spark):
    assert D.remove_copied(spark.createDataFrame([], SCHEMA)).collect() == []
