"""Very long texts, ids beside null ids, and columns named like anything."""

from __future__ import annotations

import random

import numpy as np
import pytest
from test_operators import words

from saltmarsh.llm import exact_dedup, language_id, mixing, near_copies, packing, quality_classifier, simhash, toxicity


def test_tokens_of_stretches_and_gaps_equal_the_librarys():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, own, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing._tokenizer(None), random.Random(2)
    plain = "it's a test of  cut,5 points\n and é 你好 more " * 20
    texts = [plain, words(rng, 500)]
    for gap in (" " * 5000, "\n" * 4096 + "\t", "\xa0 " * 3000, " \n" * 9000):
        texts += [gap, "a" + gap, gap + "a", "a" + gap + "b" + gap + "!", "x " + gap[:4095] + "y"]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        for stretch in (5, 77, packing.STRETCH):
            assert np.frombuffer(own.encode(t, stretch), "<u2").tolist() == want


@pytest.mark.parametrize("text", [" " * 3_000_000, "x" * 1_000_000, "\n" * 2_000_000 + "end"])
def test_very_long_runs_do_not_crash(text):
    assert len(packing._tokenizer(None).encode(text)) > 0


BIG = 9007199254740993  # no float has this value
ODD_NAMES = ("__sha", "__h", "__maybe", "__at0", "__chunk0", "__gone", "__doc", "__size", "__copy", "__copies", "gone", "node", "row", "id", "sha", "h", "passes", "rows", "p_id", "words", "order", "of")


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    text = words(rng, 60)
    rows = [(None, text, "s"), (BIG, text, "s"), (BIG + 2, words(rng, 50), "s"), (BIG + 4, None, None), (None, "", "s"), (BIG + 2, words(rng, 20), "s"), (5, text + " x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0))) for c in ODD_NAMES}), rows


def test_stages_keep_the_values_of_any_column(odd):
    df, rows = odd
    for drop in (exact_dedup.drop_exact_copies, near_copies.drop_near_copies, simhash.drop_near_copies, mixing.mix_documents):
        got = drop(df)
        assert got.columns == df.columns
        got = got.collect()
        assert got and all(r[c] == f"{c}{r['doc_id'] or 0}" for r in got for c in ODD_NAMES)
        assert {(r["doc_id"], r["text"], r["source"]) for r in got} <= set(rows)
    kept = {(r["doc_id"], r["text"]) for r in exact_dedup.drop_exact_copies(df).collect()}
    assert kept == {(i, t) for i, t, _ in rows if i is not None}  # the null ids have copies under other ids


def test_large_ids_beside_null_ids(odd):
    df, rows = odd
    ids = sorted((i for i, *_ in rows), key=lambda i: i or 0)
    model = quality_classifier.Neighbours(np.zeros((0, quality_classifier.TERMS), np.float32), np.zeros(0, np.int64), 0.5)
    for got in (
        simhash.near_duplicates(df), language_id.identify(df, {"en": [1, 2, 3]}), toxicity.score_documents(df, toxicity.Words({}, 0.0)),
        quality_classifier.score_documents(df, model), packing.packed_digest(df),
    ):
        assert sorted((r["doc_id"] for r in got.collect()), key=lambda i: i or 0) == ids
