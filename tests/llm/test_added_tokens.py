"""Packing against the vocabulary's library at its default setting."""

from __future__ import annotations

import numpy as np

from saltmarsh.llm import packing


def test_literals_of_added_tokens_have_their_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "a\n<|endoftext|>b  c", "<|endoftext", "plain text", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: b"" for r in docs.collect()}
    for r in sorted(packing.pack_documents(docs).collect(), key=lambda r: r["start"]):
        got[r["doc_id"]] += bytes(r["ids"])
    for i, t in enumerate(texts):
        assert np.frombuffer(got[i], "<u4").tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], repr(t)
    assert 50256 in np.frombuffer(got[0], "<u4")
