"""The corpus pipeline on the smallest table, stage by stage."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import oracle

from saltmarsh.llm import exact_dedup, registry
from saltmarsh.llm.common import documents
from saltmarsh.llm.packing import _tokenizer


def test_exact_dedup_against_sql(spark, sf_dir):
    assert oracle.differences(spark, exact_dedup.op1_exact_dedup, registry.oracle_sql()["op1_exact_dedup"], sf_dir) == []


def test_stages(spark, sf_dir, tmp_path):
    docs, kept = documents(spark, sf_dir), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    every = documents(spark, sf_dir).collect()
    good = kept["quality"]
    assert 0.5 * len(every) < len(good) < len(every)
    best = {}
    for r in good:
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
    assert sorted(r["doc_id"] for r in kept["exact_dedup"]) == sorted(best.values())
    assert {r["doc_id"] for r in kept["near_dedup"]} <= {r["doc_id"] for r in kept["exact_dedup"]}
    times = Counter(r["doc_id"] for r in kept["mixing"])
    assert set(times) <= {r["doc_id"] for r in kept["near_dedup"]} and set(times.values()) <= {1, 2}
    size = sum(len(r["text"].split()) for r in kept["near_dedup"])
    assert abs(sum(len(r["text"].split()) for r in kept["mixing"]) - 1.5 * size) < 0.01 * size
    texts = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    by = defaultdict(list)
    for r in kept["packing"]:
        by[r["doc_id"]].append(r)
    tok = _tokenizer(None)
    import numpy as np

    for i, n in times.items():
        ids = np.append(np.frombuffer(tok.encode(texts[i]), "<u2"), 0).astype("<u4")
        assert sum(r["length"] for r in by[i]) == n * len(ids)
        assert all(zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in by[i])
