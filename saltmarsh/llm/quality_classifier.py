"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Terms are hashed byte trigrams of the whole text and a few terms for its shape
(share of upper case, of symbols, of distinct words and the like, in steps).  A
bounded, class-balanced sample of labelled documents gives term weights, a
truncated singular value decomposition, and the labelled vectors; these are
broadcast (SAMPLE_PER_CLASS * 2 * RANK floats at most, with the projection).
Every document is projected, its cosine with every labelled vector is computed in
blocks, and the nearest neighbours vote with their similarity.  As the sample is
balanced and the corpus is not, a vote also counts by its class's share of all
labelled documents over its share of the sample.

Defined cases: a null text is empty; an empty text is projected like any other
and has the neutral score if its vector is zero; without labelled rows of both
classes every score is the share of label 1, or 0.5; of ties at the last of the
nearest any may vote; a null id is scored like any other; repeated rows are scored
separately; an empty table gives an empty result; other columns, whatever their
names, take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import documents, fold, labels, map_texts, slices

#: Labelled documents of each class that the classifier is fitted on, about.
SAMPLE_PER_CLASS = 1200
HASHED = 4096
RANK = 64
NEIGHBOURS = 25
#: Documents whose cosines are computed at once.
BLOCK = 512
_STEPS = 12  # steps of each shape term
_SHAPES = 7
_STRETCH = 1 << 20
TERMS = HASHED + _SHAPES * (_STEPS + 1)


def term_counts(text: str | None) -> np.ndarray:
    """Dampened counts of the hashed trigrams, then one term for each shape measure."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    v = np.zeros(TERMS, np.float32)
    b = np.frombuffer(raw, np.uint8)
    grams = np.zeros(HASHED, np.int64)
    for i in range(0, max(0, len(b) - 2), _STRETCH):
        x = b[i : i + _STRETCH + 2].astype(np.uint32)
        h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA6B) ^ x[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
        grams += np.bincount(h >> np.uint32(20), minlength=HASHED)
    v[:HASHED] = np.log1p(grams)
    words = raw.split()
    n, m = max(1, len(words)), max(1, len(b))
    kinds = np.bincount(b, minlength=256)
    letters = max(1, int(kinds[65:91].sum() + kinds[97:123].sum()))
    shapes = (
        kinds[65:91].sum() / letters,
        (kinds[33:48].sum() + kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum()) / m * 3,
        len(set(words)) / n,
        min(1.0, sum(map(len, words)) / n / 16),
        min(1.0, float(np.log1p(n)) / 10),
        grams.max() / m * 8,
        kinds[48:58].sum() / m * 4,
    )
    for k, s in enumerate(shapes):
        v[HASHED + k * (_STEPS + 1) + int(min(1.0, max(0.0, float(s))) * _STEPS)] = 6.0
    return v


class Neighbours:
    """Term weights, projection, and labelled vectors."""

    def __init__(self, counts: np.ndarray, label: np.ndarray, prior: float, rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.label, self.k, self.prior = label.astype(np.float32), min(neighbours, max(1, len(label))), prior
        share = float(label.mean()) if len(label) else 0.5
        self.votes = np.where(label == 1, prior / max(share, 1e-9), (1 - prior) / max(1 - share, 1e-9)).astype(np.float32)
        self.vectors = None
        if 0 < label.sum() < len(label):
            self.idf = (1 + np.log((1 + len(counts)) / (1 + (counts > 0).sum(0)))).astype(np.float32)
            x = self._unit(counts * self.idf)
            # Randomised range finding: enough for the leading directions.
            q = np.random.default_rng(11).standard_normal((x.shape[1], min(rank + 16, *x.shape))).astype(np.float32)
            for _ in range(4):
                q = np.linalg.qr(x.T @ (x @ q))[0]
            _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
            self.axes = (q @ vt.T)[:, :rank].astype(np.float32)
            self.vectors = self._unit(x @ self.axes)

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return (x / np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if self.vectors is None:
            return np.full(len(counts), self.prior)
        cos = self._unit((self._unit(counts * self.idf)) @ self.axes) @ self.vectors.T
        near = np.argpartition(-cos, self.k - 1, axis=1)[:, : self.k]
        w = np.maximum(0.0, np.take_along_axis(cos, near, 1)).astype(float) ** 8 * self.votes[near]
        total = w.sum(1)
        return np.where(total > 0, (w * self.label[near]).sum(1) / np.maximum(1e-12, total), self.prior)


def balanced_sample(rows: DataFrame, label: str, per_class: int) -> tuple[DataFrame, float]:
    """About ``per_class`` rows of each class of ``rows`` (doc_id, label), drawn by a hash of the id; the share of label 1 in all."""
    n = {int(r[label]): r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    share = {k: min(1.0, per_class / v) for k, v in n.items()}
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    limit = F.lit(0.0)
    for k, s in share.items():
        limit = F.when(F.col(label) == k, s).otherwise(limit)
    return rows.where(draw < limit), n.get(1, 0) / sum(n.values()) if n else 0.5


def fit(docs: DataFrame, marks: DataFrame, label: str, learn: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", per_class: int = SAMPLE_PER_CLASS) -> Neighbours:
    """Fit on a sample of ``marks`` (doc_id, label 0 or 1) for which ``learn(id column)`` holds.

    The sample is drawn before the texts are read, and is small enough to send to
    every task, so texts are not shuffled.
    """
    known = marks.where(F.col(label).isin(0, 1) & learn("doc_id")).groupBy("doc_id").agg(F.max(label).alias("y"))
    sample, prior = balanced_sample(known, "y", per_class)
    sample = sample.select(F.col("doc_id").alias("m_id"), "y")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            v = [term_counts(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(v, pa.binary()), b.column("y")], ["doc_id", "v", "y"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("m_id")).select("doc_id", "text", "y")
    # Rows that repeat an id or a text count once, so that no more than the sample reaches the driver.
    got = rows.mapInArrow(terms, "doc_id long, v binary, y int").groupBy("doc_id").agg(F.min(F.struct("v", "y")).alias("r")).select("doc_id", "r.v", "r.y").collect()
    got.sort(key=lambda r: (r["doc_id"], r["y"], r["v"]))
    counts = np.array([np.frombuffer(r["v"], np.float16) for r in got], np.float32).reshape(len(got), TERMS)
    return Neighbours(counts, np.array([r["y"] for r in got], np.int64), prior)


def _scores(model: Neighbours, texts: list[str | None]) -> np.ndarray:
    """Scores of the texts, whose cosines are computed in blocks."""
    blocks = [model.score(np.array([term_counts(t) for t in texts[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)]
    return np.clip(np.concatenate([np.zeros(0), *blocks]), 0.0, 1.0)


def score_documents(docs: DataFrame, model: Neighbours, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def to_columns(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(_scores(shared.value, texts), pa.float64())]

    return map_texts(docs, doc_id, text, to_columns, "score double")


def keep_good(docs: DataFrame, model: Neighbours, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` without those that score below ``least``; all columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_scores(shared.value, texts.tolist()))

    return docs.where(score(F.col(text)) >= least)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir), "quality", lambda c: fold(c, 3) != 1)
    return score_documents(docs, model).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
