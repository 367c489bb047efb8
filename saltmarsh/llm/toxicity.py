"""Toxicity: non-negative positive-unlabelled learning over words.

Positives are documents confirmed as toxic; the unlabelled set is drawn from all
documents of the learning folds, whatever they are labelled.  A linear classifier
with the sigmoid loss is trained in numpy on the risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))

where the class prior is the share of toxic rows among the labelled ones.  When
the second part falls below zero, the step goes up that part instead, as in the
published method.

Features are words, word beginnings, and beginnings that occur at least AGAIN
times, of a bounded vocabulary (those whose share of documents differs most between
the two samples), present or not, over whole texts.  Both training sets are bounded samples; vocabulary and weights are
broadcast (VOCABULARY entries).

Defined cases: a null text is empty; an empty text gets the score of the bias
alone; without positives every score is that of a bias of -30, next to 0; a null id
is scored like any other; repeated rows are scored separately; an empty table gives
an empty result; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import cut, documents, fold, labels, map_texts, slices

#: Rows that the classifier is fitted on, about.
POSITIVES, UNLABELLED = 2000, 8000
VOCABULARY = 500
#: Counts of a word beginning that are features of their own.
AGAIN = (2, 3)
MIN_DOCUMENTS = 5
HELD_OUT_PARTS = 5
STEPS = 250
RATE = 0.05
DECAY = 1e-4
_STRIP = ".,;:!?\"'()[]{}|*#"


def words_of(text: str | None) -> set[str]:
    """The distinct words of a text, their first four and five letters, each behind a ^, and *n where these occur n times."""
    starts: Counter[str] = Counter()
    words = set()
    for raw, n in Counter((text or "").lower().split()).items():
        if w := raw.strip(_STRIP):
            words.add(w)
            for start in {w[:4], w[:5]}:
                starts["^" + start] += n
    return words.union(starts, (f"{s}*{n}" for s, k in starts.items() for n in AGAIN if k >= n))


class Words:
    """Weights of words and a bias; sigmoid of their sum is the score."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(w, 0.0) for w in words_of(text))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_words: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over full batches.

    The loss of a margin z is sigmoid(-z).
    """
    w, b = np.zeros(n_words), -1.0
    m, v = np.zeros(n_words + 1), np.zeros(n_words + 1)
    sides = []
    for rows in (positive, unlabelled):
        sides.append((np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), max(1, len(rows))))

    def margins(side: tuple) -> np.ndarray:
        return np.bincount(side[0], w[side[1]], side[2]) + b

    def back(side: tuple, g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(side[1], g[side[0]], n_words), g.sum())

    for t in range(1, steps + 1):
        sp, su = _sigmoid(margins(sides[0])), _sigmoid(margins(sides[1]))
        # risk of positives as 1 is mean(1 - sp), as 0 mean(sp); of unlabelled as 0 mean(su)
        d_p, d_u = sp * (1 - sp) / sides[0][2], su * (1 - su) / sides[1][2]
        rest = su.mean() - prior * sp.mean()
        g_rest = back(sides[1], d_u) - prior * back(sides[0], d_p)
        grad = -prior * back(sides[0], d_p) + g_rest if rest >= 0 else -g_rest
        grad[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, marks: DataFrame, learn: Callable[[str], Column], doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Words:
    rows = docs.where(learn(doc_id)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    m = marks.where(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").alias("m_id")).agg(F.max(label).alias("y"))
    known = m.where(learn("m_id")).agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n_rows = rows.count()
    if not known["p"] or not n_rows:
        return Words({}, -30.0)
    prior = known["p"] / known["n"]

    def drawn(c: str, share: float) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), c), F.lit(1 << 20)) / (1 << 20) < min(1.0, share)

    # Both samples are drawn by id before a text is read; the ids of positives are about POSITIVES.
    toxic = m.where(F.col("y") == 1).where(learn("m_id") & drawn("m_id", POSITIVES / known["p"])).select("m_id", F.lit(True).alias("is_p"))
    marked = rows.join(F.broadcast(toxic), F.col("doc_id") == F.col("m_id"), "left").withColumn("is_u", drawn("doc_id", UNLABELLED / n_rows))
    chosen = marked.where(F.col("is_p") | F.col("is_u")).select("text", F.coalesce("is_p", F.lit(False)).alias("is_p"), "is_u")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pa.array([sorted(words_of(t)) for t in b.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("is_p"), b.column("is_u"), found], ["is_p", "is_u", "words"])

    both = chosen.mapInArrow(split, "is_p boolean, is_u boolean, words array<string>")
    # A positive that is drawn for the unlabelled set as well is in both.
    sample = cut(both.where("is_p").select(F.lit(1).alias("p"), "words").unionByName(both.where("is_u").select(F.lit(0).alias("p"), "words")))
    n_pos, n_unl = (sample.where(F.col("p") == k).count() for k in (1, 0))
    df = sample.select("p", F.explode("words").alias("w")).groupBy("w").agg(F.count_if(F.col("p") == 1).alias("in_p"), F.count_if(F.col("p") == 0).alias("in_u")).where(F.col("in_p") + F.col("in_u") >= MIN_DOCUMENTS)
    share = (F.col("in_p") + F.col("in_u")) / max(1, n_pos + n_unl)
    lift = F.abs(F.col("in_p") / max(1, n_pos) - F.col("in_u") / max(1, n_unl)) / F.sqrt(share * (1 - share) + 1e-9)
    vocabulary = [r["w"] for r in df.orderBy(lift.desc(), "w").limit(VOCABULARY).collect()]
    index = {w: i for i, w in enumerate(vocabulary)}
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [np.array(sorted(shared.value[w] for w in ws if w in shared.value), "<i4").tobytes() for ws in b.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(at, pa.binary())], ["p", "at"])

    coded = sample.mapInArrow(encode, "p int, at binary").collect()  # at most about POSITIVES + UNLABELLED rows
    coded.sort(key=lambda r: (r["p"], r["at"]))
    sides = [[np.frombuffer(r["at"], "<i4") for r in coded if r["p"] == k] for k in (1, 0)]
    w, b = train_nnpu(sides[0], sides[1], len(vocabulary), prior)
    return Words({x: float(w[i]) for x, i in index.items() if w[i]}, b)


def score_documents(docs: DataFrame, model: Words, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    return map_texts(docs, doc_id, text, lambda texts: [pa.array([shared.value.score(t) for t in texts], pa.float64())], "score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, labels(spark, sf_dir), lambda c: fold(c, HELD_OUT_PARTS) != 0)
    return score_documents(docs, model).select("doc_id", F.coalesce(fold("doc_id", HELD_OUT_PARTS) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
