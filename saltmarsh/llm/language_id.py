"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams, learned
from a bounded sample of labelled documents.  A document's own list, over its
whole text, is compared with each profile by out-of-place distance: the sum over
its n-grams of the difference in rank, or the list length where the profile
lacks the n-gram.

Letters are mapped to 63 classes (a-z, and hashed classes for the rest), so that
all n-grams of one to three letters are places in one count vector.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0;
ties go to the language first in code-point order; a table without labelled rows
gives ``und`` throughout; a null id is carried as null; repeated rows are judged
separately; an empty table gives an empty result; other columns, whatever their
names, take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saltmarsh.llm.common import documents, fold, map_texts, slices

PROFILE = 300
#: Labelled documents that a language's profile is learned from, about.
SAMPLE_PER_LANGUAGE = 1000
_CLASSES = 64
_SIZE = _CLASSES + _CLASSES**2 + _CLASSES**3
#: Letters taken at a time, so that very long texts need little more memory than their letters.
STRETCH = 1 << 20
_letters: list[np.ndarray] = []


def _letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, 1 to 26 for a to z, 27 to 63 for other letters."""
    if not _letters:
        classes = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                classes[c] = c - 96 if 97 <= c <= 122 else 27 + c * 2654435761 % 4294967296 % 37
        _letters.append(classes)
    return _letters[0]


def letter_codes(text: str, stretch: int = STRETCH) -> np.ndarray:
    """Classes of the text's letters in order, with one 0 before, between and after words."""
    classes = _letter_classes()
    parts = [classes[np.frombuffer(text[i : i + stretch].encode("utf-32-le", "surrogatepass"), "<u4")] for i in range(0, len(text), stretch)]
    a = np.concatenate([np.zeros(1, np.uint8), *parts, np.zeros(1, np.uint8)])
    return a[np.concatenate([[True], (a[1:] > 0) | (a[:-1] > 0)])]


def gram_counts(text: str | None, stretch: int = STRETCH) -> np.ndarray:
    """Counts of all n-grams of one to three letters, words set off by one boundary.

    Stretches share no n-gram, as each takes those that start in it; so the counts
    do not depend on the length of a stretch.
    """
    counts = np.zeros(_SIZE, np.int64)
    codes = letter_codes((text or "").lower(), stretch)
    for i in range(0, len(codes), stretch):
        a = codes[i : i + stretch + 2].astype(np.int64)
        one, two, three = a[:stretch], a[:-1][:stretch], a[:-2]
        two, middle = two * _CLASSES + a[1 : len(two) + 1], a[1 : len(three) + 1]
        three = three * _CLASSES**2 + middle * _CLASSES + a[2:]
        counts += np.bincount(np.concatenate([one[one > 0], two + _CLASSES, three[middle > 0] + _CLASSES + _CLASSES**2]), minlength=_SIZE)
    return counts


def top_grams(counts: np.ndarray, n: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by code."""
    found = np.flatnonzero(counts)
    c = counts[found]
    if len(found) > n:
        least = np.partition(c, len(c) - n)[len(c) - n]
        found, c = found[c >= least], c[c >= least]
    return found[np.lexsort((found, -c))][:n]


def learn_profiles(docs: DataFrame, doc_id: str, text: str, lang: str, learn: "F.Column", per_language: int = SAMPLE_PER_LANGUAGE, profile: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its n-grams in order; one short list a language reaches the driver."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for t, g in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                total[g] = total.get(g, 0) + gram_counts(t)
        for g, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "gram", "n"])

    grams = rows.where(draw < limit).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = grams.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "gram"))), 1, profile)["gram"].alias("grams"))
    return {r["lang"]: list(r["grams"]) for r in sorted(best.collect(), key=lambda r: r["lang"].encode())}


def identify(docs: DataFrame, profiles: dict[str, list[int]], doc_id: str = "doc_id", text: str = "text", profile: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred, score (1 less the distance as a share of the largest possible)."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    ranks: list[np.ndarray] = []

    def to_columns(texts: list[str | None]) -> list[pa.Array]:
        names = list(shared.value)
        if not ranks:
            table = np.full((len(names), _SIZE), profile, np.int32)
            for i, grams in enumerate(shared.value.values()):
                table[i, grams] = np.arange(len(grams))
            ranks.append(table)
        pred, score = [], []
        for t in texts:
            own = top_grams(gram_counts(t), profile)
            if not len(own) or not names:
                pred.append("und")
                score.append(0.0)
                continue
            there = ranks[0][:, own]
            d = np.where(there < profile, np.abs(there - np.arange(len(own))), profile).sum(1)
            i = int(d.argmin())
            pred.append(names[i])
            score.append(1.0 - float(d[i]) / (profile * len(own)))
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

    return map_texts(docs, doc_id, text, to_columns, "lang_pred string, score double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn_profiles(docs, "doc_id", "text", "lang", fold("doc_id", 3) != 1)
    return identify(docs, profiles).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")
