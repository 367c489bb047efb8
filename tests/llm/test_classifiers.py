"""Language profiles and neighbour votes against plain Python: every rank list, distance, cosine and vote."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from saltmarsh.llm import language_id, quality_classifier
from saltmarsh.llm.common import fold

ALPHABETS = {"en": "etaoinshrdlu", "fr": "esaitnrulodcé", "el": "αοιετσνηυρ", "ru": "оеаинтсрвл"}


def _text(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n))


def _documents():
    rng = random.Random(8)
    rows = [(0, None, "en"), (1, "", "en"), (2, " 12 _ \n", "fr"), (3, "É", "fr"), (4, "ab ab ab", None), (5, "I'm, OK?", "en")]
    for i in range(6, 90):
        lang = rng.choice(list(ALPHABETS))
        rows.append((i, _text(rng, ALPHABETS[lang], rng.choice([1, 3, 40, 200])) + rng.choice(["", "!", " 3x", "\n\n"]), rng.choice([lang, lang, None])))
    return rows + [rows[10], rows[10], rows[0]]


def _grams(text):
    """n-gram -> count; an n-gram is a tuple of letter classes, 0 for a boundary."""
    classes = [0]
    for c in (text or "").lower():
        k = (ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) * 2654435761 % 2**32 % 37) if c.isalpha() else 0
        if k or classes[-1]:
            classes.append(k)
    if classes[-1]:
        classes.append(0)
    out = Counter((a,) for a in classes if a)
    out.update(zip(classes, classes[1:], strict=False))
    out.update(g for g in zip(classes, classes[1:], classes[2:], strict=False) if g[1])
    return out


def _ranked(grams, n):
    """The ``n`` most frequent; of equal ones the shorter, then by classes."""
    return sorted(grams, key=lambda g: (-grams[g], len(g), g))[:n]


@pytest.mark.parametrize("size", [300, 20])
def test_profiles_and_distances(spark, size):
    rows = _documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = language_id.learn_profiles(df, "doc_id", "text", "lang", fold("doc_id", 3) != 1, profile=size)
    total = {}
    for i, t, g in rows:
        if g is not None and t is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            total[g] = total.get(g, Counter()) + _grams(t)
    want = {g: _ranked(c, size) for g, c in total.items()}
    code = lambda g: g[0] if len(g) == 1 else 64 + g[0] * 64 + g[1] if len(g) == 2 else 64 + 4096 + g[0] * 4096 + g[1] * 64 + g[2]
    assert learned == {g: [code(x) for x in p] for g, p in want.items()} and len(want) == 4

    def nearest(text):
        own = _ranked(_grams(text), size)
        if not own:
            return "und", 0.0
        d = {g: sum(abs(p.index(x) - i) if x in p else size for i, x in enumerate(own)) for g, p in want.items()}
        best = min(d, key=lambda g: (d[g], g))
        return best, 1 - d[best] / (size * len(own))

    got = sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(df, learned, profile=size).collect())
    assert got == sorted((i, nearest(t)[0], round(nearest(t)[1], 9)) for i, t, _ in rows)


def test_votes_of_all_cosines(spark):
    rng = random.Random(4)
    rows, marks = [(500, None), (501, ""), (502, "a")], []
    for i in range(160):
        good = rng.random() < 0.4
        rows.append((i, _text(rng, "etaoinshr" if good else "qzxj!|#E", rng.choice([2, 30, 90]))))
        marks.append((i, int(good != (rng.random() < 0.1))))
    rows += [rows[20]] * 3
    df, m = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality_classifier.fit(df, m, "quality", lambda c: fold(c, 3) != 1)
    label = {i: y for i, y in marks if zlib.crc32(str(i).encode()) % 3 != 1}
    assert sorted(model.label.tolist()) == sorted(label.values())
    got = {(r["doc_id"], round(r["score"], 4)) for r in quality_classifier.score_documents(df, model).collect()}
    assert len(got) == len({r[0] for r in rows})

    texts = dict(rows)
    counts = np.array([quality_classifier.term_counts(texts[i]) for i in sorted(label)], float)
    y = np.array([label[i] for i in sorted(label)])
    idf = 1 + np.log((1 + len(counts)) / (1 + (counts > 0).sum(0)))
    assert np.allclose(idf, model.idf, atol=1e-4)

    def place(v):
        v = v * idf
        v = (v / max(1e-9, float(np.linalg.norm(v)))) @ model.axes.astype(float)
        return v / max(1e-9, float(np.linalg.norm(v)))

    known = [place(c) for c in counts]
    prior, share = y.mean(), y.mean()
    votes = [prior / share if k else (1 - prior) / (1 - share) for k in y]
    compared = 0
    for i, score in got:
        own = place(quality_classifier.term_counts(texts[i]).astype(float))
        near = sorted(((float(own @ k), n) for n, k in enumerate(known)), reverse=True)
        k = quality_classifier.NEIGHBOURS
        if near[k - 1][0] - near[k][0] < 1e-5:
            continue  # either of two equally near may vote
        weight = [(max(0.0, c) ** 8 * votes[n], y[n]) for c, n in near[:k]]
        whole = sum(w for w, _ in weight)
        assert score == pytest.approx(sum(w * z for w, z in weight) / whole if whole > 0 else prior, abs=2e-3), i
        compared += 1
    assert compared >= 100
