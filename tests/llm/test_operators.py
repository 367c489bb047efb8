"""The training-data operators against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from saltmarsh.llm import exact_dedup, language_id, license_scan, mixing, packing, quality_classifier, quality_rules, simhash, suffix_dedup, toxicity
from saltmarsh.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("h", "sha", "fp", "node", "bucket", "n", "size", "__sha", "t", "rid")


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    long = words(rng, 400)
    near = long.split()
    near[200] = "changed"
    passage = words(rng, 60)
    texts = [
        None, "", "", " \n\t ", "one", "a b c", long, long, long, " ".join(near), passage + " " + words(rng, 50), words(rng, 40) + " " + passage,
        words(rng, 3000), "x" * 5000, "ab" * 600, "line one here\nline one here\n" + words(rng, 80), "é ü ñ\r\nß " * 40,
    ]
    texts += [words(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = [(i, t, ["en", "fr", None][i % 3], [None, "s1", "s2", "s3"][i % 4], 0) for i, t in enumerate(texts)]
    return rows + [rows[20], rows[20], rows[0]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_groups(docs, rows):
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.duplicate_groups(docs).collect()}
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    want = {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids}
    assert got == want


def test_exact_result_does_not_depend_on_the_filter(docs):
    tiny = sorted(map(repr, exact_dedup.duplicate_groups(docs, max_bits=1 << 15).collect()))
    assert tiny == sorted(map(repr, exact_dedup.duplicate_groups(docs).collect()))


def test_drop_exact_copies(docs, rows):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    got = sorted(r["doc_id"] for r in kept.select("doc_id").collect())
    best = {}
    for i, t, *_ in rows:
        best[t or ""] = max(i, best.get(t or "", i))
    assert got == sorted(best.values())


def pieces(df):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in df.collect():
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    return by_doc, by_seq


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = pieces(packing.pack_documents(docs, window=128))
    copies = Counter(r[0] for r in rows)
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == copies[i] * len(ids)
        covered = Counter()
        for r in own:
            assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids)
            covered.update(range(r["start"], r["start"] + r["length"]))
        assert set(covered.values()) == {copies[i]}
    short = 0
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
        short += at < 128
    assert short <= 1


def test_tokenizer_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = packing._tokenizer(None)
    for t in ["", " ", "a  b", "a\n b", "a\n\nb ", "it's 12,5\tx", " lead", "trail ", "\n", "don't\nstop now", "a \nb", "\x1cx y", "é ü 你好 🙂", "<|endoftext|> x", "a\r\nb"]:
        assert np.frombuffer(own.encode_with(packing.added_tokens(), t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("hist", [{700: 1000}, {512: 7}, {1: 5000}, {}, {k: k % 7 for k in range(1, 1024)}])
def test_plan_uses_no_more_than_there_is(hist):
    h = np.zeros(1024, np.int64)
    for k, n in hist.items():
        h[k] = n
    plan, left = packing.plan_windows(h)
    used = np.zeros(1024, np.int64)
    for lengths, n in plan:
        assert sum(lengths) == 1024 and n > 0
        for v in lengths:
            used[v] += n
    assert (used + left == h).all() and (left >= 0).all()


def naive_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_components(fps, bits=4):
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    u = sorted(parent)
    for i, a in enumerate(u):
        for b in u[:i]:
            if bin(a ^ b).count("1") <= bits:
                parent[find(a)] = find(b)
    return {f: find(f) for f in u}


def test_simhash_components(docs, rows):
    got = {(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: naive_fingerprint(t) for i, t, *_ in rows}
    root = naive_components(set(fps.values()))
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    assert got == {(i, f, least[root[f]]) for i, f in fps.items()}
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_dense_families_have_the_same_components(spark, monkeypatch):
    rng = random.Random(3)
    centre, fps = rng.getrandbits(64), set()
    for _ in range(60):
        f = centre
        for b in rng.sample(range(64), rng.randint(0, 3)):
            f ^= 1 << b
        fps.add(f)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))], "fp long, node long")
    root = naive_components(fps)
    number = {f: i for i, f in enumerate(sorted(fps))}
    for dense in (32, 4):
        monkeypatch.setattr(simhash, "DENSE", dense)
        label = {r["node"]: r["label"] for r in simhash.components(simhash.links(df)).collect()}
        got = defaultdict(set)
        for f, i in number.items():
            got[label.get(i, i)].add(f)
        want = defaultdict(set)
        for f in fps:
            want[root[f]].add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def naive_removal(raws, width):
    starts = Counter(r[k : k + width] for _, r in raws for k in range(len(r) - width + 1))
    want = Counter()
    for i, r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - width + 1):
            if starts[r[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(i, len(r), int(gone.sum()), spans, bytes(b for b, g in zip(r, gone, strict=False) if not g))] += 1
    return want


def removed(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect())


@pytest.mark.parametrize("large", [256, 2])
def test_suffix_dedup_against_all_windows(docs, rows, monkeypatch, large):
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    assert removed(docs) == naive_removal([(i, (t or "").encode()) for i, t, *_ in rows], suffix_dedup.WIDTH)


def test_suffix_dedup_of_a_passage_in_hundreds_of_contexts(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(suffix_dedup, "LARGE", 8)
    monkeypatch.setattr(suffix_dedup, "BATCH", 16)
    monkeypatch.setattr(suffix_dedup, "FAMILY", 32)
    texts = []
    for n in (80, 150, 190, 199, 230, 400):  # shorter than the width, and longer
        passage = "".join(rng.choice("abcdefgh ") for _ in range(n))
        near = [rng.choice(["", "left side of it " * 3, words(rng, 4)]) for _ in range(5)]
        texts += [words(rng, rng.randint(0, 40)) + rng.choice(near) + passage + rng.choice(near) + words(rng, rng.randint(0, 40)) for _ in range(60)]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    got = removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == naive_removal([(i, t.encode()) for i, t in rows], suffix_dedup.WIDTH)


def test_suffix_levels_mark_what_batches_share():
    rng = random.Random(1)
    parts = [bytes(rng.choice(b"ab") for _ in range(260)) for _ in range(6)]
    parts += [parts[0][:230], b"z" + parts[3][10:240]]
    index = suffix_dedup.SuffixLevels(200)
    for p in parts:
        index.add([p])
    starts = Counter(p[k : k + 200] for p in parts for k in range(len(p) - 199))
    want = [starts[p[k : k + 200]] > 1 for p in parts for k in range(len(p) - 199)]
    assert index.hit.tolist() == want
    assert len(index.levels) <= 4


def naive_shingles(text):
    w = [x for x in re.sub(r"[\W_]+", " ", (text or "").lower()).split(" ") if x]
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def test_licenses(spark):
    """Whole, edited, cut and sibling wordings against the exact share over the whole text."""
    rng = random.Random(9)
    filler = words(rng, 30)
    texts = {0: None, 1: "", 2: filler, 3: "Licensed under the"}
    want = {}
    for name, t in license_scan.TEMPLATES:
        w = t.split()
        texts[len(texts)] = f"{filler} {t} {filler}"
        want[len(texts) - 1] = (name, 1.0)
        if len(w) >= 40:
            k = rng.randrange(5, len(w) - 5)
            edited = " ".join([*w[:k], "changed", *w[k + 1 :]])
            for x in (edited, " ".join(w[: int(len(w) * 0.9)])):
                texts[len(texts)] = f"{filler}\n{x}\n{filler}"
                want[len(texts) - 1] = (name, None)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = defaultdict(dict)
    for r in license_scan.scan_licenses(docs).collect():
        got[r["doc_id"]][r["template"]] = (r["license"], r["containment"])
    template = [set(naive_shingles(t)) for _, t in license_scan.TEMPLATES]
    found = 0
    for i, t in texts.items():
        there = set(naive_shingles(t))
        share = [len(there & s) / len(s) for s in template]
        for k, (_, c) in got[i].items():
            assert c <= share[k] + 1e-9
        if i not in want:
            assert not got[i]
            continue
        best = max(range(len(share)), key=lambda k: (share[k], len(template[k])))
        if share[best] >= 0.8:
            names = {n for n, _ in got[i].values()}
            found += license_scan.TEMPLATES[best][0] in names
            assert names <= {license_scan.TEMPLATES[best][0], want[i][0]}, (t, names)
        if want[i][1]:
            assert want[i] in got[i].values()
    assert found >= 0.99 * sum(max(len(set(naive_shingles(texts[i])) & s) / len(s) for s in template) >= 0.8 for i in want)


def test_language_of_odd_texts(docs, rows):
    profiles = language_id.learn_profiles(docs, "doc_id", "text", "lang", fold("doc_id", 3) != 1)
    got = language_id.identify(docs, profiles).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((i, t) for i, t, *_ in rows)[r["doc_id"]]
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= r["score"] <= 1


def test_gram_counts_of_stretches():
    rng = random.Random(3)
    for text in ("Ab  cd ef-gh " * 20, "", "a", "  ", "".join(rng.choice("aé你 ü-") for _ in range(500))):
        words_ = re.findall(r"[^\W\d_]+", text.lower())
        n = Counter(g for w in words_ for g in [*w, *(f" {w} "[i : i + 2] for i in range(len(w) + 1)), *(f" {w} "[i : i + 3] for i in range(len(w)))])
        whole = language_id.gram_counts(text)
        # Two-letter places hold "end, start" of neighbouring words as "x, boundary" and "boundary, y".
        assert whole.sum() == sum(n.values())
        for stretch in (1, 2, 3, 7, 16, 100):
            assert (language_id.gram_counts(text, stretch) == whole).all()


def test_mixing_meets_targets(docs, rows):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= max(4, 0.01 * target[s])
    key = lambda rows: sorted((r["doc_id"], r["taken"]) for r in rows)
    assert key(got) == key(mixing.mix_plan(docs.repartition(5)).collect())


@pytest.mark.parametrize("budget", [0, 1, 17, 100, 9999, 10**6])
def test_knapsack(budget):
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 60)
    counts = rng.integers(0, 9, 59)
    take = mixing.fit_counts(sizes, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    assert int((sizes * take).sum()) == min(budget, int((sizes * counts).sum()))


def best_sum(sizes, counts, budget):
    reached = {0}
    for s, n in zip(sizes, counts, strict=True):
        reached |= {r + k * s for r in reached for k in range(n + 1) if r + k * s <= budget}
    return max(reached)


def test_knapsack_against_all_sums():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 5)
        sizes, counts = [rng.choice([0, rng.randint(1, 60)]) for _ in range(n)], [rng.randint(0, 6) for _ in range(n)]
        budget = rng.randint(0, 400)
        take = mixing.fit_counts(np.array(sizes), np.array(counts), budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((np.array(sizes) * take).sum()) == best_sum([s for s in sizes if s], [c for s, c in zip(sizes, counts, strict=True) if s], budget)


@pytest.mark.parametrize(("budget", "want"), [(300_000, 300_000), (1_000_000, 1_000_000), (1_299_999, 1_100_000), (699_999, 600_000)])
def test_knapsack_of_long_documents(budget, want):
    sizes, counts = np.array([300_000, 400_000]), np.array([2, 2])
    for s, b, w in ((sizes, budget, want), (sizes * 1000 + 0, budget * 1000, want * 1000)):
        assert int((s * mixing.fit_counts(s, counts, b)).sum()) == w


def naive_quality(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    tri = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(docs, rows):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_rules(docs).collect())
    assert got == Counter((i, *naive_quality(t)) for i, t, *_ in rows)


def test_frequent_lines_deplete(spark):
    rng = random.Random(4)
    menu = words(rng, 60)
    rows = [(i, f"{menu}\n{i} x", "h1") for i in range(5)] + [(9, f"{menu}\n{words(rng, 200)}", "h1"), (10, menu, "h2")] + [(20 + i, "same " + menu, "h3") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df, max_docs=3).collect()}
    assert [got[i] for i in range(5)] == [False] * 5 and got[9] and got[10]
    assert all(got[20 + i] for i in range(5))  # copies of one text count once


def test_quality_classifier_learns(spark):
    rng = random.Random(6)
    rows, marks = [(900, None), (901, "")], []
    for i in range(120):
        good = i % 2
        rows.append((i, words(rng, 80) if good else " | ".join(words(rng, 1).upper() + "!!" for _ in range(80))))
        marks.append((i, good, 0))
    docs, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, m, "quality", lambda c: fold(c, 3) != 1)
    score = {r["doc_id"]: r["score"] for r in quality_classifier.score_documents(docs, model).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(score) == 122 and all((score[i] >= 0.5) == bool(i % 2) for i in held) and 0 <= score[900] == score[901] <= 1
    assert quality_classifier.keep_good(docs, model).columns == docs.columns
    alone = quality_classifier.fit(docs, m.where("quality = 1"), "quality", lambda c: fold(c, 3) != 1)
    assert {r["score"] for r in quality_classifier.score_documents(docs, alone).collect()} == {1.0}


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(8)
    rows, marks = [(900, None), (901, "")], []
    for i in range(400):
        toxic = i % 8 == 0
        rows.append((i, words(rng, 40) + (" vile rotten" if toxic else "")))
        if i < 300:
            marks.append((i, 1, int(toxic)))
    docs, m = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, m, lambda c: fold(c, 5) != 0)
    score = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(score) == 402 and sum((score[i] >= 0.5) == (i % 8 == 0) for i in held) >= 0.97 * len(held) and score[900] < 0.5
    assert toxicity.fit(docs, m.where("toxic = 0"), lambda c: fold(c, 5) != 0).score("vile") < 0.01


def test_empty_tables(spark, empty):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert packing.packed_digest(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert mixing.mix_plan(empty).count() == 0
    assert quality_rules.quality_rules(empty).count() == 0
    assert language_id.identify(empty, language_id.learn_profiles(empty, "doc_id", "text", "lang", fold("doc_id", 3) != 1)).count() == 0
    assert quality_classifier.score_documents(empty, quality_classifier.fit(empty, marks, "quality", lambda c: fold(c, 3) != 1)).count() == 0
    assert toxicity.score_documents(empty, toxicity.fit(empty, marks, lambda c: fold(c, 5) != 0)).count() == 0
