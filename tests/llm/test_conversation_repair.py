"""Conversation repair against a plain search over all scripts, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from saltmarsh.llm import conversation_repair as R

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, tag string, n string, fault string"
INITIAL = {"s": "system", "u": "user", "a": "assistant"}


def scripts(rows, most_inserts=4):
    """All scripts as (cost, letters, repaired rows): rows are (role, text, fault)."""

    def go(i, inserts, cost, letters, out):
        if i == len(rows):
            yield cost, letters, out
        if inserts < most_inserts:
            for role in ("user", "assistant"):
                yield from go(i, inserts + 1, cost + 5, letters + "I", [*out, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            yield from go(i + 1, inserts, cost + 2, letters + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                yield from go(i + 1, inserts, cost + more, letters + "K", [*out, (role, text)])
                for other in ("user", "assistant"):
                    yield from go(i + 1, inserts, cost + 1 + more, letters + "R", [*out, (other, text)])

    return go(0, 0, 0, "", [])


def pattern(rows):
    return re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in rows)) is not None


def by_dynamic_program(rows):
    """The same for longer conversations: least (cost, letters) from each row and place on."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    @cache
    def best(i, place, inserts):
        found = []
        if i == len(rows) and place in ("", "a"):
            found.append((0, "", ()))
        if inserts:
            c, s, o = best(i, due[place], inserts - 1)
            found.append((c + 5, "I" + s, ((INITIAL[due[place]], ""), *o)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, s, o = best(i + 1, place, 2)
            found.append((c + 2, "D" + s, o))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in after[place] and role[:1]:
                    c, s, o = best(i + 1, after[place][role[:1]], 2)
                    found.append((c + more, "K" + s, ((role, text), *o)))
                c, s, o = best(i + 1, due[place], 2)
                found.append((c + 1 + more, "R" + s, ((INITIAL[due[place]], text), *o)))
        return min(found, default=(10**9, "~", ()))

    return best(0, "", 2)


def faults(rows):
    """(role, text, fault) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def ordered(rows):
    """role and text in order of turn (nulls first), role, SHA-256 of the text."""
    filled = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(filled, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def expected(rows, solve=by_dynamic_program):
    turns = ordered(rows)
    marked = faults([(r, x) for _, r, x in turns])
    cost, audit, out = solve(marked)
    numbers = [t for t, _, _ in turns if t is not None]
    kinds = [f for _, _, f in marked]
    pairs = [(a[0][:1] + b[0][:1]) for a, b in zip(marked, marked[1:], strict=False)]
    return (
        max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    )


def test_tables_equal_all_scripts():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", rng.choice(["", "", "", "blank", "truncated"])) for i in range(rng.randint(0, 4))]
        cost, letters, _ = min(x for x in scripts(rows) if pattern(x[2]))
        symbols = bytes(0 if f == "blank" else 1 + 2 * (R._INITIALS.index(r[:1]) if r[:1] in R._INITIALS else 3) + (f == "truncated") for r, _, f in rows)
        for block in (1, 2, 3, 4):
            assert R.tables(block).solve(symbols) == (cost, letters), (rows, block)


def test_long_sequences_in_any_block_length():
    rng = random.Random(4)
    for n in (1, 5, 29, 100, 301):
        symbols = bytes(rng.randrange(R.N_SYMBOLS) for _ in range(n))
        rows = tuple(({0: "x", 1: "system", 2: "user", 3: "assistant", 4: ""}[(s + 1) // 2], "t", "blank" if s == 0 else "truncated" if s % 2 == 0 else "") for s in symbols)
        assert R.tables(3).solve(symbols) == R.tables(1).solve(symbols) == by_dynamic_program(rows)[:2]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "System"]
    texts = ["Yes.", "No!", "", " \n", None, "cut off", "Why? ", "long " * 300 + ".", "é…", "é."]
    out = []
    for conv in [None, *range(150)]:
        for t in range(rng.choice([1, 2, 5, 9])):
            out.append((conv, rng.choice([t, t, t, None, t + 3, -t]), rng.choice(roles[:5] if rng.random() < 0.7 else roles), rng.choice(texts)))
    return out + out[5:9] + [out[7]] * 5 + [(500, i // 2, rng.choice(roles), rng.choice(texts) if i % 3 else f"turn {i}.") for i in range(700)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA).repartition(3)


def by_conversation(rows):
    out = {}
    for conv, *rest in rows:
        out.setdefault(conv, []).append(tuple(rest))
    return out


def test_report_equals_the_plain_search(spark, rows):
    got = {r[0]: tuple(r)[1:] for r in R.repair_report(frame(spark, rows)).collect()}
    assert got == {conv: expected(turns) for conv, turns in by_conversation(rows).items()}


def test_repaired_turns_are_what_the_digest_covers(spark, rows):
    out = {}
    for conv, position, role, text in sorted(R.repaired_turns(frame(spark, rows)).collect(), key=lambda r: r[1]):
        out.setdefault(conv, []).append((position, f"{role}:{text}"))
    digests = {r["conv_id"]: r["repaired_sha256"] for r in R.repair_report(frame(spark, rows)).collect()}
    for conv, digest in digests.items():
        lines = out.get(conv, [])
        assert [p for p, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(x for _, x in lines).encode()).hexdigest() == digest
        assert pattern([(x.partition(":")[0], "") for _, x in lines])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def test_query_over_damaged_rows(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r[0]: tuple(r)[1:] for r in R.op13_conversation_repair(spark, str(tmp_path)).collect()}
    left = by_conversation(damaged(rows))
    assert got == {conv: expected(left.get(conv, [])) for conv, *_ in rows}
    assert any(conv not in left for conv, *_ in rows), "the fixture should have a conversation whose rows all drop"


def test_query_over_the_given_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in R.op13_conversation_repair(spark, sf_dir).collect()}
    left = by_conversation(damaged(rows))
    assert got == {conv: expected(left.get(conv, [])) for conv, *_ in rows}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert R.repair_report(empty).collect() == [] and R.repaired_turns(empty).collect() == []
