"""The boilerplate limit follows the size of the host."""

from __future__ import annotations

import random

from test_operators import words

from saltmarsh.llm import quality_rules


def test_limit_is_a_share_of_the_host(spark):
    rng = random.Random(3)
    menu = words(rng, 60)
    small = [(i, f"{menu}\n{words(rng, 10)}" if i < 30 else words(rng, 70), "small") for i in range(60)]
    large = [(1000 + i, f"{menu}\n{words(rng, 10)}" if i < 120 else words(rng, 60), "large") for i in range(4000)]
    df = spark.createDataFrame(small + large, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    assert not any(got[i] for i in range(30)) and all(got[i] for i in range(30, 60))  # half of the host
    assert all(got[1000 + i] for i in range(120))  # 3 % of the host, though over 100 documents


def test_repeated_rows_are_judged_as_one_row_is(spark):
    rng = random.Random(5)
    menu, own = words(rng, 40), words(rng, 60)
    rows = [(7, f"{menu}\n{own}", "h")] * 2 + [(None, f"{menu}\n{own}", "h")] * 2 + [(100 + i, f"{menu}\n{words(rng, 60)}", "h") for i in range(20)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 24 and {(r["words_left"], r["kept"]) for r in got} == {(60, True)}
