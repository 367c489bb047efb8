"""Rows with null ids and repeated rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from saltmarsh.llm import exact_dedup, language_id, mixing, quality_classifier, simhash, toxicity


def test_mix_is_the_plan_for_null_and_repeated_ids(spark):
    rows = [(None, "w " * 7, "s1")] * 2 + [(1, "w " * 9, "s1")] * 3 + [(2, "w " * 9, None)] * 3 + [(i, "w " * (3 + i), "s2") for i in range(3, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = Counter()
    for r in mixing.mix_plan(docs).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["taken"] // r["size"]
    got = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in mixing.mix_documents(docs).collect())
    assert got == +want and any(k[0] is None for k in got)


def test_passes_that_the_rows_do_not_divide(spark, monkeypatch):
    rows = [(1, "a b c", "s")] * 3 + [(2, "d e", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = spark.createDataFrame([(1, 3, 6, "s"), (1, 3, 3, "s"), (1, 3, 3, "s"), (2, 2, 2, "s")], "doc_id long, size long, taken long, source string")
    monkeypatch.setattr(mixing, "mix_plan", lambda *a, **k: plan)
    assert Counter(r["doc_id"] for r in mixing.mix_documents(docs).collect()) == {1: 4, 2: 1}


def test_exact_groups_return_every_row_as_their_sql_does(spark):
    import duckdb

    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (3, "a"), (4, None), (5, ""), (6, "c"), (6, "d"), (6, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = exact_dedup.duplicate_groups(docs)
    want = con.execute(exact_dedup.ORACLE).fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and got.count() == len(rows)


def test_fingerprints_without_ids_connect_others(spark):
    fps = [(0, 1), (15, None), (255, 2), (1 << 40, None), (-1, None), (-1, 9)]
    df = spark.createDataFrame(fps, "fp long, doc_id long")
    distinct = df.select("fp", F.col("fp").alias("node"))
    label = {r["node"]: r["label"] for r in simhash.components(simhash.links(distinct)).collect()}
    assert label[0] == label[15] == label[255] == label[1 << 40]
    texts = [(1, "a b c d e"), (None, "a b c d e"), (None, "x y"), (None, "x y"), (4, "x y"), (None, "only here and now")]
    got = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(1, 1), (None, 1), (None, 4), (None, 4), (4, 4), (None, None)])


def test_labels_without_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
    always = lambda c: F.lit(True)
    assert toxicity.score_documents(docs, toxicity.fit(docs, marks, always)).collect() == []
    assert quality_classifier.score_documents(docs, quality_classifier.fit(docs, marks, "quality", always)).collect() == []
    some = spark.createDataFrame([(None, "text"), (1, None)], "doc_id long, text string")
    never = lambda c: F.lit(False)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(some, toxicity.fit(some, marks, never)).collect())


def test_held_out_is_set_for_null_ids(spark, tmp_path):
    spark.createDataFrame([(None, "some text here", "en"), (1, "more text", "en"), (2, "text", "en")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for query in (toxicity.op3_toxicity, language_id.op6_language_id, quality_classifier.op10_quality_classifier):
        assert {r["doc_id"]: r["held_out"] for r in query(spark, str(tmp_path)).collect()}[None] is True
