"""Universe rows and source checks by hand."""

from __future__ import annotations

import pytest

from saltmarsh.operators import universe as U


def _tables(spark, sectors=(("A", "Banks"), ("B", "Autos"), ("B", "Autos")), indices=(("Banks", "BANK", "bank"), ("Autos", "AUTO", None))):
    return (
        spark.createDataFrame([("A", 10.0, 4), ("B", 5.0, 0)], "symbol string, traded double, days long"), spark.createDataFrame(list(sectors), "symbol string, sector string"),
        spark.createDataFrame(list(indices), "sector string, sector_index string, feed string"), spark.createDataFrame([("BANK",), (None,)], "feed string"),
    )


def test_universe_rows(spark):
    got = {r["symbol"]: r for r in U.universe_rows(*_tables(spark)).collect()}
    assert (got["A"]["available"], got["A"]["context"], got["A"]["mean_traded"]) == (True, "available_context", 2.5)
    assert (got["B"]["available"], got["B"]["feed"], got["B"]["mean_traded"], len(got)) == (False, None, None, 2)


@pytest.mark.parametrize(("change", "named"), [({"sectors": [("A", "Banks"), ("B", "")]}, r"B \(no sector\)"), ({"indices": [("Banks", "BANK", "bank")]}, r"B \(Autos\)")])
def test_missing_metadata_is_an_error(spark, change, named):
    with pytest.raises(ValueError, match=named):
        U.universe_rows(*_tables(spark, **change))


def test_source_checks(spark):
    s = spark.createDataFrame([("m", "selected"), ("m", None), ("news", "quarantined"), ("news", None), (None, "x")], "role string, decision string")
    least = {"m": (["m"], 2, True), "many": (["m", "news"], 9, False)}
    got = {r["check"]: (r["n"], r["passed"], r["ready"]) for r in U.source_checks(s, "role", "decision", least, ["news"]).collect()}
    assert got == {"m": (2, True, False), "many": (4, False, False), "quarantined": (1, False, False)}
    got = {r["check"]: (r["n"], r["passed"], r["ready"]) for r in U.source_checks(s.where("decision IS NOT NULL OR role = 'm'"), "role", "decision", least, ["news"]).collect()}
    assert got["quarantined"] == (0, True, True) and not got["many"][1]
    assert [r["n"] for r in U.source_checks(s.limit(0), "role", "decision", least, ["news"]).collect()] == [0, 0, 0]
    assert {(r["what"], r["level"]): r["n"] for r in U.source_counts(s, ["role", "decision"]).collect()}[("decision", "missing")] == 2
