"""Every registered query of the market operators against its SQL."""

from __future__ import annotations

import functools

import oracle
import pytest

from saltmarsh.plans import catalog

SQL = catalog.oracle_sql()
connect = functools.lru_cache(oracle.connect)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    query = catalog.queries()[name]
    if name not in SQL:
        df = query(spark, sf_dir)
        assert len(df.columns) == len(set(df.columns))
        df.collect()
        return
    assert oracle.differences(spark, query, SQL[name], sf_dir, connect(sf_dir)) == []


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() > 0
