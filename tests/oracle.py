"""Compare a registered query with its SQL on one input folder."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v) if not isinstance(v, (int, bool)) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(_norm(r[i]) for i in order)) for r in data)


def differences(spark, query, sql, sf_dir: str, con=None) -> list[str]:
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    rel = (con or connect(sf_dir)).sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return [f"columns {sorted(df.columns)} and {sorted(rel.columns)}"]
    a, b = rows(df.columns, got), rows(rel.columns, want)
    if a == b:
        return []
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return [f"{len(a)} and {len(b)} rows", f"spark only {only_a}", f"sql only {only_b}"]
