"""Queries of a study of score families: candidates, sealed evaluation, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import select as C
from saltmarsh.operators import study as Y
from saltmarsh.plans.views import reg
from saltmarsh.streaming import jobs as S

LONG, SHORT = [0.5, 0.6, 0.7, 0.8], [0.5, 0.65, 0.8]
#: The events have seven symbols on thirty days.
NEED = Y.Robust(trades=20, days=10, symbol_share=0.6, symbols=2)


def _decisions(v):
    """Three families of probabilities for each event, with edges and outcomes of a bet on its user's parity."""
    s = v.scores.withColumn("family", F.explode(F.array(*[F.lit(f) for f in ("level", "contrary", "steady")])))
    p = F.when(F.col("family") == "level", F.col("p")).when(F.col("family") == "contrary", 1 - F.col("p")).otherwise((F.col("p") + 0.5) / 2)
    s = s.withColumn("long_p", p).withColumn("short_p", 1 - p)
    return s.select(
        "family", "symbol", F.to_date("ts").alias("day"), "event_id", "long_p", "short_p", (F.col("long_p") * 40 - (1 - F.col("long_p")) * 30).alias("long_edge"), (F.col("short_p") * 40 - (1 - F.col("short_p")) * 30).alias("short_edge"),
        F.when(F.col("y") == 1, 30.0).otherwise(-20.0).alias("long_net"), F.when(F.col("y") == 0, 28.0).otherwise(-22.0).alias("short_net"),
    )


_ROWS = """e AS (SELECT family, symbol, CAST(ts AS DATE) AS day, CASE family WHEN 'level' THEN p WHEN 'contrary' THEN 1 - p ELSE (p + 0.5) / 2 END AS lp, y FROM scores, (SELECT unnest(['level', 'contrary', 'steady']) AS family)),
d AS (SELECT *, 1 - lp AS sp, lp * 40 - (1 - lp) * 30 AS le, (1 - lp) * 40 - (1 - (1 - lp)) * 30 AS se FROM e),
g AS (SELECT * FROM (SELECT unnest([0.5, 0.6, 0.7, 0.8])::DOUBLE AS long_threshold), (SELECT unnest([0.5, 0.65, 0.8])::DOUBLE AS short_threshold)),
k AS (SELECT day AS kd, row_number() OVER (ORDER BY day) > count(*) OVER () - greatest(1, least(ceil(count(*) OVER () * 0.3), count(*) OVER () - 1)) AS is_test FROM (SELECT DISTINCT day FROM e)),
t AS (SELECT family, long_threshold, short_threshold, symbol, day, is_test, CASE WHEN lp >= long_threshold AND le > 0 AND (le >= se OR NOT (sp >= short_threshold AND se > 0)) THEN 'long' WHEN sp >= short_threshold AND se > 0 THEN 'short' END AS action,
  CASE y WHEN 1 THEN 30.0 ELSE -20.0 END AS ln, CASE y WHEN 0 THEN 28.0 ELSE -22.0 END AS sn FROM d JOIN k ON kd = day, g),
u AS (SELECT *, CASE action WHEN 'long' THEN ln ELSE sn END::DOUBLE AS net, unnest(['all', action]) AS side FROM t WHERE action IS NOT NULL)"""
_KEY = "family, long_threshold, short_threshold, side"


def _figures(where: str) -> str:
    """SQL of the candidates' figures over some of the days."""
    return f"""(SELECT a.*, days, symbols, symbol_share, ev - 1.96 * sqrt(greatest(0, ss - 2 * ev * sn + ev * ev * nn)) / trades AS ci_low
  FROM (SELECT {_KEY}, count(*) AS trades, avg(net) AS ev, CASE WHEN sum(net) FILTER (net < 0) < 0 THEN coalesce(sum(net) FILTER (net > 0), 0) / -sum(net) FILTER (net < 0) ELSE coalesce(sum(net) FILTER (net > 0), 0) END AS profit_factor FROM u WHERE {where} GROUP BY ALL) a
  JOIN (SELECT {_KEY}, count(*) AS days, sum(s * s) AS ss, sum(s * n) AS sn, sum(n * n) AS nn FROM (SELECT {_KEY}, day, sum(net) AS s, CAST(count(*) AS DOUBLE) AS n FROM u WHERE {where} GROUP BY ALL) GROUP BY ALL) b USING ({_KEY})
  JOIN (SELECT {_KEY}, count(*) AS symbols, max(n) / sum(n) AS symbol_share FROM (SELECT {_KEY}, symbol, count(*) AS n FROM u WHERE {where} GROUP BY ALL) GROUP BY ALL) c USING ({_KEY}))"""


_CHECKS = {"trades": f"trades >= {NEED.trades}", "days": f"days >= {NEED.days}", "ev": "ev > 0", "ci": "ci_low > 0", "profit_factor": f"profit_factor >= {NEED.profit_factor}", "share": f"symbol_share <= {NEED.symbol_share}", "symbols": f"symbols >= {NEED.symbols}"}
_FAILED = "concat_ws(',', " + ", ".join(f"CASE WHEN NOT {c} THEN side || '_{n}' END" for n, c in _CHECKS.items()) + ")"
_FIGURES = ("trades", "days", "symbols", "ev", "ci_low", "profit_factor", "symbol_share")


def _table(where: str) -> str:
    """SQL of all candidates with what they fail."""
    return f"""(SELECT f.family, g.long_threshold, g.short_threshold, {", ".join(_FIGURES)}, coalesce(reasons, 'all_trades') AS reasons, coalesce(reasons, 'all_trades') = '' AS eligible FROM (SELECT DISTINCT family FROM e) f CROSS JOIN g
  LEFT JOIN (SELECT family, long_threshold, short_threshold, {", ".join(f"max({c}) FILTER (side = 'all') AS {c}" for c in _FIGURES)}, coalesce(string_agg(failed, ',' ORDER BY side) FILTER (failed <> ''), '') AS reasons FROM (SELECT *, {_FAILED} AS failed FROM {_figures(where)}) GROUP BY 1, 2, 3) m
    ON m.family = f.family AND m.long_threshold = g.long_threshold AND m.short_threshold = g.short_threshold)"""


def _days(rows):
    return C.sealed_split(rows, "day", 0.3)


def _candidates(v):
    rows = _decisions(v)
    seen = rows.join(_days(rows).where("split = 'select'").select("day"), "day", "left_semi")
    return Y.robust_candidates(Y.candidates(seen, LONG, SHORT), rows, LONG, SHORT, NEED)


reg("m08_candidates", _candidates, f"WITH {_ROWS} SELECT * FROM {_table('NOT is_test')}", "family long_threshold short_threshold trades days symbols reasons eligible", "ev ci_low profit_factor symbol_share")


def _sealed(v):
    """Seal the choice, evaluate it once, and see that a second evaluation is refused."""
    rows, folder = _decisions(v), S.scratch(v.spark)
    rows = rows.join(_days(rows), "day")
    Y.seal(rows, _candidates(v), f"{folder}/sealed")
    result = Y.evaluate(v.spark, f"{folder}/sealed", rows, F.col("split") == "sealed", f"{folder}/result")
    try:
        Y.evaluate(v.spark, f"{folder}/sealed", rows, F.col("split") == "sealed", f"{folder}/result")
    except ValueError:
        return v.spark.read.parquet(f"{folder}/sealed"), result
    raise AssertionError("the test days were spent twice")


_BEST = "(SELECT family AS bf, long_threshold AS bl, short_threshold AS bs FROM {t} WHERE eligible ORDER BY ci_low DESC, profit_factor DESC, ev DESC, trades DESC, symbol_share, family, long_threshold, short_threshold LIMIT 1)"
_RESULT = f"(SELECT r.* FROM {_figures('is_test')} r JOIN {_BEST.format(t=_table('NOT is_test'))} ON family = bf AND long_threshold = bl AND short_threshold = bs)"
reg("m09_spent_once", lambda v: _sealed(v)[1], f"WITH {_ROWS} SELECT * FROM {_RESULT}", "family long_threshold short_threshold side trades days symbols", "ev ci_low profit_factor symbol_share")

_GATES = ["true", "true", "trades > 0", "trades >= 20", "days >= 5", "ci_low > 0", "profit_factor > 1"]
_GATE_NAMES = ["identity_present", "result_matches_seal", "has_trades", "trade_count", "trading_days", "positive_interval", "profit_factor_above_one"]
reg(
    "m11_acceptance", lambda v: Y.acceptance(*_sealed(v), trades=20, days=5),
    f"WITH {_ROWS}, r AS (SELECT * FROM {_RESULT} WHERE side = 'all') SELECT *, min(CAST(passed AS INTEGER)) OVER () = 1 AS tradable FROM (" + " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS gate, {g} AS passed FROM r" for i, (n, g) in enumerate(zip(_GATE_NAMES, _GATES, strict=True))) + ")",
    "position gate passed tradable",
)
