"""Queries of universe rows and of counts and checks of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from saltmarsh.operators import universe as U
from saltmarsh.plans.views import reg


def _universe(v):
    """Suppliers with their trades; their nation is the sector, its region the index, of which those named with an A are recorded."""
    nation, region = v.table("nation"), v.table("region")
    members = v.table("lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").cast("double").alias("traded"), F.count_distinct(F.to_date("l_shipdate")).alias("days"))
    sectors = v.table("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").alias("n_nationkey")).join(nation, "n_nationkey").select("symbol", F.col("n_name").alias("sector"))
    indices = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sector"), F.col("r_name").alias("sector_index"), F.lower("r_name").alias("feed"))
    return U.universe_rows(members, sectors, indices, region.where(F.col("r_name").startswith("A")).select(F.col("r_name").alias("feed")))


reg(
    "d05_universe_with_feeds", _universe,
    """SELECT *, CASE WHEN available THEN 'available_context' ELSE 'unavailable_context_not_promotable' END AS context FROM (SELECT l_suppkey AS symbol, n_name AS sector, r_name AS sector_index, lower(r_name) AS feed, starts_with(r_name, 'A') AS available, CAST(sum(l_quantity) AS DOUBLE) AS traded, count(DISTINCT CAST(l_shipdate AS DATE)) AS days,
      CAST(sum(l_quantity) AS DOUBLE) / count(DISTINCT CAST(l_shipdate AS DATE)) AS mean_traded FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ALL)""",
    "symbol sector sector_index feed available context days", "traded mean_traded",
)


def _sources(v):
    """Events as sources: the type is the role, what becomes of it the decision."""
    decision = F.when(F.col("event_type") == "signup", "quarantined_events").when(F.col("value") > 50, "selected").otherwise("excluded")
    return v.table("events").select(F.col("event_type").alias("role"), decision.alias("decision"), F.when(F.col("user_id") % 3 != 0, F.lit("exact")).alias("quality"))


_SOURCES = "s AS (SELECT event_type AS role, CASE WHEN event_type = 'signup' THEN 'quarantined_events' WHEN value > 50 THEN 'selected' ELSE 'excluded' END AS decision, CASE WHEN user_id % 3 <> 0 THEN 'exact' END AS quality FROM events)"
reg(
    "d39_source_counts", lambda v: U.source_counts(_sources(v), ["role", "decision", "quality"]),
    f"WITH {_SOURCES} " + " UNION ALL ".join(f"SELECT '{c}' AS what, coalesce({c}, 'missing') AS level, count(*) AS n FROM s GROUP BY ALL" for c in ("role", "decision", "quality")), "what level n",
)
_LEAST = {"clicks": (["click"], 100, True), "clicks_expected": (["click"], 10**9, False), "market": (["click", "view", "purchase"], 300, True), "metadata": (["signup"], 1, True)}
_CHECKS = " UNION ALL ".join(f"SELECT '{n}' AS check_name, count(*) FILTER (role IN ({', '.join(repr(r) for r in roles)})) AS n, {k} AS needed, {b} AS blocks FROM s" for n, (roles, k, b) in _LEAST.items())
reg(
    "d39_source_checks", lambda v: U.source_checks(_sources(v), "role", "decision", _LEAST, ["signup"]).withColumnRenamed("check", "check_name"),
    f"""WITH {_SOURCES} SELECT *, min(CAST(passed OR NOT blocks AS INTEGER)) OVER () = 1 AS ready FROM (SELECT *, n >= needed AS passed FROM ({_CHECKS}) UNION ALL
      SELECT 'quarantined', count(*), 0, true, count(*) = 0 FROM s WHERE role = 'signup' AND NOT starts_with(decision, 'quarantine'))""",
    "check_name n needed passed blocks ready",
)
