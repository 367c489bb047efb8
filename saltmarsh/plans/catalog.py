"""All registered queries."""

from __future__ import annotations

from saltmarsh.plans import audit, contracts, features, feeds, flows, joins, labels, matrix, metrics, more, passes, quality, study, universe  # noqa: F401  (they register)
from saltmarsh.plans.registry import flagship, oracle_sql, queries  # noqa: F401
