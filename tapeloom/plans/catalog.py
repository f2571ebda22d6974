"""Every registered query and the SQL that checks them."""

from __future__ import annotations

from tapeloom.plans import artifacts, charts, factors, features, feeds, jobs, macro, models, parameters, portfolio, returns, risk, scanner, sectors, sources, streams, trading  # noqa: F401  each module registers its queries
from tapeloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
