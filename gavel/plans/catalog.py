"""All named queries of the core, with their SQL and the inventory rows they cover."""

from __future__ import annotations

from gavel.plans import analytics_plans, archive_plans, events_plans, identity_plans, page_plans, relational_plans, site_plans, text_plans, vector_plans  # noqa: F401
from gavel.plans.registry import ENTRIES, Query


def queries() -> dict[str, Query]:
    return {name: e.run for name, e in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}


def coverage() -> dict[str, list[str]]:
    """The queries that cover each row of the inventory."""
    out: dict[str, list[str]] = {}
    for name, e in ENTRIES.items():
        for row in e.covers:
            out.setdefault(row, []).append(name)
    return dict(sorted(out.items()))
