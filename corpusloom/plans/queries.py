"""All registered queries of the engine."""

from __future__ import annotations

from corpusloom.plans import answers, intake, search, store  # noqa: F401
from corpusloom.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
