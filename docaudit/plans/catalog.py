"""The catalogue of queries over the driver's tables."""

from __future__ import annotations

from docaudit.plans import datasets, evaluation, extras, profiling  # noqa: F401
from docaudit.plans.registry import QUERIES, SQL, Query

FLAGSHIP = "eval_field_breakdown"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
