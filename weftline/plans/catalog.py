"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from weftline.plans import evaluation, filters, graphs, keys, sampling, scans, source_code, vectors, windows  # noqa: F401
from weftline.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
