"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from .plans import registry
from .queries import audits, consensus, corpus, exams, relational, retrieval, reviews  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
