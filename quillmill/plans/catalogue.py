"""The registry of queries and of the SQL that each is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where there is one."""

    def keep(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = query
        if sql is not None:
            _SQL[name] = sql
        return query

    return keep


#: Modules that register queries.
MODULES = (
    "quillmill.operators.analytics",
    "quillmill.operators.lifecycle",
    "quillmill.operators.retrieval",
    "quillmill.operators.search",
    "quillmill.operators.nearest",
    "quillmill.operators.answers",
    "quillmill.operators.directory",
    "quillmill.operators.scrub",
    "quillmill.operators.evaluation",
    "quillmill.operators.text_quality",
    "quillmill.operators.documents",
    "quillmill.operators.sections",
    "quillmill.operators.rules",
    "quillmill.streaming.state",
)


def _load() -> None:
    for name in MODULES:
        importlib.import_module(name)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
