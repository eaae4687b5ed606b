"""Registration of queries with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: DuckDB text of the derived views, by name; later ones may use earlier ones.
VIEWS_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """``sql`` with the derived views that it uses, in their order, as common tables."""
    used, text = set(), [sql]
    for name in reversed(VIEWS_SQL):
        if any(re.search(rf"\b{name}\b", t) for t in text):
            used.add(name)
            text.append(VIEWS_SQL[name])
    views = ",\n".join(f"{name} AS ({VIEWS_SQL[name]})" for name in VIEWS_SQL if name in used)
    if not views:
        return sql
    recursive = "WITH RECURSIVE "
    return f"{recursive}{views},\n{sql.removeprefix(recursive)}" if sql.startswith(recursive) else f"WITH {views}\n{sql}"


def query(name: str, sql: str | None = None):
    """Register a function of a ``Views`` object as query ``name``."""

    def put(f):
        from corpuslake.plans.views import Views

        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return put
