"""All queries of the library: name -> callable(spark, sf_dir), and name -> oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """The SQL with the relations it names in front of it."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not head:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def query(name: str, sql: str | None = None) -> Callable:
    """Registers build(tables) -> DataFrame under a name, with its DuckDB equivalent."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return build

    return add


def load() -> None:
    from .plans import aggregates, evaluation, events, extraction, files, intake, layout, relational, rules, scalars, transitions, workflow  # noqa: F401


load()
