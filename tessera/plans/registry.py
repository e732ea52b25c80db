"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` plus, when the
result is deterministic, an equivalent DuckDB SQL string over the same parquet tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
HEADLINE: list[str] = []


def query(name: str, sql: str | None = None, headline: bool = False):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        if headline:
            HEADLINE.append(name)
        return fn
    return deco
