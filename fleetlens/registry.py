"""Registry of runnable queries: name -> (Spark builder, DuckDB oracle SQL).

Each Spark builder takes a ``Telemetry`` (test tables + derived telemetry)
and returns a lazy DataFrame.  The oracle is the reference's formulation of
the same report in DuckDB SQL over the same derived telemetry (``None`` for
operators that SQL cannot state, e.g. streaming).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .sources import derive
from .sources.telemetry import Telemetry


@dataclass
class Entry:
    build: Callable[[Telemetry], DataFrame]
    oracle: str | None
    doc: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, oracle_sql: str | None, uses: list[str] | None = None):
    def deco(fn):
        sql = derive.duckdb_with(oracle_sql, uses or []) if oracle_sql is not None else None
        REGISTRY[name] = Entry(fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    from .checks import queries  # noqa: F401  (registers on import)
    return REGISTRY
