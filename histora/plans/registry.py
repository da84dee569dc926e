"""The queries over the driver's tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir), and the SQL that gives the same rows."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


from . import formats, graphs, history, journal, lifting, operations, records, streams  # noqa: E402,F401
