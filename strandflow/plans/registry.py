"""One entry per operator query, with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


from . import q_aggregates, q_corpus, q_filters, q_functions, q_intervals, q_metrics, q_models, q_samples, q_tokens  # noqa: E402, F401
