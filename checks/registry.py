"""Pairs every registered query with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, where SQL can say it, its oracle."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate check {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
