"""Collects queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        def register(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.oracles[key] = sql
            return f

        return register
