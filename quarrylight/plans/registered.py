"""The queries over the driver's tables by name, with their SQL twins."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def keep(make):
        QUERIES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql
        return make

    return keep
