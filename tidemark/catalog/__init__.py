"""Named queries over the star-schema test tables, each with its SQL twin where one exists."""

from __future__ import annotations

from tidemark.catalog import checks, classify, forecasts, prepare, tables, unsupervised

_GROUPS = (tables, prepare, forecasts, classify, unsupervised, checks)


def all_queries() -> dict:
    return {name: fn for g in _GROUPS for name, fn in g.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for g in _GROUPS for name, sql in g.ORACLES.items()}
