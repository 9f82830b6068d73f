"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

from . import aggregation, changes, context, graphs, integrity, relational, search
from .registry import Query

_MODULES = (integrity, relational, aggregation, graphs, search, changes, context)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in _MODULES:
        out |= m.registry.queries
    return out


def sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.registry.sql
    return out
