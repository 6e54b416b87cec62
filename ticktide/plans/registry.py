"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from ticktide.plans import factors, market, pages, upkeep

_ALL = {**factors.QUERIES, **market.QUERIES, **upkeep.QUERIES, **pages.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLE_SQL = {name: text for name, (_, text) in _ALL.items() if text}
