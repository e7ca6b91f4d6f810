"""The registered queries of the library and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from palisade.queries import histories, plans, relations, streams, texts


def _all() -> dict:
    return relations.QUERIES | histories.QUERIES | texts.QUERIES | plans.QUERIES | streams.QUERIES


def queries() -> dict:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
