"""Registered queries over the given tables, with their DuckDB SQL where SQL can express them."""

from . import chunks, ordering, records, sampling, tables, text


def _all() -> dict:
    return {k: v for m in (text, records, chunks, ordering, sampling, tables) for k, v in m.QUERIES.items()}


def queries() -> dict:
    return {k: q for k, (q, _) in _all().items()}


def oracles() -> dict:
    return {k: sql for k, (_, sql) in _all().items() if sql}
