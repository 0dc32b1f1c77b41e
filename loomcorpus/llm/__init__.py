"""Training-data operators for large corpora; nothing else in the package imports this folder.

Each operator lives in a module of its own with its query and, where SQL can express it, its
DuckDB SQL. ``registry()`` collects them for the entry file.
"""

from importlib import import_module

MODULES = ("packing", "quality", "token_counts", "near_dedup", "suffix_dedup", "neighbours", "language_model", "bpe", "sharding", "secrets")


def registry():
    """(queries, oracle SQL) of the ten operators, keyed opN_<name>."""
    queries, oracles = {}, {}
    for module in MODULES:
        m = import_module(f"{__name__}.{module}")
        queries[m.NAME] = m.query
        if m.SQL:
            oracles[m.NAME] = m.SQL
    return queries, oracles
