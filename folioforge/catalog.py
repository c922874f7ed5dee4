"""The engine's own registry of queries and their SQL equivalents.

Every module that offers queries declares ``QUERIES`` (name -> callable of
``(spark, sf_dir)``) and ``ORACLE_SQL`` (name -> SQL text). This module only
gathers them, so that the driver's entry file stays a thin shell.
"""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("folioforge.plans.scalar_queries", "folioforge.plans.search_queries", "folioforge.plans.join_queries", "folioforge.plans.window_queries", "folioforge.plans.source_queries", "folioforge.plans.more_queries", "folioforge.plans.book_queries", "folioforge.plans.markup_queries", "folioforge.plans.sink_queries", "folioforge.plans.stream_queries", "folioforge.plans.overlay_queries", "folioforge.plans.format_queries")
FLAGSHIP = "q01_search"


def gather() -> tuple[dict, dict]:
    """Return ``(queries, oracle_sql)`` of all registered modules."""
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = importlib.import_module(name)
        queries.update(module.QUERIES)
        oracles.update(getattr(module, "ORACLE_SQL", {}))
    return queries, oracles
