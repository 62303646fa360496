"""Whole queries built from the operators, with their checking SQL."""

from importlib import import_module

MODULES = [
    "library_queries", "spectrum_queries", "score_queries", "report_queries", "text_queries",
    "source_queries",
]


def all_queries():
    """(queries, checking SQL) of every plan module."""
    for name in MODULES:
        import_module(f"specengine.plans.{name}")
    from specengine.plans.registry import ORACLES, QUERIES

    return QUERIES, ORACLES
