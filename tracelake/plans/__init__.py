"""Registered queries, their input views and their SQL counterparts."""

from importlib import import_module

MODULES = ["inventory_queries", "text_queries", "evidence_queries", "relational_queries", "history_queries",
           "media_queries", "similarity_queries", "triage_queries", "model_queries", "store_queries"]


def load() -> None:
    """Import every module that registers queries."""
    for module in MODULES:
        import_module(f"{__name__}.{module}")
