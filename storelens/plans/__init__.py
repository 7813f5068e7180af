"""Bindings of the operators to tables, one module per operator family."""

from importlib import import_module

FAMILIES = ("event_queries", "funnel_queries", "baseline_queries", "experiment_queries", "catalog_queries", "search_queries", "evidence_queries", "page_queries", "stream_queries")


def load_all() -> None:
    """Import every family so that its queries are registered."""
    for name in FAMILIES:
        import_module(f"storelens.plans.{name}")
