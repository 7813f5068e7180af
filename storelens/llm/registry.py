"""Queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
CHECKS: dict[str, str] = {}
MODULES = ("language_id", "bpe", "warc", "html_content", "toxicity", "simhash", "spherical", "decontamination", "suffix_dedup", "lattice_lm",
           "impact_index", "periodic_runs", "spelling")


def query(name: str, check: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register ``fn(spark, sf_dir)``, with its SQL if there is one."""
    def wrap(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return wrap


def load() -> tuple[dict[str, QueryFn], dict[str, str]]:
    for m in MODULES:
        import_module(f"storelens.llm.{m}_queries")
    return QUERIES, CHECKS
