"""The conversion report as one object: each table is computed once and cut off from its lineage."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from storelens.operators import baseline as B, classify as C, funnel as U
from storelens.operators.attribution import WINDOWS
from storelens.session import written


class ConversionReport:
    """Funnel, leaks, baseline and audit of one store and window.

    Tables are query- or product-grained and small next to the events. Each feeds
    several others, so it is written once: plans stay short and nothing is computed
    twice. Funnel, query rows and tallies read the bundle's attributed stage table.
    """

    def __init__(self, ev: U.Events, products: DataFrame, windows: dict[str, int] = WINDOWS):
        self.ev, self.products, self.windows = ev, products, windows

    @cached_property
    def coverage(self) -> DataFrame:
        return written(U.coverage(self.ev))

    @cached_property
    def measurable(self) -> DataFrame:
        return written(U.measurable(self.coverage, self.ev.sources))

    @cached_property
    def funnel(self) -> DataFrame:
        return written(U.measured_funnel(U.store_funnel(self.ev, self.windows), self.measurable))

    @cached_property
    def rows(self) -> DataFrame:
        measured = U.measured_queries(U.query_funnel(self.ev, self.windows), self.measurable)
        return written(C.classify_leaks(measured, self.funnel, self.coverage))

    @cached_property
    def tallies(self) -> DataFrame:
        return written(B.chosen_products(self.ev, self.windows))

    @cached_property
    def baseline(self) -> DataFrame:
        return written(B.query_baseline(self.rows, self.tallies, self.products))

    def audit(self, limit: int = 12) -> DataFrame:
        return B.audit_candidates(self.rows, self.baseline, limit)
