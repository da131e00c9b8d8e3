"""Every operator as a query over the given tables, each with the same query in plain SQL."""

from catalog import cohort, concept_maps, profiling, raw_tables, scoring, sequencing, temporal  # noqa: F401
from catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
