"""Registered queries, each with the SQL that must give the same rows."""

from pulsewide.plans.catalog import (  # noqa: F401 - importing registers the queries
    correlation,
    encoding,
    evaluation,
    ingest,
    modelling,
    profiling,
    splitting,
)
from pulsewide.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
