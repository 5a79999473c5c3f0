"""Imports every query module, which fills the catalogue."""

from flowwatch.plans import (  # noqa: F401
    detector_queries,
    drift_queries,
    explain_queries,
    feature_queries,
    profile_queries,
    sequence_queries,
    split_queries,
)
from flowwatch.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
