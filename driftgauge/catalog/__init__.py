"""Every operator bound to the test tables, with equivalent SQL where SQL can express it."""

from driftgauge.catalog import detectors, evaluation, ingest, literal, quality, shifts, splitting  # noqa: F401
from driftgauge.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
