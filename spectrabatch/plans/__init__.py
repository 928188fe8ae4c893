"""Registered queries and their SQL statements."""

from . import registry, sampling, scoring, spectra, statistics, stream, tables  # noqa: F401  (they register themselves)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
