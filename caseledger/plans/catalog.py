"""Imports every plan module, so that the registry is complete."""

from . import detect, geometry, joins, ledgers, scalars, summaries, volumes  # noqa: F401
from .registry import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
