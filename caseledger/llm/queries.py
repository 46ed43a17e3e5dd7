"""Imports every operator module, so that the registry is complete."""

from . import embedding_dedup, exact_dedup, filter_audit, html_text, jaccard_join, language_id, mixing  # noqa: F401
from . import sentencepieces, sharding, spelling, token_files, toxicity, warc  # noqa: F401
from .common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
