"""Structured Streaming ledgers."""
