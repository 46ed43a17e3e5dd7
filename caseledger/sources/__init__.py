"""Scans, sinks and file inventories."""
