"""Registered queries over the study tables, each with its SQL twin."""
