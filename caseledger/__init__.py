"""Cohort and detection analytics on Spark DataFrames."""
