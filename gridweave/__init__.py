"""Structured-grid, profile, surface and time-series analytics on PySpark."""
