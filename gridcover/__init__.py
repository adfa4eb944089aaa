"""Threshold-based hierarchical spatial aggregation on PySpark."""
