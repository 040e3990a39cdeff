"""Operators for large text collections (training-data pipelines)."""
