"""Operators for large training-data pipelines (filtering, dedup, scoring, packing, search)."""
