"""Operators for training-data pipelines: filtering, deduplication, packing, formatting."""
