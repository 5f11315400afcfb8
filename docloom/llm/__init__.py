"""Operators of a large-scale training-data pipeline: search, formatting, filtering, deduplication, packing."""
