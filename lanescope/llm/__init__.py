"""Operators for training-data pipelines: tokenizing, scoring, deduplication, packing, search."""
