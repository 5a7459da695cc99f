"""Corpus operators for training-data pipelines (deduplication, cleaning, scoring, packing, output)."""
