"""Operators for large text corpora: packing, deduplication, scoring, indexing, tokenising."""
