"""Operators for large text corpora: sharding, deduplication, scoring, mixing and token output."""
