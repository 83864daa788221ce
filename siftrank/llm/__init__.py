"""Operators for text corpora: scoring, filtering, deduplication, tokens and search over record texts."""
