"""Operators for text corpora: deduplication, filtering, scoring, tokenizing, packing."""
