"""Operators for large text corpora: tokenising, search, dedup, filters, packing."""
