"""Operators for preparing language-model training data: scoring, deduplication, filtering, mixing, packing."""
