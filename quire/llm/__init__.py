"""Operators for training-data preparation: deduplication, scoring, sharding, extraction, mixing, search, tokens."""
