"""Operators of a training-data pipeline: quality, toxicity, near-duplicates, mixing, tokens, search, archives."""
