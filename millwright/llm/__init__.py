"""Operators for training-data pipelines: dedup, tokens, scoring, secrets, search."""
