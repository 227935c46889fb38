"""Operators for training data: near-duplicates, filters, packing, sharding, scoring, formatting."""
