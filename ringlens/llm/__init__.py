"""Operators for large training-data tables: fingerprints, deduplication, extraction, scoring, tokens, mixing, shards."""
