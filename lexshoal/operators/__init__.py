"""Relational operators: n-gram extraction, lookups, aggregation, smoothing, sampling, suffix ranks."""
