"""Structured Streaming counterparts of the batch aggregations."""
