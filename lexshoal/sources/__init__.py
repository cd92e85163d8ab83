"""Corpus sources and sinks: text tables, token lists, raw token and suffix files, Parquet indexes."""
