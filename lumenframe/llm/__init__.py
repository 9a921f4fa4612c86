"""Operators of a training-data pipeline: scoring, extraction, deduplication, search, archives and selection of texts."""
