"""Operators of a training-data pipeline: deduplication, filtering, extraction, scoring and tokenising."""
