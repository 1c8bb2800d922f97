"""Operators of a training-data pipeline: cleaning, deduplication, scanning and packing of documents."""
