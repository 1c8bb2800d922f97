"""Arriving reports and request limits."""
