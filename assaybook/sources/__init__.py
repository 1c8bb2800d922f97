"""Readers, literals and writers."""
