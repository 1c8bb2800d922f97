"""Whole reports as flat rows: printed lines, pages, previews."""
