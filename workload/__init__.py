"""Registered queries: the operators run over lab-shaped views of the given tables."""

from __future__ import annotations


def all_queries():
    from . import forms, partitions, reads, writes  # noqa: F401
    from .registry import QUERIES

    return dict(QUERIES)


def all_oracles():
    from . import forms, partitions, reads, writes  # noqa: F401
    from .registry import ORACLE

    return dict(ORACLE)
