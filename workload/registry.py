"""Registry of the driver's queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.session import tune

from .labviews import Lab

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, so that both engines print them alike."""
    return df.select(*[
        F.col(c).cast("string").alias(c) if t.startswith(("date", "timestamp")) else F.col(c)
        for c, t in df.dtypes
    ])


def register(name: str, oracle: str | None = None):
    def add(fn: Callable[[Lab], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(fn(Lab(tune(spark), sf_dir)))
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return add
