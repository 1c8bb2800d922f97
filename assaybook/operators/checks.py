"""Uniqueness, references and code conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ci


def key_column(df: DataFrame, name: str) -> Column:
    """Text keys compare case-, accent- and trailing-space-blind."""
    return ci(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name)


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row: the keys and `rows`."""
    return (
        df.select(*[F.col(k) for k in keys], *[key_column(df, k).alias(f"_k_{k}") for k in keys])
        .groupBy(*[f"_k_{k}" for k in keys])
        .agg(*[F.min(k).alias(k) for k in keys], F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > 1)
        .select(*keys, "rows")
    )


def fk_violations(
    child: DataFrame, parent: DataFrame, fk: str, parent_key: str = "id"
) -> DataFrame:
    """Child rows whose (non-null) reference has no parent."""
    return child.filter(F.col(fk).isNotNull()).join(
        parent.select(F.col(parent_key).alias(fk)), fk, "left_anti"
    )


def code_conflicts(
    new: DataFrame, existing: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of new rows: a key that exists already, or that an earlier row of
    the batch (smallest seq) takes, is rejected."""
    ks = [f"_k_{k}" for k in keys]
    new_keys = [key_column(new, k).alias(f"_k_{k}") for k in keys]
    taken = existing.select(*[key_column(existing, k).alias(f"_k_{k}") for k in keys])
    rows = new.select("*", *new_keys)
    first = rows.groupBy(*ks).agg(F.min("seq").alias("_first"))
    free = first.join(taken, ks, "left_anti").select(F.col("_first").alias("seq"))
    return new.join(free, "seq", "left_semi"), new.join(free, "seq", "left_anti")
