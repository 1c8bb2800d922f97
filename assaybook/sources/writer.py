"""Saving table states: each state is a folder of its own, written once and named by its reader."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..schemas import conform
from .tables import Tables, load_tables


def snapshot_path(out_path: str, snapshot: str) -> str:
    return f"{out_path}/snapshot={snapshot}"


def save_snapshot(tables: Mapping[str, DataFrame], out_path: str, snapshot: str) -> str:
    """Writes the tables as the state `snapshot` and returns its folder.

    Nothing that exists is touched, so the tables may be read from an earlier state. A job that died is
    run again and replaces its own half-written folder; readers are told of a state when this returns.
    """
    path = snapshot_path(out_path, snapshot)
    for name in tables:
        conform(tables[name], name).write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_snapshot(spark: SparkSession, out_path: str, snapshot: str) -> Tables:
    return load_tables(spark, snapshot_path(out_path, snapshot))
