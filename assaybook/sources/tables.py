"""Reading the lab tables."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import OPTIONAL_TABLES, TABLES, conform, empty_table


class Tables(Mapping[str, DataFrame]):
    """Table name -> DataFrame, each built when first asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def changed(
    tables: Mapping[str, DataFrame], changes: Mapping[str, Callable[[], DataFrame]]
) -> Tables:
    """The tables with some of them replaced."""
    return Tables({**{n: (lambda n=n: tables[n]) for n in tables}, **changes})


def load_tables(
    spark: SparkSession,
    path: str | None = None,
    jdbc: dict[str, str] | None = None,
    partitions: int | None = None,
) -> Tables:
    """All lab tables from parquet directories under `path`, or from a database.

    Parquet is read with the declared columns only (no inference). A missing optional table is empty. For a database, `jdbc`
    holds the reader options and every table is read in `partitions` id ranges.
    """
    if (path is None) == (jdbc is None):
        raise ValueError("give either path or jdbc")
    read = (lambda n: _parquet(spark, path, n)) if path else (
        lambda n: _jdbc(spark, jdbc, n, partitions or 2 * spark.sparkContext.defaultParallelism)
    )

    def load(name: str) -> DataFrame:
        try:
            return conform(read(name), name)
        except AnalysisException as err:
            if name not in OPTIONAL_TABLES or err.getCondition() != "PATH_NOT_FOUND":
                raise
            return empty_table(spark, name)

    return Tables({name: (lambda name=name: load(name)) for name in TABLES})


def _parquet(spark: SparkSession, path: str, name: str) -> DataFrame:
    for location in (os.path.join(path, name), os.path.join(path, f"{name}.parquet")):
        try:
            return spark.read.schema(TABLES[name]).parquet(location)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            missing = err
    raise missing


def _jdbc(spark: SparkSession, options: dict[str, str], name: str, partitions: int) -> DataFrame:
    reader = spark.read.format("jdbc").options(**options)
    # the id range is one indexed min/max lookup; rows are then read in parallel ranges
    ends = reader.option("query", f"SELECT MIN(id) AS lo, MAX(id) AS hi FROM {name}").load().first()
    if ends is None or ends["lo"] is None:
        return empty_table(spark, name)
    return (
        reader.option("dbtable", name)
        .option("partitionColumn", "id")
        .option("lowerBound", int(ends["lo"]))
        .option("upperBound", int(ends["hi"]) + 1)
        .option("numPartitions", partitions)
        .load()
    )
