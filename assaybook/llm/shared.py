"""Helpers of this subpackage: the shared folder, stored tables, column names, Arrow batch size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from assaybook.session import shared_folder

#: Rows and bytes of an Arrow batch sent to Python: array work takes some 30 times its bytes.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def new_folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: a short lineage that outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """mapInArrow with batches of bounded size, whatever the length of texts; one row is the least."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def lower_ascii(text):
    """Text with A-Z lowered and nothing else; null stays null."""
    return F.translate(text, _UPPER, _UPPER.lower())


def fresh(taken, *names: str) -> list[str]:
    """Column names that clash with none of those taken, also when case is ignored."""
    have = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wider(df: DataFrame, **more: DataType) -> StructType:
    """The schema of df with further columns."""
    return StructType([*df.schema.fields, *[StructField(name, kind) for name, kind in more.items()]])
