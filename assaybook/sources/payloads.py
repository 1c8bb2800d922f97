"""Reading JSON report bodies and drafts: one JSON object per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import DRAFT, PAYLOAD


def read_payloads(
    spark: SparkSession, path: str, streaming: bool = False, extra: str = "",
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per body with the payload columns, `body_bytes`, `reject_reason` (null when readable)
    and `raw_body`, the text of a refused body. `extra` adds columns to the schema, e.g.
    "report_id STRING"; bodies of more than max_bytes are refused, if given."""
    reader = spark.readStream if streaming else spark.read
    return parse_payloads(reader.text(path), extra, max_bytes)


def parse_payloads(lines: DataFrame, extra: str = "", max_bytes: int | None = None) -> DataFrame:
    return _parse(lines, ", ".join(x for x in (extra, PAYLOAD) if x), max_bytes)


def read_drafts(spark: SparkSession, path: str) -> DataFrame:
    return _parse(spark.read.text(path), DRAFT)


def _parse(lines: DataFrame, ddl: str, max_bytes: int | None = None) -> DataFrame:
    body = F.col("value")
    size = F.octet_length(body)
    large = F.lit(False) if max_bytes is None else F.coalesce(size > max_bytes, F.lit(False))
    parsed = F.from_json(
        F.when(~large, body),
        f"{ddl}, _corrupt STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    reason = F.when(F.col("large"), "body_too_large").when(
        F.col("p").isNull() | F.col("p._corrupt").isNotNull(), "bad_json"
    )
    return lines.select(
        parsed.alias("p"), size.alias("body_bytes"), large.alias("large"), body.alias("raw")
    ).select("p.*", "body_bytes", reason.alias("reject_reason"), "raw").withColumn(
        "raw_body", F.when(F.col("reject_reason").isNotNull(), F.col("raw"))
    ).drop("_corrupt", "raw")


def split_rejects(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows without the reason column, rejected rows)."""
    return (
        payloads.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw_body"),
        payloads.filter(F.col("reject_reason").isNotNull()),
    )
