"""Lists and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import list_limit
from ..functions.text import like_any, trim
from ..functions.text import rebook_key as _rebook_key
from .newest import newest_rows

LIST_COLUMNS = (
    "id", "report_no", "patient_name", "pet_name", "species", "sample_date", "report_date",
    "status", "created_at",
)
SEARCHED = ("report_no", "patient_name", "pet_name", "owner_phone")


def report_list(
    reports: DataFrame, q: str = "", limit: str | int | None = None, accent_blind: bool = False
) -> DataFrame:
    """Reports, newest first, optionally only those matching q; all of them, or the newest `limit`."""
    q = (q or "").strip()
    rows = reports.filter(like_any(q, map(F.col, SEARCHED), accent_blind)) if q else reports
    n = list_limit(limit)
    rows = rows.select(*LIST_COLUMNS)
    return rows.orderBy(F.desc("id")) if n is None else newest_rows(rows, ["id"], n)


def report_list_batch(
    reports: DataFrame, queries: Sequence[str], limit: str | int | None = None
) -> DataFrame:
    """report_list for many search strings in one scan: + query_no, position.

    Every search string is a literal pattern tested on each row as it is read, so no pairs of
    rows and strings are built; the per-string top list is cut before the shuffle. Without a limit
    every match is returned, and no positions: order by query_no and id where they are needed.
    """
    if not queries:
        raise ValueError("no queries given")
    n = list_limit(limit)
    hits = F.array(*[F.when(_matches(q), F.lit(i)) for i, q in enumerate(queries)])
    found = reports.select(
        *LIST_COLUMNS, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("query_no")
    )
    if n is None:
        return found
    newest = Window.partitionBy("query_no").orderBy(F.desc("id"))
    return found.withColumn("position", F.row_number().over(newest)).filter(
        F.col("position") <= n
    )


def _matches(q: str) -> Column:
    q = (q or "").strip()
    return like_any(q, map(F.col, SEARCHED)) if q else F.lit(True)


def reports_by_no(reports: DataFrame, nos: DataFrame | Sequence[str]) -> DataFrame:
    return _lookup(reports, nos, "report_no", "report_no")


def reports_by_id(reports: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    return _lookup(reports, ids, "id", "report_id")


def _lookup(
    reports: DataFrame, wanted: DataFrame | Sequence, column: str, key: str
) -> DataFrame:
    if not isinstance(wanted, DataFrame):
        # a short list becomes an IN filter that reaches the parquet reader
        return reports.filter(F.col(column).isin(list(wanted)))
    return reports.join(wanted.select(F.col(key).alias(column)), column, "left_semi")


def active_users(users: DataFrame) -> DataFrame:
    return users.filter(F.col("is_active") == 1).select(
        "id", "name", F.lower(trim(F.col("email"))).alias("email"), "role"
    )


def needs_setup(users: DataFrame) -> DataFrame:
    return users.agg((F.count(F.lit(1)) == 0).alias("needs_setup"))


def rebook_key(reports: DataFrame) -> DataFrame:
    """What to search for to book the same owner again."""
    return reports.select(
        F.col("id").alias("report_id"),
        _rebook_key(
            F.col("owner_phone"), F.col("pet_name"), F.col("patient_name")
        ).alias("rebook_key"),
    )
