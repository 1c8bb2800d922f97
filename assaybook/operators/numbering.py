"""Running totals and sequence numbers without sending a whole group to one task."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..schemas import REPORT_PREFIX

BUCKET_BITS = 20
SPAN_BITS = 22


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    groups: Sequence[str] = (),
    bits: int = BUCKET_BITS,
) -> DataFrame:
    """Adds, for each name in `sums`, the total over all earlier rows of the group.

    order[0] is a whole arrival number; later entries break ties. Rows are cut into ranges of
    2^bits arrival numbers: each range is totalled (partial aggregation), the range totals are
    prefix-summed, and rows are ordered only inside their own range, so the work of a group of
    any size is spread. Sparse numbers (times, hashes) give a range per row, so the totals are
    summed in two levels: ranges inside a span of 2^SPAN_BITS ranges, then the spans, of which
    64-bit numbers have 2^22 at most. The answer depends only on the data.
    """
    rows = df.withColumn("_bucket", F.shiftright(F.col(order[0]).cast("bigint"), bits))
    keys = [*groups, "_bucket"]
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.withColumn("_span", F.shiftright("_bucket", SPAN_BITS))
    spans = totals.groupBy(*groups, "_span").agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])

    def before(*parts: str, by: str) -> WindowSpec:
        return Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)

    def earlier(window: WindowSpec, name: str) -> list[Column]:
        return [F.coalesce(F.sum(f"_t_{n}").over(window), F.lit(0)).alias(f"{name}_{n}") for n in sums]

    span_offsets = spans.select(*groups, "_span", *earlier(before(*groups, by="_span"), "_s"))
    offsets = totals.select(
        *groups, "_span", "_bucket", *earlier(before(*groups, "_span", by="_bucket"), "_b")
    ).join(span_offsets, [*groups, "_span"]).select(
        *keys, *[(F.col(f"_s_{n}") + F.col(f"_b_{n}")).alias(f"_o_{n}") for n in sums]
    )
    for g in groups:
        rows = rows.filter(F.col(g).isNotNull())
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(offsets, keys).select(
        *df.columns,
        *[
            (F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
            .cast("bigint").alias(n)
            for n, c in sums.items()
        ],
    )


def ranked(df: DataFrame, first: str, second: str, name: str) -> DataFrame:
    """Adds the place of each row by (first, second), from 1; both are whole numbers. Values of
    `first` may be few: their counts are prefix-summed, and rows are ranked inside their value."""
    sizes = running_totals(
        df.groupBy(first).agg(F.count(F.lit(1)).alias("_n")), [first], {"_earlier": F.col("_n")}
    ).select(first, "_earlier")
    inside = running_totals(df, [second], {"_rank": F.lit(1)}, [first])
    return inside.join(sizes, first).select(
        *df.columns, (F.col("_earlier") + F.col("_rank") + 1).alias(name)
    )


def next_id(existing: DataFrame) -> Column:
    """First free id of a table, as a scalar subquery."""
    return existing.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("n")).scalar()


def with_new_ids(df: DataFrame, existing: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `id`: consecutive numbers after the largest existing id, in the given order."""
    numbered = running_totals(df, order, {"_rank": F.lit(1)})
    return numbered.withColumn("id", next_id(existing) + F.col("_rank")).drop("_rank")


def _last_number(report_no: Column) -> Column:
    """Leading whole number of the part after the last dash; null when there is none."""
    tail = F.element_at(F.split(report_no, "-"), -1)
    return F.regexp_extract(tail, r"^\s*\+?([0-9]+)", 1).try_cast("bigint")


def report_no(year: Column, seq: Column, prefix: str = REPORT_PREFIX) -> Column:
    # format_string pads to four digits but keeps longer numbers whole, unlike lpad
    return F.concat(
        F.lit(f"{prefix}-"), year.cast("string"), F.lit("-"),
        F.format_string("%04d", seq.cast("bigint")),
    )


def last_number(existing: DataFrame, year: int, prefix: str = REPORT_PREFIX) -> Column:
    """Number of the last inserted report of the year, 0 when none, as a scalar subquery."""
    # the constant prefix reaches the parquet reader
    old = existing.filter(F.col("report_no").startswith(f"{prefix}-{year}-"))
    last = F.max_by("report_no", "id")
    return old.agg(F.coalesce(_last_number(last), F.lit(0)).alias("n")).scalar()


def assign_report_no(
    new_reports: DataFrame,
    existing: DataFrame,
    year: int | str,
    order: Sequence[str] = ("seq",),
    bits: int = BUCKET_BITS,
    prefix: str = REPORT_PREFIX,
) -> DataFrame:
    """Adds report_no = <prefix>-<year>-<number>, in arrival order.

    `year` is the run year, or the name of a column of new_reports holding each row's year.
    Numbers go on from the last inserted (largest id) report of the year, not from the largest
    number; from 1 when there is none or its number is unreadable.
    """
    rank = {"_rank": F.lit(1)}
    if isinstance(year, int):
        ranked = running_totals(new_reports, order, rank, bits=bits)
        number = report_no(F.lit(year), last_number(existing, year, prefix) + F.col("_rank") + 1, prefix)
        return ranked.withColumn("report_no", number).drop("_rank")
    pattern = rf"^{re.escape(prefix)}-([0-9]{{4}})-"
    last = (
        existing.filter(F.col("report_no").rlike(pattern))
        .groupBy(F.regexp_extract("report_no", pattern, 1).cast("int").alias("_year"))
        .agg(F.max_by("report_no", "id").alias("_last"))
        .select("_year", F.coalesce(_last_number(F.col("_last")), F.lit(0)).alias("_start"))
    )
    rows = new_reports.withColumn("_year", F.col(year).cast("int"))
    number = F.coalesce(F.col("_start"), F.lit(0)) + F.col("_rank") + 1
    return (
        running_totals(rows, order, rank, ["_year"], bits)
        .join(last, "_year", "left")
        .select(*new_reports.columns, report_no(F.col("_year"), number, prefix).alias("report_no"))
    )
