"""The first rows of an order, however many, without bringing them into one task.

The cut is the value of the last row that belongs to the answer: counts per range of values give it, range within
range, and a filter does the rest. Only counts reach the driver, RANGES of them at most a step; a 64-bit order takes
four steps at most, numbers without gaps two.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 1 << 16
#: Spark's own top list holds this many rows in each task and in the last one.
SMALL = 500


def kth_largest(values: DataFrame, k: int) -> tuple[int, int] | None:
    """(k-th largest value, number of larger ones) of the one whole-number column of a frame; None if it has fewer
    than k values. Nulls don't count."""
    name = values.columns[0]
    c = F.col(name).cast("bigint")
    ends = values.agg(F.min(c).alias("low"), F.max(c).alias("high"), F.count(c).alias("n")).first()
    if ends["n"] < k:
        return None
    low, high, above = ends["low"], ends["high"], 0
    while low < high:
        width = max(1, -(-(high - low + 1) // RANGES))
        # decimals, because the span of 64-bit numbers is no 64-bit number
        place = F.floor((F.lit(high).cast("decimal(20,0)") - c) / F.lit(width).cast("decimal(20,0)")).cast("int")
        inside = values.filter((c >= low) & (c <= high))
        counts = inside.groupBy(place.alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(counts, key=lambda r: r["r"]):
            if above + r["n"] >= k:
                low, high = max(low, high - (r["r"] + 1) * width + 1), high - r["r"] * width
                break
            above += r["n"]
    return low, above


def newest_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of df by the given whole-number columns, largest first, in this order; they hold no null and
    together name a row. More than SMALL rows are cut by value and sorted in ranges."""
    by = [F.desc(c) for c in order]
    if n <= SMALL:
        return df.orderBy(*by).limit(n)
    rest, left, cut = df, n, []
    for column in order:
        found = kth_largest(rest.select(column), left)
        if found is None:
            break
        cut.append((column, found[0]))
        left -= found[1]
        rest = rest.filter(F.col(column) == found[0])
    return df.filter(_not_after(cut)).orderBy(*by) if cut else df.orderBy(*by)


def _not_after(cut: list[tuple[str, int]]) -> Column:
    """Rows that come no later than the cut."""
    column, value = cut[-1]
    last = F.col(column) >= value
    return reduce(lambda later, c: (F.col(c[0]) > c[1]) | ((F.col(c[0]) == c[1]) & later), reversed(cut[:-1]), last)
