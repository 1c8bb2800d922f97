"""Joins between reports, panels, results, parameters and users.

No broadcast hints: the optimizer broadcasts a side only when its size, from file statistics or
measured at run time, is below the threshold, and otherwise shuffles and splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import (
    cat_range, dog_range, is_cat, normalize_species, reference_for,
)


def with_author(reports: DataFrame, users: DataFrame) -> DataFrame:
    authors = users.select(F.col("id").alias("_by"), F.col("name").alias("created_by_name"))
    # reports without a creator get keys of their own that match nothing, not one shared null key
    by = F.coalesce("created_by", -F.col("id"))
    return reports.withColumn("_by", by).join(authors, "_by", "left").drop("_by")


def report_panel_details(report_panels: DataFrame, panels: DataFrame) -> DataFrame:
    """Selected panels of each report; retired panels stay visible in history."""
    return report_panels.select("report_id", "panel_id").join(
        panels.select(
            F.col("id").alias("panel_id"), "code", "name", "description", "display_order"
        ),
        "panel_id",
    )


def report_result_details(results: DataFrame, params: DataFrame) -> DataFrame:
    """Measured values with their parameter; retired parameters stay visible in history."""
    return results.select("id", "report_id", "parameter_id", "value", "flag", "remarks").join(
        params.select(
            F.col("id").alias("parameter_id"), "panel_id", "code", "name", "unit",
            "reference_range", "reference_range_dog", "reference_range_cat", "display_order",
        ),
        "parameter_id",
    )


def species_ranges(rows: DataFrame) -> DataFrame:
    """Rows with `species` and the three stored ranges: reference_range becomes the one for the
    species, the dog and cat ranges fall back to the stored general one."""
    dog, cat, legacy = (
        F.col("reference_range_dog"), F.col("reference_range_cat"), F.col("reference_range")
    )
    return rows.withColumns({
        "reference_range": reference_for(F.col("species"), dog, cat, legacy),
        "reference_range_dog": dog_range(dog, legacy),
        "reference_range_cat": cat_range(cat, legacy),
    })


def catalog_ranges(params: DataFrame) -> DataFrame:
    return params.withColumns({
        "reference_range_dog": dog_range(F.col("reference_range_dog"), F.col("reference_range")),
        "reference_range_cat": cat_range(F.col("reference_range_cat"), F.col("reference_range")),
    })


def results_in_panels(panel_rows: DataFrame, result_rows: DataFrame) -> DataFrame:
    """Each selected panel with the results of its parameters: a panel without results keeps
    one row with nulls, results of panels that were not selected are left out.
    Result columns that clash with panel columns get the prefix result_."""
    keys = ["report_id", "panel_id"]
    taken = set(panel_rows.columns)
    renamed = result_rows.select(*[
        F.col(c) if c in keys or c not in taken else F.col(c).alias(f"result_{c}")
        for c in result_rows.columns
    ])
    return panel_rows.join(renamed, keys, "left")


def report_headers(reports: DataFrame, users: DataFrame) -> DataFrame:
    """Report rows with a normalised species and the name of who prepared them."""
    return with_author(
        reports.withColumn("species", normalize_species(F.col("species"))), users
    )


def report_traits(report_panels: DataFrame, panels: DataFrame) -> DataFrame:
    """(report_id, has_ultrasound)"""
    return report_panel_details(report_panels, panels).groupBy("report_id").agg(
        F.max(F.upper("code") == "ULTRASOUND").alias("has_ultrasound")
    )


def report_is_cat(reports: DataFrame) -> DataFrame:
    return reports.select(
        F.col("id").alias("report_id"), is_cat(F.col("species")).alias("is_cat")
    )
