"""What belongs to a report, a panel or a draft, as flat rows of one shape at every size.

A report is one header row; its panels, results, images and forms are rows that name it, each with its
place. Nothing is nested, split or cut off, so a report of any size is as many rows as it has children.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.forms import form_map
from ..functions.text import image_url
from .catalog import panels_with_parameters
from .details import (
    report_headers, report_panel_details, report_result_details, results_in_panels, species_ranges,
)

PANEL_FIELDS = ("code", "name", "description", "display_order")
RESULT_FIELDS = (
    "id", "parameter_id", "value", "flag", "remarks", "code", "name", "unit", "reference_range",
    "reference_range_dog", "reference_range_cat", "display_order",
)
IMAGE_FIELDS = ("id", "stored_name", "original_name", "display_order")


def _placed(rows: DataFrame, within: list[str], order: list[str]) -> DataFrame:
    """Adds position, from 0."""
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1
    return rows.withColumn("position", place)


def _of(rows: DataFrame, reports: DataFrame | None) -> DataFrame:
    """Child rows of some reports, or of all."""
    if reports is None:
        return rows.filter(F.col("report_id").isNotNull())
    return rows.join(reports.select(F.col("id").alias("report_id")), "report_id", "left_semi")


def report_bundles(
    tables: Mapping[str, DataFrame], reports: DataFrame | None = None
) -> dict[str, DataFrame]:
    """reports, panels, results, images and forms; `reports` restricts the work to some header rows
    (e.g. reports_by_no).

    results holds the results of selected panels only, with ranges resolved for the report's species;
    it meets its panels and is placed after one shuffle on report_id.
    """
    headers = report_headers(
        tables["lab_reports"] if reports is None else reports, tables["lab_users"]
    )
    panels = report_panel_details(
        _of(tables["lab_report_panels"], reports), tables["lab_test_panels"]
    )
    results = report_result_details(
        _of(tables["lab_report_results"], reports), tables["lab_test_parameters"]
    )
    # species joins the short panel rows, not the long result rows
    species = headers.select(F.col("id").alias("report_id"), "species")
    rows = species_ranges(results_in_panels(panels.join(species, "report_id"), results))
    named = {c: f"result_{c}" if c in PANEL_FIELDS else c for c in RESULT_FIELDS}
    rows = rows.filter(F.col("id").isNotNull()).select(
        "report_id", "panel_id", *[F.col(name).alias(c) for c, name in named.items()]
    )
    images = _of(tables["lab_report_images"], reports).select(
        "report_id", *IMAGE_FIELDS, image_url(F.col("stored_name")).alias("url")
    )
    return {
        "reports": headers.withColumnRenamed("id", "report_id"),
        "panels": _placed(
            panels.select("report_id", "panel_id", *PANEL_FIELDS), ["report_id"],
            ["display_order", "panel_id"],
        ),
        "results": _placed(
            rows, ["report_id", "panel_id"], ["display_order", "parameter_id", "id"]
        ),
        "images": _placed(images, ["report_id"], ["display_order", "id"]),
        "forms": report_forms_map(_of(tables["lab_report_forms"], reports)),
    }


def report_forms_map(forms: DataFrame) -> DataFrame:
    """(report_id, form_code, fields: key/text map); unreadable JSON gives an empty map, of several
    rows of one code the newest counts."""
    newest = forms.groupBy("report_id", "form_code").agg(F.max_by("form_json", "id").alias("j"))
    return newest.select("report_id", "form_code", form_map(F.col("j")).alias("fields"))


def catalog_bundles(
    panels: DataFrame, params: DataFrame, active_only: bool = False
) -> DataFrame:
    """Panel columns, parameter columns, and the place of the parameter in its panel; a panel
    without parameters keeps one row with nulls."""
    rows = panels_with_parameters(panels, params, active_only)
    placed = _placed(rows, ["panel_id"], ["parameter_display_order", "parameter_id"])
    some = F.col("parameter_id").isNotNull()
    return placed.withColumn("position", F.when(some, F.col("position")))


def report_drafts(
    tables: Mapping[str, DataFrame], as_of: Column, reports: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Saved reports as editable drafts: drafts (one row per report, blank texts '', the run date for
    missing dates), panels in print order, values (one per report and parameter, the last one of a
    repeated parameter; these are the included parameters too), images, forms."""
    b = report_bundles(tables, reports)
    day = as_of.cast("date").cast("string")
    texts = (
        "patient_name", "owner_phone", "pet_name", "species", "breed", "age", "sex",
        "referring_vet",
    )
    drafts = b["reports"].select(
        F.col("report_id").alias("editId"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in texts],
        F.coalesce(F.col("sample_date").cast("string"), day).alias("sample_date"),
        F.coalesce(F.col("report_date").cast("string"), day).alias("report_date"),
        F.coalesce(F.col("remarks"), F.lit("")).alias("remarks"),
        F.coalesce(F.col("clinical_notes"), F.lit("")).alias("clinical_notes"),
        F.lit("final").alias("status"),
    )
    last = F.max_by(F.struct("value", "panel_id", "display_order"), "id")
    values = b["results"].groupBy("report_id", "parameter_id").agg(last.alias("v")).select(
        "report_id", "parameter_id", "v.panel_id", "v.display_order",
        F.coalesce("v.value", F.lit("")).alias("value"),
    )
    named = lambda df: df.withColumnRenamed("report_id", "editId")
    return {
        "drafts": drafts,
        "panels": named(b["panels"].select("report_id", "position", "panel_id")),
        "values": named(
            _placed(values, ["report_id", "panel_id"], ["display_order", "parameter_id"])
            .select("report_id", "panel_id", "position", "parameter_id", "value")
        ),
        "images": named(b["images"]),
        "forms": named(b["forms"]),
    }
