"""Report drafts: stage, included parameters, the payload a draft saves as."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clean_ids, to_id
from ..functions.ranges import normalize_species
from ..functions.text import or_null


def draft_stage(drafts: DataFrame) -> DataFrame:
    """Adds stage: 'patient' until owner, pet and species are known, then 'tests' until a panel
    is picked, then 'results'."""
    patient = (
        or_null(F.col("patient_name")).isNotNull() & or_null(F.col("pet_name")).isNotNull()
        & normalize_species(F.col("species")).isin("Dog", "Cat")
    )
    tests = F.coalesce(F.size(clean_ids(F.col("panel_ids"))), F.lit(0)) > 0
    return drafts.withColumn(
        "stage", F.when(~patient, "patient").when(~tests, "tests").otherwise("results")
    )


def included(all_ids: Column, saved: Column, snapshot: Column) -> Column:
    """Ids to print: all when nothing was saved; else the saved ones and those that the snapshot
    does not know yet."""
    snapshot = F.coalesce(snapshot, F.array().cast("array<bigint>"))
    kept = F.filter(
        all_ids, lambda x: F.array_contains(saved, x) | ~F.array_contains(snapshot, x)
    )
    return F.when(saved.isNull(), all_ids).otherwise(kept)


def included_parameters(drafts: DataFrame) -> DataFrame:
    """drafts(all_ids, included_parameter_ids, parameter_ids_snapshot: bigint arrays or null)
    -> + included_ids."""
    return drafts.withColumn("included_ids", included(
        F.col("all_ids"), F.col("included_parameter_ids"), F.col("parameter_ids_snapshot")
    ))


def included_parameter_rows(
    all_rows: DataFrame, saved: DataFrame, snapshot: DataFrame, restricted: DataFrame
) -> DataFrame:
    """The same as rows, for lists of any length: all_rows, saved and snapshot hold
    (draft_id, parameter_id); restricted holds the draft_id of drafts that saved a list."""
    key = ["draft_id", "parameter_id"]
    limited = all_rows.join(restricted.select("draft_id"), "draft_id", "left_semi")
    free = all_rows.join(restricted.select("draft_id"), "draft_id", "left_anti")
    keep = limited.join(saved.select(*key), key, "left_semi")
    later = limited.join(snapshot.select(*key), key, "left_anti")
    # a saved id that the snapshot does not know is in both
    later = later.join(saved.select(*key), key, "left_anti")
    return free.select(*key).unionByName(keep.select(*key)).unionByName(later.select(*key))


def draft_payload_results(drafts: DataFrame) -> DataFrame:
    """Adds payload_results: one entry per included id (or, with none, per key of the value
    map), value from the map, '' when missing."""
    listed = clean_ids(F.col("included_parameter_ids"))
    # JS objects list whole-number keys in ascending order
    keys = F.array_sort(clean_ids(F.map_keys("results")))
    use_list = F.coalesce(F.size("included_parameter_ids"), F.lit(0)) > 0
    ids = F.when(use_list, listed).otherwise(keys)
    return drafts.withColumn("payload_results", F.transform(ids, lambda i: F.struct(
        i.alias("parameter_id"),
        F.coalesce(F.try_element_at("results", i.cast("string")), F.lit("")).alias("value"),
        F.lit(None).cast("string").alias("flag"),
        F.lit(None).cast("string").alias("remarks"),
    )))


def draft_payload(drafts: DataFrame) -> DataFrame:
    """The body a draft is saved as."""
    d = draft_payload_results(drafts)
    return d.select(
        "patient_name", "owner_phone", "pet_name", "species", "breed", "age", "sex",
        "referring_vet", or_null(F.col("sample_date")).alias("sample_date"),
        or_null(F.col("report_date")).alias("report_date"),
        F.coalesce("clinical_notes", F.lit("")).alias("clinical_notes"), "remarks",
        F.lit("final").alias("status"), clean_ids(F.col("panel_ids")).alias("panel_ids"),
        F.filter(
            F.transform("images", lambda i: to_id(i["id"])), lambda i: i.isNotNull()
        ).alias("image_ids"),
        F.coalesce("forms", F.create_map().cast("map<string,string>")).alias("forms"),
        F.col("payload_results").alias("results"),
    )
