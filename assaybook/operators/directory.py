"""Owners and pets derived from report history.

Every aggregate here combines before the shuffle, so the one key that all reports without a
phone and a name share costs one partial row per task, however many reports it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import list_limit
from ..functions.text import digits_only, like_any, or_null, owner_key, pet_key
from .newest import newest_rows

PET_FIELDS = ("pet_name", "species", "breed", "age", "sex")


def _keyed(reports: DataFrame) -> DataFrame:
    return reports.select(
        "id", "patient_name", "owner_phone", "referring_vet", *PET_FIELDS, "report_date",
        owner_key(F.col("owner_phone"), F.col("patient_name")).alias("owner_key"),
        pet_key(F.col("pet_name"), F.col("id")).alias("pet_key"),
    )


def _newest_text(name: str) -> Column:
    """Newest non-empty value, '' when there is none."""
    text = or_null(F.col(name))
    return F.coalesce(
        F.max_by(text, F.when(text.isNotNull(), F.col("id"))), F.lit("")
    ).alias(name)


def owner_directory(reports: DataFrame) -> DataFrame:
    """One row per owner: newest known name, phone and vet, newest report, report count."""
    return _keyed(reports).groupBy("owner_key").agg(
        _newest_text("patient_name"),
        _newest_text("owner_phone"),
        _newest_text("referring_vet"),
        F.max("id").alias("last_report_id"),
        F.count(F.lit(1)).alias("reports"),
    )


def pet_directory(reports: DataFrame) -> DataFrame:
    """One row per owner and pet, every field from the pet's newest report even when blank."""
    newest = F.max_by(F.struct(*PET_FIELDS, "report_date"), "id")
    return (
        _keyed(reports)
        .groupBy("owner_key", "pet_key")
        .agg(newest.alias("_p"), F.max("id").alias("last_report_id"))
        .select(
            "owner_key", "pet_key",
            *[F.coalesce(F.col(f"_p.{c}"), F.lit("")).alias(c) for c in PET_FIELDS],
            "last_report_id", F.col("_p.report_date").alias("last_report_date"),
        )
    )


def latest_pet_row(reports: DataFrame) -> DataFrame:
    """The newest report row of each owner and pet."""
    return (
        reports.select(
            owner_key(F.col("owner_phone"), F.col("patient_name")).alias("owner_key"),
            pet_key(F.col("pet_name"), F.col("id")).alias("pet_key"),
            F.struct(*reports.columns).alias("_r"),
        )
        .groupBy("owner_key", "pet_key")
        .agg(F.max_by("_r", "_r.id").alias("_r"))
        .select("owner_key", "pet_key", "_r.*")
    )


def owner_pet_counts(reports: DataFrame) -> DataFrame:
    # one row per pet first, so a huge owner is already spread when pets are counted
    pets = _keyed(reports).groupBy("owner_key", "pet_key").agg(F.max("id").alias("id"))
    return pets.groupBy("owner_key").agg(F.count(F.lit(1)).alias("pets"))


def search_mode(q: str) -> dict:
    """Query echo: trimmed text, its digits, and whether it counts as a phone number."""
    q = (q or "").strip()
    digits = "".join(ch for ch in q if ch in "0123456789")
    return {"query": q, "phone": digits, "is_phone_search": len(digits) >= 7}


def _search_rows(reports: DataFrame, q: str) -> DataFrame:
    mode = search_mode(q)
    if not mode["query"]:
        return reports.filter(F.lit(False))
    phone = mode["is_phone_search"]
    text = mode["phone"] if phone else mode["query"]
    hits = reports.filter(
        like_any(text, [F.col("owner_phone"), F.col("patient_name"), F.col("pet_name")])
    )
    if phone:
        hits = hits.filter(F.contains(digits_only(F.col("owner_phone")), F.lit(text)))
    return hits


def search_owners(reports: DataFrame, q: str, owners: str | int | None = None) -> DataFrame:
    """Owners of all reports that match: newest known name, phone and vet among the matches, newest
    match, pets. All of them, or the newest `owners`."""
    rows = _keyed(_search_rows(reports, q))
    # one row per pet first, so a huge owner is already spread when its pets are counted
    pets = rows.groupBy("owner_key", "pet_key").agg(F.max("id").alias("id"))
    counts = pets.groupBy("owner_key").agg(F.count(F.lit(1)).alias("pets"))
    found = rows.groupBy("owner_key").agg(
        *[_newest_text(c) for c in ("patient_name", "owner_phone", "referring_vet")],
        F.max("id").alias("owner_last_report_id"),
    ).join(counts, "owner_key")
    n = list_limit(owners)
    return found if n is None else newest_rows(found, ["owner_last_report_id"], n)


def patient_search(
    reports: DataFrame, q: str, limit: str | int | None = None, owners: str | int | None = None
) -> DataFrame:
    """Flat pet list of a search, each pet with its owner's fields.

    The list's order is owner_last_report_id, then last_report_id, newest first; `limit` takes its
    first rows and `owners` its first owners, exactly. Without them the whole result is returned,
    unsorted: nothing forces it through one task.
    """
    newest = F.max_by(F.struct(*PET_FIELDS, "report_date"), "id")
    pets = _keyed(_search_rows(reports, q)).groupBy("owner_key", "pet_key").agg(
        newest.alias("_p"), F.max("id").alias("last_report_id")
    )
    out = pets.join(search_owners(reports, q, owners).drop("pets"), "owner_key").select(
        "owner_key", "patient_name", "owner_phone", "referring_vet", "owner_last_report_id",
        "pet_key", *[F.coalesce(F.col(f"_p.{c}"), F.lit("")).alias(c) for c in PET_FIELDS],
        "last_report_id", F.col("_p.report_date").alias("last_report_date"),
    )
    n = list_limit(limit)
    return out if n is None else newest_rows(out, ["owner_last_report_id", "last_report_id"], n)
