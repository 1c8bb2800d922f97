"""Report bodies: validation, coercion, and the create / update jobs.

Every job is a pure function (tables, bodies) -> next tables and refused bodies. A body with one
bad child is refused whole. Bodies carry `seq`, their arrival number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import today_utc
from ..functions.numbers import clean_ids, to_id
from ..functions.ranges import normalize_species
from ..functions.text import or_null, trim
from ..schemas import MAX_FORM_CODE, REPORT_PREFIX, RESULT_TEXT_LIMITS, TEXT_LIMITS, conform
from ..sources.tables import Tables, changed
from .forms import last_writes, replace_forms
from .numbering import last_number, next_id, report_no, running_totals

Store = Callable[[DataFrame, str], DataFrame]

#: Whole bodies are ordered inside ranges of 2^BODY_BITS arrival numbers, so that a task holds few of them.
BODY_BITS = 16

OPTIONAL_TEXT = ("owner_phone", "breed", "age", "sex", "referring_vet", "clinical_notes", "remarks")


# -- validation ----------------------------------------------------------------------------


def _bad_species() -> Column:
    return ~normalize_species(F.col("species")).isin("Dog", "Cat")


def validate_create(payloads: DataFrame, panels: Column | None = None) -> DataFrame:
    """Adds reject_reason, null when the body may be created; the first failing rule wins. panels: the ids of the body's
    panels where they are worked out already."""
    names = or_null(F.col("patient_name")).isNull() | or_null(F.col("pet_name")).isNull()
    no_panel = F.coalesce(F.size(clean_ids(F.col("panel_ids")) if panels is None else panels), F.lit(0)) <= 0
    return payloads.withColumn("reject_reason", F.when(names, "names_required")
                               .when(_bad_species(), "species_required")
                               .when(no_panel, "panel_required"))


def validate_update(payloads: DataFrame, reports: DataFrame) -> DataFrame:
    """Bodies with report_id (text): adds reject_reason. Names and panels are not required."""
    known = reports.select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    return (
        payloads.withColumn("_id", to_id(F.col("report_id").cast("string")))
        .join(known, "_id", "left")
        .withColumn("reject_reason", F.when(F.col("_id").isNull(), "bad_report_id")
                    .when(F.col("_known").isNull(), "report_not_found")
                    .when(_bad_species(), "species_required"))
        .drop("_id", "_known")
    )


def coerce_payload(payloads: DataFrame, mode: str, as_of: str) -> DataFrame:
    """Header values as they are stored. mode is 'create' or 'update'."""
    if mode not in ("create", "update"):
        raise ValueError(f"unknown mode {mode!r}")
    create = mode == "create"
    day = or_null(F.col("report_date")).try_cast("date")
    fixed = {
        "species": normalize_species(F.col("species")),
        "status": F.when(F.col("status") == "draft", "draft").otherwise("final"),
        "sample_date": or_null(F.col("sample_date")).try_cast("date"),
        "report_date": F.when(
            or_null(F.col("report_date")).isNull(), today_utc(as_of)
        ).otherwise(day) if create else day,
        **{c: or_null(F.col(c)) for c in OPTIONAL_TEXT},
    }
    if create:
        fixed |= {c: trim(F.col(c)) for c in ("patient_name", "pet_name")}
    return payloads.withColumns(fixed)


def _storable(mode: str) -> Column:
    """Why the stored header would be refused by its column types; null when it fits."""
    tests = [
        F.when(or_null(F.col(c)).isNotNull() & F.col(c).try_cast("date").isNull(), f"bad_date:{c}")
        for c in ("sample_date", "report_date")
    ]
    for c, n in TEXT_LIMITS.items():
        text = trim(F.col(c)) if mode == "create" and c in ("patient_name", "pet_name") else F.col(c)
        tests.append(F.when(F.length(text) > n, f"too_long:{c}"))
    if mode == "update":
        tests += [F.when(F.col(c).isNull(), f"null:{c}") for c in ("patient_name", "pet_name")]
    return F.coalesce(*tests)


# -- children ------------------------------------------------------------------------------


def _children() -> dict[str, Column]:
    """Child lists of a body as they would be stored, whole; null where the body has no such list."""
    rows = F.filter(
        F.col("results"),
        lambda r: or_null(r["parameter_id"]).isNotNull() & (r["parameter_id"] != "0"),
    )
    rows = F.transform(rows, lambda r: F.struct(
        to_id(r["parameter_id"]).alias("parameter_id"), r["value"].alias("value"),
        or_null(r["flag"]).alias("flag"), or_null(r["remarks"]).alias("remarks"),
    ))
    forms = F.filter(
        F.map_entries("forms"), lambda e: or_null(e["key"]).isNotNull()
    )
    return {
        "_panels": clean_ids(F.col("panel_ids")),
        "_results": rows,
        "_images": clean_ids(F.col("image_ids")),
        "_forms": forms,
    }


def _child_reason() -> Column:
    """Child faults visible inside the body: repeats, unreadable ids, over-long texts and codes."""
    results = F.coalesce(F.col("_results"), F.array().cast(_RESULTS))
    ids = F.transform(results, lambda r: r["parameter_id"])
    long = F.exists(results, lambda r: reduce(lambda a, b: a | b, [
        F.coalesce(F.length(r[c]) > n, F.lit(False)) for c, n in RESULT_TEXT_LIMITS.items()
    ]))
    return F.coalesce(
        F.when(F.size(F.array_distinct("_panels")) < F.size("_panels"), "duplicate_panel"),
        F.when(F.exists(ids, lambda i: i.isNull()), "bad_parameter_id"),
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_parameter"),
        F.when(long, "result_too_long"),
        F.when(F.exists("_forms", lambda e: F.length(e["key"]) > MAX_FORM_CODE), "form_code_too_long"),
    )


_RESULTS = "array<struct<parameter_id:bigint,value:string,flag:string,remarks:string>>"


def _missing_parents(bodies: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(seq, reason) of bodies naming a panel or parameter that does not exist. All ids go
    through one join with the ids of both tables."""
    def named(kind: str, ids: Column) -> Column:
        return F.transform(
            F.coalesce(ids, F.array().cast("array<bigint>")),
            lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("id")),
        )

    refs = F.array_distinct(F.concat(
        named("panel", F.col("_panels")),
        named("parameter", F.transform("_results", lambda r: r["parameter_id"])),
    ))
    known = tables["lab_test_panels"].select(F.lit("panel").alias("kind"), "id").unionByName(
        tables["lab_test_parameters"].select(F.lit("parameter").alias("kind"), "id")
    )
    return (
        bodies.select("seq", F.inline(refs))
        .join(known, ["kind", "id"], "left_anti")
        .groupBy("seq")
        .agg(F.concat(F.lit("unknown_"), F.min("kind")).alias("_parent_reason"))
    )


def _validated_update(payloads: DataFrame, reports: DataFrame, store: Store | None) -> DataFrame:
    """validate_update. With `store` only ids travel to the reports, and the bodies that name none are stored: while these
    are few, whole bodies need no shuffle to meet them."""
    if store is None:
        return validate_update(payloads, reports)
    asked = to_id(F.col("report_id").cast("string"))
    lost = payloads.select("seq", asked.alias("id")).filter(F.col("id").isNotNull()).join(reports.select("id"), "id", "left_anti")
    lost = store(lost.select("seq", F.lit(True).alias("_lost")), "unknown-reports")
    return payloads.join(lost, "seq", "left").withColumn("reject_reason", F.when(asked.isNull(), "bad_report_id")
                                                         .when(F.col("_lost"), "report_not_found")
                                                         .when(_bad_species(), "species_required")).drop("_lost")


def _checked(
    payloads: DataFrame, tables: Mapping[str, DataFrame], mode: str, as_of: str, store: Store | None = None
) -> tuple[DataFrame, DataFrame]:
    """(coerced bodies with child lists, (seq, reject_reason) of refused ones). With `store` bodies are read and their child
    lists worked out once, for all that follows; those that name a missing parent are stored as well: while these are few,
    whole bodies need no shuffle to meet them."""
    if mode == "create":
        rows = validate_create(payloads.withColumns(_children()), F.col("_panels"))
    else:
        rows = _validated_update(payloads, tables["lab_reports"], store).withColumns(_children())
    rows = rows.withColumn(
        "reject_reason", F.coalesce(F.col("reject_reason"), _storable(mode), _child_reason())
    )
    if store is None:
        # no filter before the join: it would work out the child lists a second time
        missing = _missing_parents(payloads.withColumns(_children()), tables)
    else:
        rows = store(rows, "read")
        missing = store(_missing_parents(rows.filter(F.col("reject_reason").isNull()), tables), "missing-parents")
    rows = rows.join(missing, "seq", "left").withColumn(
        "reject_reason", F.coalesce(F.col("reject_reason"), F.col("_parent_reason"))
    ).drop("_parent_reason")
    good = coerce_payload(
        rows.filter(F.col("reject_reason").isNull()).drop("reject_reason"), mode, as_of
    )
    return good, rows.filter(F.col("reject_reason").isNotNull()).select("seq", "reject_reason")


RESULT_FIELDS = ("parameter_id", "value", "flag", "remarks")


def _child_rows(bodies: DataFrame, column: str, start: str) -> DataFrame:
    """One row per list entry, with ids counted on from the body's `start`."""
    fields = {"panel_id": F.col("col")} if column == "_panels" else {
        f: F.col("col")[f] for f in RESULT_FIELDS
    }
    return bodies.select("report_id", F.col(start).alias("_start"), F.posexplode(column)).select(
        (F.col("_start") + F.col("pos")).alias("id"), "report_id",
        *[c.alias(n) for n, c in fields.items()],
    )


def image_positions(payloads: DataFrame) -> DataFrame:
    """(seq, image_id, display_order): place in the body's image list."""
    return payloads.select(
        "seq", F.posexplode(clean_ids(F.col("image_ids")))
    ).select("seq", F.col("col").alias("image_id"), F.col("pos").alias("display_order"))


def attach_images(images: DataFrame, requests: DataFrame, mode: str) -> DataFrame:
    """requests(seq, report_id, image_ids array<bigint>) -> next images.

    create: an image goes to the first body that lists it, if it is unattached or already that
    report's. update: each body frees the report's images, then takes the listed ones, also from
    other reports. The place in the list becomes display_order.
    """
    listed = requests.select(
        "seq", "report_id", F.posexplode("image_ids").alias("pos", "image_id")
    )
    if mode == "create":
        # first body wins; inside that body a repeated image ends at its last place
        claim = F.struct((-F.col("seq")).alias("s"), F.col("pos"))
    elif mode == "update":
        claim = F.struct(F.col("seq").alias("s"), F.col("pos"))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    claims = listed.groupBy(F.col("image_id").alias("id")).agg(
        F.max_by(F.struct("report_id", "pos", "seq"), claim).alias("_c")
    )
    rows = images.join(claims, "id", "left")
    if mode == "create":
        takes = F.col("_c").isNotNull() & (
            F.col("report_id").isNull() | (F.col("report_id") == F.col("_c.report_id"))
        )
        owner = F.when(takes, F.col("_c.report_id")).otherwise(F.col("report_id"))
    else:
        takes = F.col("_c").isNotNull()
        last = requests.groupBy(F.col("report_id").alias("_owner")).agg(
            F.max("seq").alias("_last")
        )
        rows = rows.withColumn("_to", F.coalesce(F.col("_c.report_id"), F.col("report_id")))
        # unattached images get keys of their own that match nothing, not one shared null key
        rows = rows.withColumn("_owner", F.coalesce(F.col("_to"), -F.col("id")))
        rows = rows.join(last, "_owner", "left")
        # a later body of the same report that no longer lists the image frees it
        freed = F.coalesce(
            F.col("_last") > F.coalesce(F.col("_c.seq"), F.lit(-1)), F.lit(False)
        )
        owner = F.when(~freed, F.col("_to"))
    return rows.withColumns({
        "report_id": owner,
        "display_order": F.when(takes, F.col("_c.pos")).otherwise(F.col("display_order")),
    }).select(*images.columns)


# -- create --------------------------------------------------------------------------------


def accept_creates(
    tables: Mapping[str, DataFrame], payloads: DataFrame, as_of: str, prefix: str = REPORT_PREFIX, store: Store | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted bodies with report_id, report_no and the first id of each child list, refused
    (seq, reject_reason)). All six outputs of a create derive from the accepted bodies, so a job
    that writes them stores this frame once and goes on from the stored copy. With `store` bodies are read once; a job that
    wants a single output goes on from the frame as it is, and only the columns of that output travel."""
    good, rejects = _checked(payloads, tables, "create", as_of, store)
    sizes = {
        "_n_report": F.lit(1),
        **{
            f"_n{c}": F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
            for c in ("_panels", "_results", "_forms")
        },
    }
    placed = running_totals(good, ["seq"], sizes, bits=BODY_BITS)
    year = int(as_of[:4])
    number = last_number(tables["lab_reports"], year, prefix) + F.col("_n_report") + 1
    return placed.withColumns({
        "report_no": report_no(F.lit(year), number, prefix),
        "report_id": next_id(tables["lab_reports"]) + F.col("_n_report"),
        "_n_panels": next_id(tables["lab_report_panels"]) + F.col("_n_panels"),
        "_n_results": next_id(tables["lab_report_results"]) + F.col("_n_results"),
        "_n_forms": next_id(tables["lab_report_forms"]) + F.col("_n_forms"),
    }).drop("_n_report"), rejects


def created_rows(accepted: DataFrame, as_of: str, user_id: int) -> Tables:
    """The added rows of the header, panel, result and form tables."""
    now = F.lit(as_of).cast("timestamp_ntz")

    def headers() -> DataFrame:
        return conform(accepted.withColumns({
            "id": F.col("report_id"), "created_by": F.lit(user_id).cast("bigint"),
            "created_at": now, "updated_at": now,
        }), "lab_reports")

    def forms() -> DataFrame:
        last = last_writes(_form_writes(accepted))
        starts = accepted.select("report_id", "_n_forms")
        # codes that only differ in case or beyond 40 characters fall together, leaving id gaps
        return last.join(starts, "report_id").select(
            (F.col("_n_forms") + F.col("pos")).alias("id"), "report_id", "form_code", "form_json",
            now.alias("updated_at"),
        )

    return Tables({
        "lab_reports": headers,
        "lab_report_panels": lambda: _child_rows(accepted, "_panels", "_n_panels"),
        "lab_report_results": lambda: _child_rows(accepted, "_results", "_n_results"),
        "lab_report_forms": forms,
    })


def attachments(bodies: DataFrame) -> DataFrame:
    """Image requests of accepted bodies that carry an image list."""
    return bodies.filter(F.col("_images").isNotNull()).select(
        "seq", "report_id", F.col("_images").alias("image_ids")
    )


def apply_creates(
    tables: Mapping[str, DataFrame], payloads: DataFrame, as_of: str, user_id: int,
    prefix: str = REPORT_PREFIX, store: Store | None = None,
) -> tuple[Tables, DataFrame]:
    """Valid bodies become reports: (next tables, refused (seq, reject_reason)). With `store` (session.stored) bodies are
    accepted once, and all outputs derive from the stored frame."""
    accepted, rejects = accept_creates(tables, payloads, as_of, prefix, store)
    if store is not None:
        accepted = store(accepted, "accepted")
    new = created_rows(accepted, as_of, user_id)
    following = {n: (lambda n=n: tables[n].unionByName(new[n])) for n in new}
    following["lab_report_images"] = lambda: attach_images(
        tables["lab_report_images"], attachments(accepted), "create"
    )
    return changed(tables, following), rejects


def _form_writes(bodies: DataFrame) -> DataFrame:
    return bodies.select("seq", "report_id", F.posexplode("_forms").alias("pos", "e")).select(
        "seq", "report_id", "pos", F.col("e.key").alias("form_code"),
        F.col("e.value").alias("form_json"),
    )


# -- update --------------------------------------------------------------------------------


HEADER_COLUMNS = (
    "patient_name", "owner_phone", "pet_name", "species", "breed", "age", "sex", "referring_vet",
    "sample_date", "report_date", "clinical_notes", "remarks", "status",
)


def accept_updates(
    tables: Mapping[str, DataFrame], payloads: DataFrame, as_of: str, store: Store | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted bodies, refused (seq, reject_reason)). All outputs of an update derive from the
    accepted bodies, so a job that writes them stores this frame once and goes on from the copy."""
    good, rejects = _checked(payloads, tables, "update", as_of, store)
    return good.withColumn("report_id", to_id(F.col("report_id").cast("string"))), rejects


def updated_tables(
    tables: Mapping[str, DataFrame], good: DataFrame, as_of: str,
    numbered: Mapping[str, DataFrame] | None = None,
) -> Tables:
    """The tables after accepted updates. New ids go on from the largest in `numbered` (frames with
    an id column), by default the tables themselves."""
    last_ids = tables if numbered is None else numbered

    def headers() -> DataFrame:
        last = good.groupBy(F.col("report_id").alias("id")).agg(
            F.max_by(F.struct(*HEADER_COLUMNS), "seq").alias("_h")
        )
        hit = F.col("_h").isNotNull()
        new = {c: F.when(hit, F.col(f"_h.{c}")).otherwise(F.col(c)) for c in HEADER_COLUMNS}
        new["updated_at"] = F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(
            F.col("updated_at")
        )
        reports = tables["lab_reports"]
        return reports.join(last, "id", "left").withColumns(new).select(*reports.columns)

    def latest(column: str) -> DataFrame:
        """Last present list per report."""
        return good.filter(F.col(column).isNotNull()).groupBy("report_id").agg(
            F.max_by(column, "seq").alias(column), F.max("seq").alias("seq")
        )

    def replaced(name: str, column: str) -> DataFrame:
        lists = latest(column)
        kept = tables[name].join(lists.select("report_id"), "report_id", "left_anti")
        start = running_totals(lists, ["seq"], {"_n": F.size(column)}).withColumn(
            "_n", next_id(last_ids[name]) + F.col("_n")
        )
        added = conform(_child_rows(start, column, "_n"), name)
        return kept.select(*tables[name].columns).unionByName(added)

    def forms() -> DataFrame:
        lists = latest("_forms")
        writes = _form_writes(lists).withColumn("ts", F.lit(as_of).cast("timestamp_ntz"))
        return replace_forms(
            tables["lab_report_forms"], writes, lists, last_ids["lab_report_forms"]
        )

    return changed(tables, {
        "lab_reports": headers,
        "lab_report_panels": lambda: replaced("lab_report_panels", "_panels"),
        "lab_report_results": lambda: replaced("lab_report_results", "_results"),
        "lab_report_images": lambda: attach_images(
            tables["lab_report_images"], attachments(good), "update"
        ),
        "lab_report_forms": forms,
    })


def apply_updates(
    tables: Mapping[str, DataFrame], payloads: DataFrame, as_of: str, store: Store | None = None
) -> tuple[Tables, DataFrame]:
    """Bodies with report_id replace the header, and each child list that is present: a missing
    list keeps the stored rows, an empty one clears them. Of several bodies for a report the
    last one counts, separately for the header and for each child list.

    With `store` (session.stored) bodies are read once, and all outputs derive from the stored frame: only the header's needs
    coerced texts, so accepted bodies aren't stored again."""
    good, rejects = accept_updates(tables, payloads, as_of, store)
    return updated_tables(tables, good, as_of), rejects


# -- delete --------------------------------------------------------------------------------


def _without(df: DataFrame, ids: DataFrame, column: str, key: str) -> DataFrame:
    return df.join(ids.select(F.col(key).alias(column)), column, "left_anti").select(*df.columns)


def delete_reports(tables: Mapping[str, DataFrame], ids: DataFrame) -> Tables:
    """ids(report_id): the reports and everything that belongs to them."""
    columns = {"lab_reports": "id"} | dict.fromkeys(
        ("lab_report_panels", "lab_report_results", "lab_report_images", "lab_report_forms"),
        "report_id",
    )
    return changed(tables, {
        n: (lambda n=n, c=c: _without(tables[n], ids, c, "report_id")) for n, c in columns.items()
    })


def delete_panels_cascade(tables: Mapping[str, DataFrame], ids: DataFrame) -> Tables:
    """ids(panel_id): panels, their selections, their parameters, and those parameters' results."""
    def results() -> DataFrame:
        gone = tables["lab_test_parameters"].join(
            ids.select("panel_id"), "panel_id", "left_semi"
        ).select(F.col("id").alias("parameter_id"))
        return _without(tables["lab_report_results"], gone, "parameter_id", "parameter_id")

    columns = {
        "lab_test_panels": "id", "lab_test_parameters": "panel_id", "lab_report_panels": "panel_id",
    }
    return changed(tables, {
        **{n: (lambda n=n, c=c: _without(tables[n], ids, c, "panel_id")) for n, c in columns.items()},
        "lab_report_results": results,
    })


def null_deleted_users(tables: Mapping[str, DataFrame], ids: DataFrame) -> Tables:
    """ids(user_id): the users go; their reports and images stay without a creator."""
    def cleared(name: str) -> DataFrame:
        gone = ids.select(F.col("user_id").alias("_by"), F.lit(True).alias("_gone")).distinct()
        # rows without a creator get keys of their own that match nothing, not one null key
        df = tables[name].withColumn("_by", F.coalesce("created_by", -F.col("id")))
        return df.join(gone, "_by", "left").withColumn(
            "created_by", F.when(F.col("_gone").isNull(), F.col("created_by"))
        ).select(*tables[name].columns)

    return changed(tables, {
        "lab_users": lambda: _without(tables["lab_users"], ids, "id", "user_id"),
        "lab_reports": lambda: cleared("lab_reports"),
        "lab_report_images": lambda: cleared("lab_report_images"),
    })


def delete_images(images: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(image_id)"""
    return _without(images, ids, "id", "image_id")
