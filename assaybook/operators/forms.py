"""Checklist forms: ticks, text fields, ultrasound sections, saving."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import form_specs as spec
from ..functions.dates import today_utc
from ..functions.forms import form_defaults, form_map, ultrasound_heading
from ..functions.text import ci, fill_text, image_url, or_null
from ..schemas import MAX_FORM_CODE
from ..session import shared_folder
from .numbering import with_new_ids

LABELS = "form_code STRING, field STRING, code STRING, label STRING, ord INT"


def form_labels(spark: SparkSession) -> DataFrame:
    """The fixed tick labels (about 120 rows)."""
    rows = []
    for form in spec.FORM_PANELS:
        groups = {g: labels for g, (_, labels) in spec.TICKS.get(form, {}).items()}
        groups.update({g: labels for g, (_, _, labels) in spec.CHOICES.get(form, {}).items()})
        ticks = [(g, c, text) for g, labels in groups.items() for c, text in labels.items()]
        rows += [(form, *tick, i) for i, tick in enumerate(ticks, 1)]
    return spark.createDataFrame(rows, LABELS)


def _form_struct(form: str) -> str:
    """Typed schema of one form's ticks and their texts. A tick group that is not an array, and
    a choice that is not plain text, read as nothing ticked, as they print."""
    fields: dict[str, str] = {}
    for group, (other, _) in spec.TICKS.get(form, {}).items():
        fields[group] = "ARRAY<STRING>"
        if other:
            fields[other] = "STRING"
    for field, (text, _, _) in spec.CHOICES.get(form, {}).items():
        fields[field] = "STRING"
        if text:
            fields[text] = "STRING"
    return ", ".join(f"`{k}` {v}" for k, v in fields.items())


def _tick(field: str, text: Column):
    return lambda code: F.struct(
        F.lit(field).alias("field"), code.alias("code"),
        F.when(code == "other", text).alias("free_text"),
    )


def _ticks(form: str, parsed: Column) -> Column:
    """array<struct<field, code, free_text>> of one parsed form."""
    raw_text = form == "SKIN_SCRAPING"  # this form prints the free text untrimmed

    def free(name: str) -> Column:
        return or_null(parsed[name]) if raw_text else fill_text(parsed[name])

    parts = []
    for group, (other, _) in spec.TICKS.get(form, {}).items():
        text = free(other) if other else F.lit(None).cast("string")
        codes = F.coalesce(F.array_distinct(parsed[group]), F.array().cast("array<string>"))
        parts.append(F.transform(codes, _tick(group, text)))
    for field, (text, owner, _) in spec.CHOICES.get(form, {}).items():
        value = free(text) if text else F.lit(None).cast("string")
        parts.append(F.array(F.struct(
            F.lit(field).alias("field"), parsed[field].alias("code"),
            F.when(parsed[field] == (owner or ""), value).alias("free_text"),
        )))
    return F.concat(*parts)


def form_findings(forms: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per printed tick: report_id, form_code, field, code, label, ord, free_text.
    Codes that are not on the form are not printed and drop out."""
    labels = form_labels(forms.sparkSession) if labels is None else labels
    ticks = None
    for form in (*spec.TICKS, *[f for f in spec.CHOICES if f not in spec.TICKS]):
        parsed = F.from_json(F.col("form_json"), _form_struct(form))
        one = F.when(F.col("form_code") == form, _ticks(form, parsed))
        ticks = one if ticks is None else F.coalesce(ticks, one)
    return (
        forms.filter(F.col("form_code").isin(*spec.FORM_PANELS))
        .select("report_id", "form_code", F.inline(ticks))
        .filter(F.col("code").isNotNull())
        # the label table is fixed, see form_labels
        .join(F.broadcast(labels), ["form_code", "field", "code"])
        .select("report_id", "form_code", "field", "code", "label", "ord", "free_text")
    )


def _form_rows(forms: DataFrame, selected: DataFrame | None) -> DataFrame:
    """(report_id, form_code, form_json) of the known forms; with `selected` (report_id,
    form_code) exactly those pairs, saved or not."""
    saved = forms.filter(F.col("form_code").isin(*spec.FORM_PANELS)).select(
        "report_id", "form_code", "form_json"
    )
    if selected is None:
        return saved
    wanted = selected.filter(F.col("form_code").isin(*spec.FORM_PANELS)).select(
        "report_id", "form_code"
    )
    return wanted.join(saved, ["report_id", "form_code"], "left")


def selected_forms(report_panels: DataFrame, panels: DataFrame) -> DataFrame:
    """(report_id, form_code) of the form panels selected on each report."""
    from .details import report_panel_details

    details = report_panel_details(report_panels, panels)
    return details.select("report_id", F.upper("code").alias("form_code")).filter(
        F.col("form_code").isin(*spec.FORM_PANELS)
    )


def form_fields(
    forms: DataFrame, reports: DataFrame, as_of: str, selected: DataFrame | None = None
) -> DataFrame:
    """One row per text field after defaults and prefill: report_id, form_code, ord, field,
    value (null = blank line)."""
    header = reports.select(
        F.col("id").alias("report_id"), "patient_name", "owner_phone", "pet_name", "species",
        "breed", "sex", "age", "referring_vet", "sample_date", "report_date",
    )
    sources = {
        c: F.col(c).cast("string") for c in header.columns if c != "report_id"
    } | {"today": today_utc(as_of)}
    saved = form_map(F.col("form_json"))
    cells = None
    for form in spec.FORM_PANELS:
        filled = form_defaults(form, sources, saved)
        show = or_null if form == "SKIN_SCRAPING" else fill_text
        one = F.when(F.col("form_code") == form, F.array(*[
            F.struct(
                F.lit(i).alias("ord"), F.lit(field).alias("field"),
                show(F.try_element_at(filled, F.lit(field))).alias("value"),
            )
            for i, field in enumerate(spec.TEXT_FIELDS[form], 1)
        ]))
        cells = one if cells is None else F.coalesce(cells, one)
    return _form_rows(forms, selected).join(header, "report_id").select(
        "report_id", "form_code", F.inline(cells)
    )


def ultrasound_sections(
    forms: DataFrame, images: DataFrame, selected: DataFrame | None = None
) -> DataFrame:
    """Flat ultrasound block per report: the heading, four text fields, then the images in
    order. report_id, kind, ord, item_id, title, text (null = blank lines)."""
    us = _form_rows(forms, selected).filter(F.col("form_code") == "ULTRASOUND")
    fields = ", ".join(f"{f} STRING" for f in spec.TEXT_FIELDS["ULTRASOUND"])
    parsed = F.from_json("form_json", f"{_form_struct('ULTRASOUND')}, {fields}")
    us = us.select("report_id", parsed.alias("f"))
    heading = F.struct(
        F.lit("heading").alias("kind"), F.lit(0).alias("ord"), F.lit(0).cast("bigint").alias("item_id"),
        ultrasound_heading(F.col("f.us_types"), F.col("f.us_type_other")).alias("title"),
        F.lit(None).cast("string").alias("text"),
    )
    texts = [
        F.struct(
            F.lit("field").alias("kind"), F.lit(i).alias("ord"),
            F.lit(0).cast("bigint").alias("item_id"), F.lit(title).alias("title"),
            fill_text(F.col(f"f.{field}")).alias("text"),
        )
        for i, (field, title) in enumerate(spec.ULTRASOUND_TITLES.items(), 1)
    ]
    written = us.select("report_id", F.inline(F.array(heading, *texts)))
    pictures = images.join(us.select("report_id").distinct(), "report_id", "left_semi").select(
        "report_id", F.lit("image").alias("kind"), F.col("display_order").alias("ord"),
        F.col("id").alias("item_id"),
        F.coalesce(or_null(F.col("original_name")), F.lit("Ultrasound")).alias("title"),
        image_url(F.col("stored_name")).alias("text"),
    )
    return written.unionByName(pictures)


# -- any JSON ------------------------------------------------------------------------------


def form_values(forms: DataFrame) -> DataFrame:
    """(report_id, form_code, form): every form as the JSON value that it is, also an array, a number, a text or null, of
    any depth, as a variant; unreadable text gives an empty object. Of several rows of one code the newest counts.

    Single values are read by path with variant_get; the text maps of form_map are for printing.
    """
    newest = forms.groupBy("report_id", "form_code").agg(F.max_by("form_json", "id").alias("j"))
    return newest.select(
        "report_id", "form_code", F.coalesce(F.try_parse_json("j"), F.parse_json(F.lit("{}"))).alias("form")
    )


def _json_kind(v: str) -> Column:
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    names = {"VOID": "null", "OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"}
    return F.coalesce(*[F.when(kind == k, n) for k, n in names.items()], F.lit("number"))


def form_leaves(values: DataFrame) -> DataFrame:
    """One row per text, number, truth value, null or empty container inside a form: report_id, form_code, path, kind
    (string, number, boolean, null, object, array), value (JSON text). A path is a row of steps, '.name' or '[place]'; the root's is ''.

    Containers are opened level by level, as deep as any form goes; a level is stored before the next.
    """
    spark = values.sparkSession
    level = values.select("report_id", "form_code", F.lit("").alias("path"), F.col("form").alias("v"))
    leaves, open_kind = None, F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)<.+>$") & ~F.to_json("v").isin("{}", "[]")
    while True:
        place = shared_folder(spark, "form-level")
        # variants are stored as they are
        level.select("*", open_kind.alias("inner")).write.parquet(place)
        level = spark.read.parquet(place)
        done = level.filter("NOT inner").select(
            "report_id", "form_code", "path", _json_kind("v").alias("kind"), F.to_json("v").alias("value")
        )
        leaves = done if leaves is None else leaves.unionByName(done)
        inner = level.filter("inner")
        if inner.isEmpty():
            return leaves
        inner.createOrReplaceTempView("_form_level")
        level = spark.sql("""
            SELECT report_id, form_code, concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.value AS v
            FROM _form_level, LATERAL variant_explode(v) AS e""")
        spark.catalog.dropTempView("_form_level")


# -- saving --------------------------------------------------------------------------------


def split_writes(writes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(writes whose form code fits its column, the others with reject_reason). A code is never cut:
    two long codes with one beginning would become one form."""
    long = F.coalesce(F.length("form_code") > MAX_FORM_CODE, F.lit(False))
    return writes.filter(~long), writes.filter(long).withColumn("reject_reason", F.lit("form_code_too_long"))


def last_writes(writes: DataFrame) -> DataFrame:
    """Last write per report and form; '{}' for a missing body. Over-long codes are left to the
    refused half of split_writes."""
    writes = split_writes(writes)[0]
    ts = F.col("ts") if "ts" in writes.columns else F.lit(None)
    # place of the form inside its payload
    pos = F.col("pos") if "pos" in writes.columns else F.lit(0)
    return (
        writes.filter(or_null(F.col("form_code")).isNotNull())
        .select(
            "report_id", "seq", "form_code",
            F.coalesce(F.col("form_json"), F.lit("{}")).alias("form_json"),
            ts.cast("timestamp_ntz").alias("ts"), F.struct("seq", pos.alias("pos")).alias("_at"),
        )
        .groupBy("report_id", ci(F.col("form_code")).alias("_k"))
        .agg(
            F.max_by(F.struct("form_json", "ts"), "_at").alias("_w"),
            F.min_by("form_code", "_at").alias("form_code"),
            F.min("_at").alias("_at"),
        )
        .select(
            "report_id", "_k", "form_code", "_at.seq", "_at.pos", "_w.form_json", "_w.ts"
        )
    )


def upsert_forms(forms: DataFrame, writes: DataFrame) -> DataFrame:
    """writes(seq, report_id, form_code, form_json[, ts, pos]): insert, or replace the JSON of the
    report's form with the same code. The last write of a key wins."""
    last = last_writes(writes)
    key = ["report_id", "_k"]
    old = forms.withColumn("_k", ci(F.col("form_code")))
    kept = old.join(last.select(*key), key, "left_anti").select(*forms.columns)
    both = last.join(
        old.select(
            *key, F.col("id").alias("_id"), F.col("form_code").alias("_code"),
            F.col("updated_at").alias("_at"),
        ), key, "left"
    )
    updated = both.filter(F.col("_id").isNotNull()).select(
        F.col("_id").alias("id"), "report_id", F.col("_code").alias("form_code"), "form_json",
        F.coalesce(F.col("ts"), F.col("_at")).alias("updated_at"),
    )
    added = _new_form_rows(both.filter(F.col("_id").isNull()), forms)
    return reduce(DataFrame.unionByName, [updated, added], kept)


def _new_form_rows(rows: DataFrame, forms: DataFrame) -> DataFrame:
    return with_new_ids(rows, forms, ["seq", "pos", "report_id", "form_code"]).select(
        "id", "report_id", "form_code", "form_json", F.col("ts").alias("updated_at")
    )


def replace_forms(
    forms: DataFrame, writes: DataFrame, touched: DataFrame | None = None,
    numbered: DataFrame | None = None,
) -> DataFrame:
    """All forms of the touched reports are removed, then the writes are added. `touched`
    (report_id) defaults to the reports written to; naming more of them clears those. New ids go
    on from the largest in `numbered`, by default the forms themselves."""
    touched = writes.select("report_id") if touched is None else touched.select("report_id")
    kept = forms.join(touched.distinct(), "report_id", "left_anti").select(*forms.columns)
    added = _new_form_rows(last_writes(writes), forms if numbered is None else numbered)
    return kept.unionByName(added)
