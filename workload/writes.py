"""Validation, creates, updates, deletes, catalog changes, request limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.operators import catalog, checks, drafts, intake
from assaybook.sources import payloads
from assaybook.session import shared_folder, stored
from assaybook.streaming.rates import rate_limit_audit, refusal_stream, refused_calls
from assaybook.streaming.reports import stream_reports, streamed_tables

from .duck import nz, species, sql
from .labviews import AS_OF, RAW, Lab, text
from .registry import register

# -- bodies --------------------------------------------------------------------------------

KIND = f"({species('species')})"
CREATE_REASON = f"""
    CASE WHEN {nz('patient_name')} IS NULL OR {nz('pet_name')} IS NULL THEN 'names_required'
         WHEN {KIND} NOT IN ('Dog', 'Cat') THEN 'species_required'
         WHEN NOT has_children OR empty_children THEN 'panel_required' END"""
UPDATE_REASON = f"""
    CASE WHEN b.report_id = 'x' THEN 'bad_report_id'
         WHEN TRY_CAST(b.report_id AS BIGINT) NOT IN (SELECT id FROM lab_reports)
           THEN 'report_not_found'
         WHEN {KIND} NOT IN ('Dog', 'Cat') THEN 'species_required' END"""
# faults of dates and children, after the rules above
FAULT = """
    CASE WHEN sample_date IS NOT NULL AND TRY_CAST(sample_date AS DATE) IS NULL
           THEN 'bad_date:sample_date'
         WHEN has_children AND NOT empty_children AND panel_a = panel_b THEN 'duplicate_panel'
         WHEN has_children AND NOT empty_children AND param_a = param_b THEN 'duplicate_parameter'
         WHEN has_children AND NOT empty_children
           AND param_b NOT IN (SELECT id FROM lab_test_parameters) THEN 'unknown_parameter' END"""
CHECKED = {
    "create_checked": f"""SELECT *, coalesce({CREATE_REASON}, {FAULT}) AS reject_reason FROM bodies""",
    "update_checked": f"""SELECT b.*, TRY_CAST(b.report_id AS BIGINT) AS rid,
        coalesce({UPDATE_REASON}, {FAULT}) AS reject_reason FROM bodies b""",
}
CHECKED["accepted"] = f"""
    SELECT *, rank() OVER (ORDER BY seq) AS n,
           (SELECT max(id) FROM lab_reports) + row_number() OVER (ORDER BY seq) AS new_id,
           {KIND} AS kind
    FROM create_checked WHERE reject_reason IS NULL"""


@register("validate_create", sql(f"SELECT seq, {CREATE_REASON} AS reject_reason FROM bodies"))
def _(lab: Lab):
    return intake.validate_create(lab.payloads).select("seq", "reject_reason")


@register("validate_update", sql(f"SELECT seq, {UPDATE_REASON} AS reject_reason FROM bodies b"))
def _(lab: Lab):
    return intake.validate_update(lab.payloads, lab.reports).select("seq", "reject_reason")


def _coerced(mode: str) -> str:
    name = "trim({0})" if mode == "create" else "{0}"
    day = "coalesce(report_date, '2026-03-05')" if mode == "create" else "report_date"
    texts = ", ".join(
        f"{nz(c)} AS {c}" for c in
        ("owner_phone", "breed", "age", "sex", "referring_vet", "clinical_notes", "remarks")
    )
    return f"""
    SELECT seq, {name.format('patient_name')} AS patient_name, {name.format('pet_name')} AS pet_name,
           {KIND} AS species, {texts},
           CAST(TRY_CAST(sample_date AS DATE) AS VARCHAR) AS sample_date,
           {day} AS report_date, status
    FROM bodies"""


HEADER = [
    "seq", "patient_name", "pet_name", "species", "owner_phone", "breed", "age", "sex",
    "referring_vet", "clinical_notes", "remarks", "sample_date", "report_date", "status",
]


@register("coerce_payload", sql(_coerced("create")))
def _(lab: Lab):
    return intake.coerce_payload(lab.payloads, "create", AS_OF).select(*HEADER)


@register("coerce_payload_update", sql(_coerced("update")))
def _(lab: Lab):
    return intake.coerce_payload(lab.payloads, "update", AS_OF).select(*HEADER)


@register("image_positions", sql("""
    SELECT seq, v.image_id, CAST(v.pos AS INTEGER) AS display_order
    FROM bodies, LATERAL (VALUES (image_a, 0), (image_b, 1)) v(image_id, pos) WHERE has_images"""))
def _(lab: Lab):
    return intake.image_positions(lab.payloads)


# -- creates -------------------------------------------------------------------------------


def _created(lab: Lab, name: str):
    accepted, _ = intake.accept_creates(lab.tables, lab.payloads, AS_OF, store=stored)
    return intake.created_rows(accepted, AS_OF, 7)[name]


@register("apply_creates_reports", sql(f"""
    SELECT new_id AS id, 'PZ-2026-' || lpad(CAST(n AS VARCHAR),
             CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0') AS report_no,
           trim(patient_name) AS patient_name, trim(pet_name) AS pet_name, kind AS species,
           {nz('owner_phone')} AS owner_phone, CAST(CAST(sample_date AS DATE) AS VARCHAR) AS sample_date,
           coalesce(report_date, '2026-03-05') AS report_date, status, CAST(7 AS BIGINT) AS created_by,
           {", ".join(f"{nz(c)} AS {c}" for c in ("breed", "age", "sex", "referring_vet", "clinical_notes", "remarks"))},
           '{AS_OF}' AS created_at, '{AS_OF}' AS updated_at
    FROM accepted""", **CHECKED))
def _(lab: Lab):
    return _created(lab, "lab_reports")


@register("apply_creates_rejects", sql(
    "SELECT seq, reject_reason FROM create_checked WHERE reject_reason IS NOT NULL", **CHECKED
))
def _(lab: Lab):
    return intake.accept_creates(lab.tables, lab.payloads, AS_OF)[1]


@register("apply_creates_panels", sql("""
    SELECT (SELECT max(id) FROM lab_report_panels) + row_number() OVER (ORDER BY seq, v.pos) AS id,
           new_id AS report_id, v.panel_id
    FROM accepted, LATERAL (VALUES (0, panel_a), (1, panel_b)) v(pos, panel_id)""", **CHECKED))
def _(lab: Lab):
    return _created(lab, "lab_report_panels")


@register("apply_creates_results", sql("""
    SELECT (SELECT max(id) FROM lab_report_results) + row_number() OVER (ORDER BY seq, v.pos) AS id,
           new_id AS report_id, v.parameter_id, v.value, CAST(NULL AS VARCHAR) AS flag,
           result_remarks AS remarks
    FROM accepted, LATERAL (VALUES (0, param_a, value_a), (1, param_b, NULL)) v(pos, parameter_id, value)""",
    **CHECKED))
def _(lab: Lab):
    return _created(lab, "lab_report_results")


@register("apply_creates_forms", sql(f"""
    SELECT (SELECT max(id) FROM lab_report_forms) + row_number() OVER (ORDER BY seq) AS id,
           new_id AS report_id, 'ULTRASOUND' AS form_code, us_json AS form_json,
           '{AS_OF}' AS updated_at FROM accepted""", **CHECKED))
def _(lab: Lab):
    return _created(lab, "lab_report_forms")


LISTED = """SELECT seq, {rid} AS rid, v.pos, v.image_id FROM {bodies},
    LATERAL (VALUES (0, image_a), (1, image_b)) v(pos, image_id) WHERE has_images"""


@register("attach_images_create", sql("""
    SELECT i.id, CASE WHEN i.report_id IS NULL AND c.rid IS NOT NULL THEN c.rid
                      ELSE i.report_id END AS report_id,
           CAST(CASE WHEN i.report_id IS NULL AND c.rid IS NOT NULL THEN c.pos
                     ELSE i.display_order END AS INTEGER) AS display_order
    FROM lab_report_images i LEFT JOIN (
      SELECT * FROM listed QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq, pos DESC) = 1
    ) c ON c.image_id = i.id""", **CHECKED, listed=LISTED.format(rid="new_id", bodies="accepted")))
def _(lab: Lab):
    accepted, _ = intake.accept_creates(lab.tables, lab.payloads, AS_OF, store=stored)
    return intake.attach_images(lab.images, intake.attachments(accepted), "create").select(
        "id", "report_id", "display_order"
    )


# -- updates -------------------------------------------------------------------------------

GOOD = {**CHECKED, "good": "SELECT * FROM update_checked WHERE reject_reason IS NULL"}


def _updated(lab: Lab):
    return intake.apply_updates(lab.tables, lab.payloads, AS_OF, stored)


@register("apply_updates_rejects", sql(
    "SELECT seq, reject_reason FROM update_checked WHERE reject_reason IS NOT NULL", **CHECKED
))
def _(lab: Lab):
    return intake.apply_updates(lab.tables, lab.payloads, AS_OF)[1]


@register("apply_updates_reports", sql(f"""
    SELECT r.id, r.report_no, coalesce(g.patient_name, r.patient_name) AS patient_name,
           CASE WHEN g.rid IS NULL THEN r.species ELSE g.kind END AS species,
           CASE WHEN g.rid IS NULL THEN r.remarks ELSE {nz('g.remarks')} END AS remarks,
           CAST(CASE WHEN g.rid IS NULL THEN r.report_date ELSE CAST(g.report_date AS DATE) END AS VARCHAR)
             AS report_date
    FROM lab_reports r LEFT JOIN (
      SELECT *, {KIND} AS kind FROM good QUALIFY row_number() OVER (PARTITION BY rid ORDER BY seq DESC) = 1
    ) g ON g.rid = r.id""", **GOOD))
def _(lab: Lab):
    return _updated(lab)[0]["lab_reports"].select(
        "id", "report_no", "patient_name", "species", "remarks", "report_date"
    )


LAST_LISTS = """SELECT * FROM good WHERE has_children
    QUALIFY row_number() OVER (PARTITION BY rid ORDER BY seq DESC) = 1"""


@register("apply_updates_panels", sql("""
    SELECT report_id, panel_id FROM lab_report_panels
    WHERE report_id NOT IN (SELECT rid FROM last_lists)
    UNION ALL SELECT rid, v.panel_id FROM last_lists, LATERAL (VALUES (panel_a), (panel_b)) v(panel_id)
    WHERE NOT empty_children""", **GOOD, last_lists=LAST_LISTS))
def _(lab: Lab):
    return _updated(lab)[0]["lab_report_panels"].select("report_id", "panel_id")


@register("apply_updates_results", sql("""
    SELECT report_id, parameter_id, value, CAST(NULL AS VARCHAR) AS remarks FROM lab_report_results
    WHERE report_id NOT IN (SELECT rid FROM last_lists)
    UNION ALL SELECT rid, v.parameter_id, v.value, result_remarks
    FROM last_lists, LATERAL (VALUES (param_a, value_a), (param_b, NULL)) v(parameter_id, value)
    WHERE NOT empty_children""", **GOOD, last_lists=LAST_LISTS))
def _(lab: Lab):
    return _updated(lab)[0]["lab_report_results"].select(
        "report_id", "parameter_id", "value", "remarks"
    )


@register("apply_updates_forms", sql("""
    SELECT report_id, form_code, form_json FROM lab_report_forms
    WHERE report_id NOT IN (SELECT rid FROM last_lists)
    UNION ALL SELECT rid, 'ULTRASOUND', us_json FROM last_lists WHERE NOT empty_children""",
    **GOOD, last_lists=LAST_LISTS))
def _(lab: Lab):
    return _updated(lab)[0]["lab_report_forms"].select("report_id", "form_code", "form_json")


@register("apply_updates_images", sql("""
    SELECT id, CASE WHEN t.last > coalesce(claim_seq, -1) THEN NULL ELSE owner END AS report_id,
           display_order
    FROM (SELECT i.id, coalesce(c.rid, i.report_id) AS owner, c.seq AS claim_seq,
                 CAST(coalesce(c.pos, i.display_order) AS INTEGER) AS display_order
          FROM lab_report_images i LEFT JOIN (
            SELECT * FROM listed
            QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY seq DESC, pos DESC) = 1
          ) c ON c.image_id = i.id) x
    LEFT JOIN (SELECT rid, max(seq) AS last FROM good WHERE has_images GROUP BY rid) t
      ON t.rid = x.owner""", **GOOD, listed=LISTED.format(rid="rid", bodies="good")))
def _(lab: Lab):
    return _updated(lab)[0]["lab_report_images"].select("id", "report_id", "display_order")


# -- drafts --------------------------------------------------------------------------------


@register("included_parameters", sql("""
    SELECT s.report_id, s.parameter_id FROM lab_report_results s
    JOIN lab_reports r ON r.id = s.report_id JOIN lab_test_parameters t ON t.id = s.parameter_id
    WHERE r.status <> 'draft' OR s.value IS NOT NULL OR t.is_active = 0"""))
def _(lab: Lab):
    """Drafts that saved the parameters with a value while the inactive ones were unknown."""
    every = lab.results.join(
        lab.params.select(F.col("id").alias("parameter_id"), "is_active"), "parameter_id"
    ).withColumnRenamed("report_id", "draft_id")
    restricted = lab.reports.filter(F.col("status") == "draft").select(F.col("id").alias("draft_id"))
    return drafts.included_parameter_rows(
        every, every.filter(F.col("value").isNotNull()), every.filter(F.col("is_active") == 1),
        restricted,
    ).withColumnRenamed("draft_id", "report_id")


# -- catalog changes -----------------------------------------------------------------------


@register("code_conflicts", sql("""
    SELECT seq, code FROM (
      SELECT p_partkey AS seq, upper(p_name) AS code, row_number() OVER (
        PARTITION BY upper(p_name) ORDER BY p_partkey) AS rn FROM part)
    WHERE rn = 1 AND code NOT IN (SELECT upper(p_type) || ' RING' FROM part)"""))
def _(lab: Lab):
    part = lab.raw("part")
    new = part.select(F.col("p_partkey").alias("seq"), F.upper("p_name").alias("code"))
    old = part.select(F.concat("p_type", F.lit(" ring")).alias("code"))
    return checks.code_conflicts(new, old, ["code"])[0]


@register("create_parameters", sql("""
    SELECT (SELECT max(id) FROM lab_test_parameters) + row_number() OVER (ORDER BY p_partkey) AS id,
           panel_id, code, p_name AS name, reference_range_dog, reference_range_dog AS reference_range,
           CAST(p_size AS INTEGER) AS display_order, 1 AS is_active
    FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, code ORDER BY p_partkey) AS rn
          FROM (SELECT *, p_partkey % 30 + 1 AS panel_id, 'N_' || (p_partkey % 977) AS code,
                  nullif(p_type, 'SMALL') AS reference_range_dog FROM part))
    WHERE rn = 1 AND panel_id IN (SELECT id FROM lab_test_panels)"""))
def _(lab: Lab):
    k = F.col("p_partkey")
    changes = lab.raw("part").select(
        k.alias("seq"), (k % 30 + 1).alias("panel_id"),
        F.concat(F.lit(" n-"), text(k % 977), F.lit(" ")).alias("code"),
        F.col("p_name").alias("name"), F.lit("").alias("unit"),
        F.when(F.col("p_type") == "SMALL", " ").otherwise(F.col("p_type")).alias("reference_range_dog"),
        F.lit(None).cast("string").alias("reference_range_cat"),
        text(F.col("p_size")).alias("display_order"),
    )
    following, _ = catalog.create_parameters(lab.params, lab.panels, changes)
    return following.join(lab.params.select("id"), "id", "left_anti").select(
        "id", "panel_id", "code", "name", "reference_range_dog", "reference_range", "display_order",
        "is_active",
    )


@register("create_panels", sql("""
    SELECT code, name, display_order, is_active FROM lab_test_panels
    UNION ALL SELECT code, name, 0, 1 FROM (
      SELECT upper(p_type) AS code, arg_min(p_name, p_partkey) AS name FROM part GROUP BY 1)"""))
def _(lab: Lab):
    changes = lab.raw("part").select(
        F.col("p_partkey").alias("seq"), F.lower("p_type").alias("code"),
        F.col("p_name").alias("name"), F.lit(None).cast("string").alias("description"),
        F.lit("x").alias("display_order"),
    )
    return catalog.create_panels(lab.panels, changes)[0].select(
        "code", "name", "display_order", "is_active"
    )


@register("patch_parameters", sql(f"""
    SELECT id, CASE WHEN k % 3 = 0 AND k % 7 <> 0 THEN 'new ' || k ELSE name END AS name,
           CASE WHEN k % 2 = 0 AND k % 7 <> 0 THEN NULL ELSE unit END AS unit,
           CASE WHEN k % 5 = 0 AND k % 7 <> 0 THEN '1 - ' || k ELSE reference_range_dog END AS dog,
           CASE WHEN k % 7 = 0 THEN reference_range
                WHEN k % 5 = 0 THEN '1 - ' || k ELSE reference_range_dog END AS legacy,
           CAST(CASE WHEN k % 7 <> 0 AND k % 2 = 1 THEN -3 ELSE display_order END AS INTEGER) AS display_order
    FROM (SELECT *, id - 1 AS k FROM lab_test_parameters)"""))
def _(lab: Lab):
    k = F.col("p_partkey")
    every = F.create_map(
        F.lit("name"), F.when(k % 7 == 0, " ").when(k % 3 == 0, F.concat(F.lit(" new "), text(k))),
        F.lit("unit"), F.when(k % 2 == 0, " ").otherwise(F.lit(None)),
        F.lit("reference_range_dog"), F.concat(F.lit("1 - "), text(k)),
        F.lit("display_order"), F.when(k % 2 == 1, "-3.9").otherwise("none"),
    )
    supplied = F.map_filter(every, lambda name, _: (
        ((name == "name") & ((k % 7 == 0) | (k % 3 == 0)))
        | ((name == "unit") & (k % 2 == 0))
        | ((name == "reference_range_dog") & (k % 5 == 0))
        | (name == "display_order")
    ))
    changes = lab.raw("part").select(k.alias("seq"), (k + 1).alias("id"), supplied.alias("fields"))
    return catalog.patch_parameters(lab.params, changes)[0].select(
        "id", "name", "unit", F.col("reference_range_dog").alias("dog"),
        F.col("reference_range").alias("legacy"), "display_order",
    )


@register("patch_panels", sql("""
    SELECT id, code, 'N' || x.last AS name, CAST(NULL AS VARCHAR) AS description,
           CAST(x.last % 10 AS INTEGER) AS display_order, CAST(x.last % 2 AS INTEGER) AS is_active
    FROM lab_test_panels p JOIN (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS pid,
      max(p_partkey) AS last FROM part GROUP BY 1) x ON x.pid = p.id"""))
def _(lab: Lab):
    k = F.col("p_partkey")
    changes = lab.raw("part").select(
        k.alias("seq"), F.substring("p_brand", 7, 10).cast("bigint").alias("id"),
        F.create_map(
            F.lit("name"), F.concat(F.lit("N"), text(k)), F.lit("description"), F.lit("  "),
            F.lit("display_order"), text(k % 10), F.lit("is_active"), text(k % 2),
        ).alias("fields"),
    )
    return catalog.patch_panels(lab.panels, changes)[0].select(
        "id", "code", "name", "description", "display_order", "is_active"
    )


@register("set_active", sql("""
    SELECT id, CAST(CASE WHEN s.last IS NULL THEN is_active ELSE s.last END AS INTEGER) AS is_active
    FROM lab_test_parameters t LEFT JOIN (
      SELECT l_partkey + 1 AS pid, arg_max(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END,
               l_orderkey * 100 + l_linenumber) AS last
      FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag
            FROM lineitem GROUP BY 1, 2, 3) GROUP BY 1) s ON s.pid = t.id"""))
def _(lab: Lab):
    lines = lab.raw("lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag")
    )
    changes = lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_partkey") + 1).alias("id"),
        F.when(F.col("flag") == "R", 0).otherwise(1).alias("is_active"),
    )
    return catalog.set_active(lab.params, changes).select("id", "is_active")


@register("upsert_panels", sql("""
    SELECT coalesce(p.code, x.code) AS code, coalesce(x.name, p.name) AS name,
           coalesce(x.display_order, p.display_order) AS display_order,
           CASE WHEN x.code IS NOT NULL THEN 1 ELSE p.is_active END AS is_active
    FROM lab_test_panels p FULL JOIN (
      SELECT CASE WHEN CAST(substr(p_brand, 7) AS BIGINT) % 2 = 0 THEN 'panel_' ELSE 'NEW_' END
               || substr(p_brand, 7) AS code, min(p_name) AS name, CAST(count(*) AS INTEGER) AS display_order
      FROM part GROUP BY 1) x ON upper(x.code) = p.code"""))
def _(lab: Lab):
    n = F.substring("p_brand", 7, 10)
    prefix = F.when(n.cast("bigint") % 2 == 0, "panel_").otherwise("NEW_")
    rows = lab.raw("part").groupBy(F.concat(prefix, n).alias("code")).agg(
        F.min("p_name").alias("name"), F.lit(None).cast("string").alias("description"),
        F.count(F.lit(1)).cast("int").alias("display_order"),
    )
    following = catalog.upsert_panels(lab.panels, rows, ["name", "display_order"], True)
    return following.select("code", "name", "display_order", "is_active")


@register("retire_parameters", sql("""
    SELECT t.id, CASE WHEN p.code = 'SKIN_SCRAPING' THEN 0 ELSE t.is_active END AS is_active
    FROM lab_test_parameters t LEFT JOIN lab_test_panels p ON p.id = t.panel_id"""))
def _(lab: Lab):
    return catalog.retire_parameters(lab.params, lab.panels, "skin_scraping ").select(
        "id", "is_active"
    )


LITERALS = """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'CBC' WHEN p_partkey % 2 = 1 AND p_partkey % 3 = 0
    THEN 'NOPE' ELSE 'LFT' END AS panel_code, 'P' || p_partkey AS code, p_name, p_size FROM part"""


@register("seed_parameters", sql("""
    SELECT p.id AS panel_id, l.code, l.p_name AS name, l.p_size AS display_order
    FROM literals l JOIN lab_test_panels p ON p.code = l.panel_code
    WHERE NOT EXISTS (SELECT 1 FROM lab_test_parameters t
                      WHERE t.panel_id = p.id AND t.code = l.code)""", literals=LITERALS))
def _(lab: Lab):
    k = F.col("p_partkey")
    literals = lab.raw("part").select(
        F.when(k % 2 == 0, "CBC").when(k % 3 == 0, "NOPE").otherwise("LFT").alias("panel_code"),
        F.concat(F.lit("P"), text(k)).alias("code"), F.col("p_name").alias("name"),
        F.lit("").alias("unit"), F.lit("1 - 2").alias("reference_range_dog"),
        F.lit("1 - 3").alias("reference_range_cat"), F.col("p_size").alias("display_order"),
    )
    following = catalog.seed_parameters(lab.params, lab.panels, literals)
    return following.join(lab.params.select("id"), "id", "left_anti").select(
        "panel_id", "code", "name", "display_order"
    )


@register("backfill_ranges", sql(f"""
    SELECT id, dog, cat, coalesce(dog, reference_range) AS legacy
    FROM (SELECT t.id, t.reference_range, CASE WHEN p.code IN ('CBC', 'LFT') AND t.id % 2 = 0
                   THEN '1 - ' || t.id ELSE coalesce({nz('t.reference_range_dog')},
                     t.reference_range, t.reference_range_dog) END AS dog,
                 CASE WHEN p.code IN ('CBC', 'LFT') AND t.id % 2 = 0
                   THEN '2 - ' || t.id ELSE t.reference_range_cat END AS cat
          FROM lab_test_parameters t JOIN lab_test_panels p ON p.id = t.panel_id)"""))
def _(lab: Lab):
    n = text(F.col("id"))
    changes = lab.params.filter(F.col("id") % 2 == 0).join(
        lab.panels.filter(F.col("code").isin("CBC", "LFT")).select(
            F.col("id").alias("panel_id"), F.col("code").alias("panel_code")
        ), "panel_id"
    ).select(
        "panel_code", "code", F.concat(F.lit("1 - "), n).alias("dog"),
        F.concat(F.lit("2 - "), n).alias("cat"),
    )
    return catalog.backfill_ranges(lab.params, lab.panels, changes).select(
        "id", F.col("reference_range_dog").alias("dog"), F.col("reference_range_cat").alias("cat"),
        F.col("reference_range").alias("legacy"),
    )


# -- deletes -------------------------------------------------------------------------------


def left_sql(kept: dict[str, str]) -> str:
    return sql(" UNION ALL ".join(
        f"SELECT '{t}' AS table_name, id FROM {t} WHERE {where}" for t, where in kept.items()
    ))


def left(tables, names: list[str]) -> DataFrame:
    """Every row that is left, by table and id."""
    return reduce(DataFrame.unionByName, [
        tables[t].select(F.lit(t).alias("table_name"), "id") for t in names
    ])


DRAFT_IDS = "(SELECT id FROM lab_reports WHERE status = 'draft')"


@register("delete_reports", left_sql({
    "lab_reports": "status <> 'draft'", "lab_report_panels": f"report_id NOT IN {DRAFT_IDS}",
    "lab_report_results": f"report_id NOT IN {DRAFT_IDS}",
    "lab_report_images": f"report_id IS NULL OR report_id NOT IN {DRAFT_IDS}",
    "lab_report_forms": f"report_id NOT IN {DRAFT_IDS}",
}))
def _(lab: Lab):
    ids = lab.reports.filter(F.col("status") == "draft").select(F.col("id").alias("report_id"))
    return left(intake.delete_reports(lab.tables, ids), [
        "lab_reports", "lab_report_panels", "lab_report_results", "lab_report_images",
        "lab_report_forms",
    ])


OFF = "(SELECT id FROM lab_test_panels WHERE is_active = 0)"


@register("delete_panels_cascade", left_sql({
    "lab_test_panels": "is_active = 1", "lab_test_parameters": f"panel_id NOT IN {OFF}",
    "lab_report_panels": f"panel_id NOT IN {OFF}",
    "lab_report_results":
        f"parameter_id NOT IN (SELECT id FROM lab_test_parameters WHERE panel_id IN {OFF})",
}))
def _(lab: Lab):
    ids = lab.panels.filter(F.col("is_active") == 0).select(F.col("id").alias("panel_id"))
    return left(intake.delete_panels_cascade(lab.tables, ids), [
        "lab_test_panels", "lab_test_parameters", "lab_report_panels", "lab_report_results",
    ])


@register("null_deleted_users", sql("""
    SELECT 'report' AS kind, id, CASE WHEN created_by IN (SELECT id FROM lab_users WHERE is_active = 0)
             THEN NULL ELSE created_by END AS created_by FROM lab_reports
    UNION ALL SELECT 'image', id, CASE WHEN created_by IN (SELECT id FROM lab_users WHERE is_active = 0)
             THEN NULL ELSE created_by END FROM lab_report_images"""))
def _(lab: Lab):
    ids = lab.users.filter(F.col("is_active") == 0).select(F.col("id").alias("user_id"))
    out = intake.null_deleted_users(lab.tables, ids)
    return out["lab_reports"].select(F.lit("report").alias("kind"), "id", "created_by").unionByName(
        out["lab_report_images"].select(F.lit("image").alias("kind"), "id", "created_by")
    )


@register("delete_images", sql("""
    SELECT id, stored_name FROM lab_report_images WHERE id - 1 NOT IN (SELECT doc_id FROM labels)"""))
def _(lab: Lab):
    ids = lab.raw("labels").select((F.col("doc_id") + 1).alias("image_id"))
    return intake.delete_images(lab.images, ids).select("id", "stored_name")


# -- request limits ------------------------------------------------------------------------


def _calls(lab: Lab) -> DataFrame:
    return lab.raw("events").select(
        F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("id")
    )


@register("rate_limit_audit", """
    SELECT user_id AS client, CAST(ts AS VARCHAR) AS at, event_id AS id,
           CAST(date_trunc('minute', ts) AS VARCHAR) AS window_start
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) > 1""")
def _(lab: Lab):
    return rate_limit_audit(_calls(lab), limit=1)


@register("rate_limit_refusals", """
    SELECT user_id AS client, CAST(ts AS VARCHAR) AS at, event_id AS id,
           CAST(time_bucket(INTERVAL 6 HOURS, ts) AS VARCHAR) AS window_start
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 6 HOURS, ts) ORDER BY ts, event_id) > 1""")
def _(lab: Lab):
    """The events as a stream, all windows settled at its end."""
    place, window = shared_folder(lab.spark, "refusals"), "6 hours"
    # a pattern: the file stream reads a table of one file or of many
    events = lab.spark.readStream.schema(RAW["events"]).parquet(f"{lab.dir}/events.parque[t]")
    calls = events.select(F.col("user_id").alias("client"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    refusal_stream(calls, 1, place, window).awaitTermination()
    return refused_calls(lab.spark, place, 1, window, settle=True)


@register("rate_limit_audit_first_call", """
    WITH RECURSIVE c AS (
      SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w AS (
      SELECT user_id, ts, event_id, n, ts AS start, 1 AS k FROM c WHERE n = 1
      UNION ALL
      SELECT c.user_id, c.ts, c.event_id, c.n, CASE WHEN c.ts >= w.start + to_hours(12) THEN c.ts ELSE w.start END,
             CASE WHEN c.ts >= w.start + to_hours(12) THEN 1 ELSE w.k + 1 END
      FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1)
    SELECT user_id AS client, CAST(ts AS VARCHAR) AS at, event_id AS id, CAST(start AS VARCHAR) AS window_start FROM w WHERE k > 1""")
def _(lab: Lab):
    """Windows of half a day, so that the clients' calls make long runs of them."""
    return rate_limit_audit(_calls(lab), limit=1, window="12 hours", windows="first_call")


@register("stream_reports", """
    SELECT 'Owner ' || o_orderkey AS patient_name, 'Dog' AS species, o_orderkey % 25 + 1 AS panel_id, o_orderkey % 100 + 1 AS parameter_id,
           CAST(o_orderkey % 60 AS VARCHAR) AS value, '{"findings":"n' || o_orderkey || '"}' AS form_json
    FROM orders WHERE o_orderkey % 9 <> 0""")
def _(lab: Lab):
    """A body of every order as files of lines, those of urgent ones sent twice; saved by the stream in several
    batches."""
    k = F.col("o_orderkey")
    body = F.to_json(F.struct(
        F.concat(F.lit("Owner "), text(k)).alias("patient_name"), F.lit("Rex").alias("pet_name"),
        F.when(k % 9 == 0, "bird").otherwise("canine").alias("species"), F.array(k % 25 + 1).alias("panel_ids"),
        F.array(F.struct((k % 100 + 1).alias("parameter_id"), (k % 60).alias("value"))).alias("results"),
        F.struct(F.struct(F.concat(F.lit("n"), text(k)).alias("findings")).alias("ULTRASOUND")).alias("forms"),
    ))
    place = shared_folder(lab.spark, "stream")
    orders = lab.raw("orders").select(body.alias("value"), "o_orderpriority")
    orders.select("value").write.text(f"{place}/in")
    orders.filter(F.col("o_orderpriority") == "1-URGENT").select("value").write.mode("append").text(f"{place}/in")
    stream_reports(
        lab.spark, f"{place}/in", f"{place}/out", {n: lab.tables[n] for n in ("lab_test_panels", "lab_test_parameters")}, 7,
        clock=lambda: AS_OF, max_files=6, once_within="1 hour",
    ).awaitTermination()
    saved = streamed_tables(lab.spark, f"{place}/out")
    children = {n: saved[n].drop("id", "batch") for n in ("lab_report_panels", "lab_report_results", "lab_report_forms")}
    out = saved["lab_reports"].select(F.col("id").alias("report_id"), "patient_name", "species")
    for df in children.values():
        out = out.join(df.drop("remarks", "flag", "updated_at", "form_code"), "report_id")
    return out.drop("report_id")


# -- operators on bodies and drafts ----------------------------------------------------------


def _lines(lab: Lab) -> DataFrame:
    """A JSON body of every order; some are no JSON, some no object."""
    k = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"patient_name": "'), F.coalesce("o_orderpriority", F.lit("")), F.lit('", "pet_name": "Rex", "species": "dog", "panel_ids": ['),
        k.cast("string"), F.lit(', "2"], "results": [{"parameter_id": '), k.cast("string"), F.lit(', "value": 5.5}]}'),
    )
    body = F.when(k % 7 == 0, F.lit("{bad")).when(k % 7 == 1, F.lit("[]")).otherwise(text)
    return lab.raw("orders").select(body.alias("value"))


@register("parse_payloads", """
    SELECT CASE WHEN bad THEN NULL ELSE o_orderpriority END AS patient_name,
           CASE WHEN bad THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || ',2' END AS panels,
           CASE WHEN bad THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || '=5.5' END AS result,
           CASE WHEN bad THEN 'bad_json' END AS reject_reason,
           CASE WHEN o_orderkey % 7 = 0 THEN '{bad' WHEN o_orderkey % 7 = 1 THEN '[]' END AS raw_body
    FROM (SELECT *, o_orderkey % 7 <= 1 AS bad FROM orders)""")
def _(lab: Lab):
    bodies = payloads.parse_payloads(_lines(lab))
    good = F.col("reject_reason").isNull()
    first = F.try_element_at("results", F.lit(1))
    return bodies.select(
        F.when(good, F.col("patient_name")).alias("patient_name"),
        F.when(good, F.concat_ws(",", "panel_ids")).alias("panels"),
        F.when(good, F.concat(first["parameter_id"], F.lit("="), first["value"])).alias("result"),
        "reject_reason", "raw_body",
    )


@register("draft_stage", """
    SELECT o_orderkey AS draft_id, CASE WHEN o_orderkey % 5 IN (0, 1) OR o_orderkey % 4 = 0 THEN 'patient'
             WHEN o_orderkey % 3 = 0 THEN 'tests' ELSE 'results' END AS stage FROM orders""")
def _(lab: Lab):
    k = F.col("o_orderkey")
    rows = lab.raw("orders").select(
        k.alias("draft_id"), F.when(k % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("patient_name"),
        F.when(k % 5 != 1, "Rex").alias("pet_name"), F.when(k % 4 == 0, "fish").otherwise(" CAT ").alias("species"),
        F.when(k % 3 == 0, F.array(F.lit("0"), F.lit("x"))).otherwise(F.array(F.lit("7"))).alias("panel_ids"),
    )
    return drafts.draft_stage(rows).select("draft_id", "stage")


@register("draft_payload_results", """
    SELECT o_orderkey AS draft_id, parameter_id, CASE WHEN parameter_id = o_orderkey + 1 THEN 'v' ELSE '' END AS value
    FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey + 1, o_orderkey + 9] ELSE [o_orderkey + 1] END) AS parameter_id
          FROM orders)""")
def _(lab: Lab):
    k = F.col("o_orderkey")
    listed = F.array((k + 1).cast("string"), (k + 9).cast("string"))
    rows = lab.raw("orders").select(
        k.alias("draft_id"), F.when(k % 2 == 0, listed).alias("included_parameter_ids"),
        F.create_map((k + 1).cast("string"), F.lit("v")).alias("results"),
    )
    return drafts.draft_payload_results(rows).select("draft_id", F.inline("payload_results")).select(
        "draft_id", "parameter_id", "value"
    )


@register("seed_if_empty", """
    SELECT s_suppkey + 1 AS id, s_name AS name, 'old' AS origin FROM supplier
    UNION ALL SELECT s_suppkey + 1, s_name, 'new' FROM supplier""")
def _(lab: Lab):
    rows = lab.raw("supplier").select((F.col("s_suppkey") + 1).alias("id"), F.col("s_name").alias("name"))
    old, new = rows.withColumn("origin", F.lit("old")), rows.withColumn("origin", F.lit("new"))
    # one table that has rows already, one that has none
    return catalog.seed_if_empty(old, new).unionByName(catalog.seed_if_empty(old.filter(F.lit(False)), new))


@register("evolve_schema", sql("""
    SELECT id, panel_id, code, name, unit, CAST(NULL AS VARCHAR) AS reference_range_dog,
           CAST(NULL AS VARCHAR) AS reference_range_cat, reference_range, display_order, is_active
    FROM lab_test_parameters"""))
def _(lab: Lab):
    return catalog.evolve_schema(lab.params.drop("reference_range_dog", "reference_range_cat"))
