"""Checklist forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaybook import form_specs as spec
from assaybook.operators import forms

from .duck import nz, sql
from .labviews import AS_OF, Lab
from .registry import register


def _labels_sql() -> str:
    rows = []
    for form in spec.FORM_PANELS:
        ticks = [(g, other, c, t) for g, (other, labels) in spec.TICKS.get(form, {}).items()
                 for c, t in labels.items()]
        for g, (other, owner, labels) in spec.CHOICES.get(form, {}).items():
            ticks += [(g, other if c == owner else None, c, t) for c, t in labels.items()]
        for i, (g, other, c, t) in enumerate(ticks, 1):
            free = f"'{other}'" if other and c in ("other", "positive") else "NULL"
            rows.append(f"('{form}', '{g}', '{c}', '{t}', {i}, {free})")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") v(form_code, field, code, label, ord, free)"


@register("form_findings", sql(f"""
    SELECT f.report_id, f.form_code, l.field, l.code, l.label, CAST(l.ord AS INTEGER) AS ord,
           CASE WHEN l.free IS NOT NULL THEN CASE f.form_code WHEN 'SKIN_SCRAPING'
             THEN {nz("json_extract_string(f.j, '$.' || l.free)")}
             ELSE {nz("trim(json_extract_string(f.j, '$.' || l.free))")} END END AS free_text
    FROM (SELECT report_id, form_code, CAST(form_json AS JSON) AS j FROM lab_report_forms
          WHERE json_valid(form_json)) f
    JOIN labels_fixed l ON l.form_code = f.form_code
    WHERE (json_type(f.j, '$.' || l.field) = 'ARRAY'
           AND list_contains(CAST(json_extract(f.j, '$.' || l.field) AS VARCHAR[]), l.code)
           AND NOT (f.form_code = 'SKIN_SCRAPING' AND l.field = 'result'))
       OR (f.form_code = 'SKIN_SCRAPING' AND l.field = 'result'
           AND json_extract_string(f.j, '$.result') = l.code)""", labels_fixed=_labels_sql()))
def _(lab: Lab):
    return forms.form_findings(lab.forms)


FIELDS = {
    "SKIN_SCRAPING": ("sample_site", "other_findings", "interpretation", "recommendations"),
    "ULTRASOUND": ("clinical_history", "findings", "impression", "recommendations"),
    "BLOOD_PARASITE": ("comments", "examined_by"),
}
FIELD_ROWS = ", ".join(
    f"('{form}', {i}, '{f}')" for form, fs in FIELDS.items() for i, f in enumerate(fs, 1)
)


@register("form_fields", sql(f"""
    SELECT f.report_id, f.form_code, CAST(v.ord AS INTEGER) AS ord, v.field,
           {nz('''CASE WHEN f.form_code = 'SKIN_SCRAPING' THEN x ELSE trim(x) END''')} AS value
    FROM (SELECT f.report_id, f.form_code, v.ord, v.field,
            CASE WHEN json_exists(f.j, '$.' || v.field) THEN json_extract_string(f.j, '$.' || v.field)
                 WHEN v.field = 'examined_by' THEN coalesce(r.referring_vet, '') ELSE '' END AS x
          FROM (SELECT report_id, form_code, CASE WHEN json_valid(form_json)
                  THEN CAST(form_json AS JSON) ELSE CAST('{{}}' AS JSON) END AS j
                FROM lab_report_forms) f
          JOIN lab_reports r ON r.id = f.report_id
          JOIN (VALUES {FIELD_ROWS}) v(form_code, ord, field) ON v.form_code = f.form_code) f
    JOIN (VALUES {FIELD_ROWS}) v(form_code, ord, field)
      ON v.form_code = f.form_code AND v.field = f.field"""))
def _(lab: Lab):
    return forms.form_fields(lab.forms, lab.reports, AS_OF)


CONSENT = ", ".join(
    f"({i}, '{f}', {s})" for i, (f, s) in enumerate([
        ("owner_name", "patient_name"), ("contact", "owner_phone"), ("animal_name", "pet_name"),
        ("species", "species"), ("breed", "breed"), ("sex", "sex"), ("age", "age"),
        ("date_of_surgery", "CAST(report_date AS VARCHAR)"), ("vet_name", "referring_vet"),
    ])
)


@register("form_fields_selected", sql(f"""
    SELECT r.id AS report_id, v.field, {nz('trim(v.value)')} AS value
    FROM lab_reports r JOIN lab_report_panels rp ON rp.report_id = r.id AND rp.panel_id = 5,
    LATERAL (VALUES {CONSENT}) v(i, field, value)"""))
def _(lab: Lab):
    """Prefilled consent forms of every report that selects one, though none is saved."""
    selected = forms.selected_forms(lab.report_panels, lab.panels)
    rows = forms.form_fields(lab.forms, lab.reports, AS_OF, selected)
    prefilled = [*spec.PREFILL["SURGICAL_CONSENT"]]
    shown = [f for f in prefilled if f not in ("vet_date", "owner_sign_date")]
    return rows.filter(
        (F.col("form_code") == "SURGICAL_CONSENT") & F.col("field").isin(*shown)
    ).select("report_id", "field", "value")


@register("ultrasound_sections", sql(f"""
    WITH_US
    SELECT report_id, 'heading' AS kind, 0 AS ord, CAST(0 AS BIGINT) AS item_id,
           CASE WHEN j IS NULL THEN 'Ultrasound' ELSE 'Ultrasound - Urinary Tract / Other: '
             || trim(json_extract_string(j, '$.us_type_other')) END AS title,
           CAST(NULL AS VARCHAR) AS text FROM us
    UNION ALL
    SELECT report_id, 'field', v.i, 0, v.title,
           {nz("trim(json_extract_string(j, '$.' || v.field))")}
    FROM us, (VALUES (1, 'clinical_history', 'Clinical History / Indication'),
              (2, 'findings', 'Ultrasound Findings'), (3, 'impression', 'Results / Impression'),
              (4, 'recommendations', 'Recommendations')) v(i, field, title)
    UNION ALL
    SELECT report_id, 'image', display_order, id, coalesce(original_name, 'Ultrasound'),
           '/api/uploads/file/' || stored_name
    FROM lab_report_images WHERE report_id IN (SELECT report_id FROM us)""".replace("WITH_US", ""),
    us="""SELECT report_id, CASE WHEN json_valid(form_json) THEN CAST(form_json AS JSON) END AS j
          FROM lab_report_forms WHERE form_code = 'ULTRASOUND'"""))
def _(lab: Lab):
    return forms.ultrasound_sections(lab.forms, lab.images)


LAST = """SELECT report_id, form_code, arg_max(form_json, seq) AS form_json, max(ts) AS ts
          FROM {} GROUP BY 1, 2"""


@register("upsert_forms", sql("""
    SELECT report_id, form_code, form_json, CAST(ts AS VARCHAR) AS updated_at
    FROM (SELECT * FROM last_new UNION ALL SELECT * FROM last_old o WHERE NOT EXISTS (
      SELECT 1 FROM last_new n WHERE n.report_id = o.report_id AND n.form_code = o.form_code))""",
    last_old=LAST.format("(SELECT * FROM form_writes WHERE event_type IN ('view', 'click'))"),
    last_new=LAST.format("(SELECT * FROM form_writes WHERE event_type IN ('error', 'signup'))")))
def _(lab: Lab):
    old, new = _old_and_new(lab)
    return forms.upsert_forms(old, new).select("report_id", "form_code", "form_json", "updated_at")


@register("replace_forms", sql("""
    SELECT report_id, form_code, form_json
    FROM (SELECT * FROM last_new UNION ALL SELECT * FROM last_old
          WHERE report_id NOT IN (SELECT report_id FROM last_new))""",
    last_old=LAST.format("form_writes"),
    last_new=LAST.format("(SELECT * FROM form_writes WHERE event_type = 'error')")))
def _(lab: Lab):
    writes = lab.form_writes.filter(F.col("event_type") == "error")
    return forms.replace_forms(lab.forms, writes).select("report_id", "form_code", "form_json")


def _old_and_new(lab: Lab):
    kind = F.col("event_type")
    old = lab.form_writes.filter(kind.isin("view", "click"))
    new = lab.form_writes.filter(kind.isin("error", "signup"))
    base = forms.upsert_forms(lab.forms.limit(0), old)
    return base, new
