"""Tables in hash partitions: changes that rewrite only what they touch, read back whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.operators.directory_states import ReportDirectory
from assaybook.session import shared_folder
from assaybook.sources.partitioned import KEYS, delete_partitioned, load_partitioned, save_partitioned, update_partitioned
from assaybook.sources.tables import Tables

from .duck import VIEWS, nz, sql
from .labviews import AS_OF, Lab
from .reads import KEYED, PETS, newest
from .registry import register
from .writes import GOOD, KIND, LAST_LISTS, left, left_sql

LAST_MONTH = """(SELECT o_orderkey FROM orders WHERE date_trunc('month', o_orderdate)
    = (SELECT max(date_trunc('month', o_orderdate)) FROM orders))"""
#: The update bodies of the last month's orders.
RECENT = {**GOOD, "bodies": f"SELECT * FROM ({VIEWS['bodies']}) WHERE seq IN {LAST_MONTH}"}


def _recent(lab: Lab) -> DataFrame:
    orders = lab.raw("orders").select(F.col("o_orderkey").alias("seq"), F.date_trunc("month", "o_orderdate").alias("m"))
    last = orders.agg(F.max("m").alias("m"))
    return lab.payloads.join(orders.join(last, "m").select("seq"), "seq", "left_semi")


def _updated(lab: Lab) -> Tables:
    path = shared_folder(lab.spark, "lab")
    save_partitioned(lab.tables, path, buckets=8)
    update_partitioned(lab.spark, path, _recent(lab), AS_OF)
    return load_partitioned(lab.spark, path)


@register("partitioned_update_reports", sql(f"""
    SELECT r.id, r.report_no, r.created_by, CAST(r.created_at AS VARCHAR) AS created_at,
           CASE WHEN g.rid IS NULL THEN r.patient_name ELSE g.patient_name END AS patient_name,
           CASE WHEN g.rid IS NULL THEN r.pet_name ELSE g.pet_name END AS pet_name,
           CASE WHEN g.rid IS NULL THEN r.species ELSE g.kind END AS species,
           CASE WHEN g.rid IS NULL THEN r.status ELSE g.status END AS status,
           {", ".join(f"CASE WHEN g.rid IS NULL THEN r.{c} ELSE {nz(f'g.{c}')} END AS {c}" for c in ("owner_phone", "breed", "age", "sex", "referring_vet", "clinical_notes", "remarks"))},
           CAST(CASE WHEN g.rid IS NULL THEN r.sample_date ELSE CAST(g.sample_date AS DATE) END AS VARCHAR) AS sample_date,
           CAST(CASE WHEN g.rid IS NULL THEN r.report_date ELSE CAST(g.report_date AS DATE) END AS VARCHAR) AS report_date,
           CASE WHEN g.rid IS NOT NULL THEN '{AS_OF}' END AS updated_at
    FROM lab_reports r LEFT JOIN (
      SELECT *, {KIND} AS kind FROM good QUALIFY row_number() OVER (PARTITION BY rid ORDER BY seq DESC) = 1
    ) g ON g.rid = r.id""", **RECENT))
def _(lab: Lab):
    return _updated(lab)["lab_reports"]


@register("partitioned_update_results", sql("""
    SELECT id, report_id, parameter_id, value, CAST(NULL AS VARCHAR) AS flag, CAST(NULL AS VARCHAR) AS remarks FROM lab_report_results
    WHERE report_id NOT IN (SELECT rid FROM last_lists)
    UNION ALL SELECT (SELECT max(id) FROM lab_report_results) + row_number() OVER (ORDER BY seq, v.pos), rid, v.parameter_id, v.value,
           NULL, result_remarks
    FROM last_lists, LATERAL (VALUES (0, param_a, value_a), (1, param_b, NULL)) v(pos, parameter_id, value)
    WHERE NOT empty_children""", **RECENT, last_lists=LAST_LISTS))
def _(lab: Lab):
    return _updated(lab)["lab_report_results"]


DELETED = f"(SELECT o_orderkey + 1 FROM orders WHERE o_orderkey IN {LAST_MONTH})"


@register("partitioned_deletes", left_sql({
    n: f"{'id' if n == 'lab_reports' else 'coalesce(report_id, -1)'} NOT IN {DELETED}" for n in KEYS
}))
def _(lab: Lab):
    path = shared_folder(lab.spark, "lab")
    save_partitioned(lab.tables, path, buckets=8)
    gone = _recent(lab).select((F.col("seq") + 1).alias("report_id"))
    delete_partitioned(lab.spark, path, gone)
    return left(load_partitioned(lab.spark, path), list(KEYS))


KEPT = KEYED.replace("FROM lab_reports", "FROM lab_reports WHERE status <> 'draft'")


def _grown(lab: Lab) -> ReportDirectory:
    """Reports arrive in three batches, by sex; then all drafts are deleted."""
    out = ReportDirectory(lab.spark, shared_folder(lab.spark, "directory"), buckets=8)
    sex = F.coalesce(F.col("sex"), F.lit(""))
    for name in ("Male", "Female", ""):
        out.add(lab.reports.filter(sex == name), f"add-{name or 'other'}")
    draft = F.col("status") == "draft"
    out.remove(lab.reports.filter(draft), lab.reports.filter(~draft), "drop-drafts")
    return out


@register("owner_directory_grown", sql(f"""
    SELECT owner_key, {newest('patient_name')}, {newest('owner_phone')}, {newest('referring_vet')},
           max(id) AS last_report_id, count(*) AS reports
    FROM {KEPT} GROUP BY owner_key"""))
def _(lab: Lab):
    return _grown(lab).owners()


@register("pet_directory_grown", sql(PETS.replace(KEYED, KEPT)))
def _(lab: Lab):
    return _grown(lab).pets()
