"""Reads: tables, lists, joins, bundles, directory, printed output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaybook.functions import (
    clean_code, date_only, digits_only, display_value, escape_html, image_url, is_numeric_id,
    outside, is_phone_query, normalize_species, owner_key, parse_range, parse_result,
    pet_key, pet_label, reference_for, report_date_parts, to_active, to_order,
)
from assaybook.operators import bundles, catalog, checks, details, directory, forms, lists, numbering, searches
from assaybook.plans import print as printed
from assaybook.schemas import MAX_UPLOAD_BYTES
from assaybook.session import shared_folder
from assaybook.sources import image_files, images
from assaybook.sources.tables import load_tables
from assaybook.sources.writer import save_snapshot

from .duck import (
    DOC_CODES, FORM_CODES, first_text, high, low, nz, number, out_of_range, owner_key as duck_owner_key,
    pet_key as duck_pet_key, reference, species, sql,
)
from .labviews import AS_OF, Lab, pick, text
from .registry import register

# -- flagship ------------------------------------------------------------------------------

REF = reference("r.species", "t.")

LINES = f"""
    SELECT s.report_id, s.panel_id, p.code AS panel_code,
           {first_text('p.name', 'p.code', default='')} AS panel_name,
           p.display_order AS panel_order, s.id AS result_id, s.parameter_id,
           t.name AS parameter_name, t.display_order AS parameter_order,
           {first_text('trim(s.value)', default=' - ')} AS display_value,
           {first_text('t.unit', default=' - ')} AS unit,
           coalesce({nz(REF)}, ' - ') AS reference,
           {out_of_range('s.value', REF)} AS result_out
    FROM lab_reports r
    JOIN lab_report_panels rp ON rp.report_id = r.id
    JOIN lab_test_panels p ON p.id = rp.panel_id
    JOIN (SELECT x.*, y.panel_id FROM lab_report_results x
          JOIN lab_test_parameters y ON y.id = x.parameter_id) s
      ON s.report_id = r.id AND s.panel_id = p.id
    JOIN lab_test_parameters t ON t.id = s.parameter_id
    WHERE upper(p.code) NOT IN ({FORM_CODES})"""


@register("report_lines", sql(LINES))
def _(lab: Lab):
    return printed.report_lines(lab.tables)


DRAFT_REF = "coalesce(nullif(CASE WHEN lower(trim(d.species)) IN ('cat', 'feline') THEN c.parameter_reference_range_cat ELSE c.parameter_reference_range_dog END, ''), ' - ')"


def draft_rows(lab: Lab) -> DataFrame:
    """An unsaved draft of every customer: two panels; no list of included parameters, one of them, or one with a snapshot."""
    k = c = F.col("c_custkey")
    return lab.raw("customer").select(
        k.alias("draft_id"), F.when(c % 2 == 0, "Feline ").otherwise("dog").alias("species"),
        F.array(text(k % 25 + 1), text(k * 7 % 25 + 1), F.lit("x")).alias("panel_ids"),
        F.when(k % 3 != 0, F.array(text(c % 100 + 1))).alias("included_parameter_ids"),
        F.when(k % 3 == 2, F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: i.cast("string"))).alias("parameter_ids_snapshot"),
        F.create_map(text(c % 100 + 1), F.concat(text(k % 60), F.lit(" H"))).alias("results"),
    )


@register("preview_lines", sql(f"""
    SELECT d.draft_id, c.panel_id, c.code AS panel_code, {first_text('c.name', 'c.code', default='')} AS panel_name, c.display_order AS panel_order,
           c.parameter_id, c.parameter_name, c.parameter_display_order AS parameter_order,
           CASE WHEN c.parameter_id = d.own THEN d.value ELSE ' - ' END AS display_value, {first_text('c.parameter_unit', default=' - ')} AS unit,
           {DRAFT_REF} AS reference, CASE WHEN c.parameter_id = d.own THEN {out_of_range('d.value', DRAFT_REF)} ELSE false END AS result_out
    FROM (SELECT DISTINCT draft_id, species, mode, own, value, unnest([a, b]) AS panel_id FROM drafted) d
    JOIN active_rows c ON c.panel_id = d.panel_id AND c.parameter_id IS NOT NULL AND upper(c.code) NOT IN ({FORM_CODES})
    WHERE d.mode <> 2 OR c.parameter_id = d.own OR c.parameter_id > 60""", drafted="""
      SELECT c_custkey AS draft_id, CASE WHEN c_custkey % 2 = 0 THEN 'Feline ' ELSE 'dog' END AS species, c_custkey % 3 AS mode,
             c_custkey % 25 + 1 AS a, c_custkey * 7 % 25 + 1 AS b, c_custkey % 100 + 1 AS own, (c_custkey % 60) || ' H' AS value FROM customer""",
    active_rows="""
    SELECT p.id AS panel_id, p.code, p.name, p.display_order, t.id AS parameter_id, t.name AS parameter_name, t.unit AS parameter_unit,
           coalesce(nullif(t.reference_range_dog, ''), nullif(t.reference_range, ''), '') AS parameter_reference_range_dog,
           coalesce(nullif(t.reference_range_cat, ''), nullif(t.reference_range, ''), '') AS parameter_reference_range_cat,
           t.display_order AS parameter_display_order
    FROM lab_test_panels p JOIN lab_test_parameters t ON t.panel_id = p.id WHERE p.is_active = 1 AND t.is_active = 1"""))
def _(lab: Lab):
    return printed.preview_lines(draft_rows(lab), lab.panels, lab.params)


@register("page_plan", sql(f"""
    WITH pages AS (
      SELECT rp.report_id, p.id AS panel_id, upper(p.code) AS code, p.name AS panel_name,
             p.display_order
      FROM lab_report_panels rp JOIN lab_test_panels p ON p.id = rp.panel_id
      WHERE upper(p.code) IN ({FORM_CODES}) OR EXISTS (
        SELECT 1 FROM lab_report_results s JOIN lab_test_parameters t ON t.id = s.parameter_id
        WHERE s.report_id = rp.report_id AND t.panel_id = p.id)),
    us AS (SELECT DISTINCT report_id FROM lab_report_panels rp
           JOIN lab_test_panels p ON p.id = rp.panel_id WHERE upper(p.code) = 'ULTRASOUND'),
    numbered AS (
      SELECT r.id AS report_id, g.panel_id, g.code, g.panel_name, r.clinical_notes, r.remarks,
             us.report_id IS NOT NULL AS has_us,
             row_number() OVER (PARTITION BY r.id ORDER BY g.display_order, g.panel_id) AS page,
             count(*) OVER (PARTITION BY r.id) AS pages
      FROM lab_reports r LEFT JOIN pages g ON g.report_id = r.id
      LEFT JOIN us ON us.report_id = r.id)
    SELECT report_id, CAST(page AS INTEGER) AS page, pages, panel_id, coalesce(code, '') AS code,
           coalesce(panel_name, '') AS panel_name,
           CASE WHEN code IS NULL THEN 'placeholder' WHEN code IN ({DOC_CODES}) THEN 'document'
                WHEN code IN ({FORM_CODES}) THEN 'form' ELSE 'table' END AS kind,
           CASE code WHEN 'SURGICAL_CONSENT' THEN 'Surgical Consent Form'
                WHEN 'TRAVEL_CERT' THEN 'Animal Health Certificate for Travel'
                ELSE 'Diagnostic Laboratory Report' END AS subtitle,
           page = 1 AS is_first, page = pages AS is_last,
           coalesce(code, '') NOT IN ({DOC_CODES}) AS has_patient_card,
           coalesce(code, '') NOT IN ({DOC_CODES}) AS has_footer,
           page = pages AND coalesce(code, '') NOT IN ({DOC_CODES}) AND NOT has_us
             AND coalesce(clinical_notes, '') <> '' AS has_doctor_remarks,
           page = pages AND coalesce(code, '') NOT IN ({DOC_CODES})
             AND coalesce(remarks, '') <> '' AS has_remarks
    FROM numbered""").replace("\n\n    WITH pages AS", ",\n pages AS").replace("\n    WITH pages AS", ", pages AS"))
def _(lab: Lab):
    return printed.page_plan(lab.tables)


# -- sources -------------------------------------------------------------------------------

TABLE_NAMES = (
    "lab_users", "lab_test_panels", "lab_test_parameters", "lab_reports", "lab_report_panels",
    "lab_report_results", "lab_report_images", "lab_report_forms",
)


@register("load_tables", sql(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM {t}"
    for t in TABLE_NAMES
)))
def _(lab: Lab):
    """The views saved as files, then loaded."""
    tables = load_tables(lab.spark, save_snapshot(lab.tables, shared_folder(lab.spark, "lab"), "1"))
    parts = [
        tables[t].agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("id_sum")).select(
            F.lit(t).alias("table_name"), "n", "id_sum"
        )
        for t in TABLE_NAMES
    ]
    return reduce(DataFrame.unionByName, parts)


@register("image_manifest", """
    SELECT doc_id, accepted, CASE WHEN NOT accepted THEN
             CASE WHEN mime IS NULL OR mime NOT IN ('image/jpeg','IMAGE/PNG','image/gif')
                  THEN 'not_an_image' ELSE 'too_large' END END AS reject_reason, safe_ext
    FROM (SELECT *, mime IS NOT NULL AND mime IN ('image/jpeg','IMAGE/PNG','image/gif')
                 AND size <= 8388608 AS accepted
          FROM (SELECT doc_id, n_chars * 1000 AS size,
                CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'IMAGE/PNG'
                     WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'image/gif' END AS mime,
                CASE doc_id % 6 WHEN 1 THEN '.png' WHEN 4 THEN '.webp' WHEN 5 THEN '.jpeg'
                     ELSE '.jpg' END AS safe_ext
                FROM documents))""")
def _(lab: Lab):
    d = F.col("doc_id")
    endings = {0: ".JPG", 1: ".png", 2: ".tiff", 3: "", 4: ".x.WebP"}
    ending = F.lit(".jpeg")
    for k, v in endings.items():
        ending = F.when(d % 6 == k, v).otherwise(ending)
    mime = (
        F.when(d % 5 == 0, "image/jpeg").when(d % 5 == 1, "IMAGE/PNG")
        .when(d % 5 == 2, "application/pdf").when(d % 5 == 3, "image/gif")
    )
    files = lab.raw("documents").select(
        "doc_id", F.concat(F.lit("dir.d/scan"), text(d), ending).alias("original_name"),
        mime.alias("mime"), (F.col("n_chars") * 1000).alias("bytes"),
    )
    return images.image_manifest(files, MAX_UPLOAD_BYTES).select("doc_id", "accepted", "reject_reason", "safe_ext")


@register("missing_files", sql("""
    SELECT id, stored_name FROM lab_report_images
    WHERE stored_name NOT IN (SELECT 'us-' || doc_id || '.jpg' FROM labels)"""))
def _(lab: Lab):
    listing = lab.raw("labels").select(
        F.concat(F.lit("us-"), text(F.col("doc_id")), F.lit(".jpg")).alias("stored_name")
    )
    return images.missing_files(lab.images, listing).select("id", "stored_name")


def upload_folder(lab: Lab) -> str:
    """A file for every document, in a folder of its own: right and wrong endings, contents that fit them or don't."""
    place = shared_folder(lab.spark, "uploads")
    d = F.col("doc_id")
    rows = lab.raw("documents").select(
        F.concat(F.lit("us-"), text(d), pick(d % 5, {0: ".jpg", 1: ".PNG", 2: ".tiff", 3: ".gif"}, ".webp")).alias("name"),
        pick(d % 7, {0: "FFD8FF", 1: "89504E470D0A1A0A", 2: "474946383961", 3: "524946460000000057454250", 4: "474946383761"}, "00").alias("head"),
        (F.col("n_chars") % 3000).alias("more"),
    )

    def write(batches):
        from pyarrow import RecordBatch
        from pyarrow.fs import FileSystem

        for b in batches:
            fs, base = FileSystem.from_uri(place)
            fs.create_dir(base, recursive=True)
            for r in b.to_pylist():
                with fs.open_output_stream(f"{base}/{r['name']}", compression=None) as out:
                    out.write(bytes.fromhex(r["head"]) + b"x" * r["more"])
            yield RecordBatch.from_pylist([{"n": b.num_rows}])

    rows.mapInArrow(write, "n LONG").agg(F.sum("n")).collect()
    return place


@register("file_manifest", """
    SELECT stored_name, bytes, reject_reason IS NULL AS accepted, reject_reason FROM (
      SELECT 'us-' || doc_id || ['.jpg', '.PNG', '.tiff', '.gif', '.webp'][doc_id % 5 + 1] AS stored_name, bytes,
             CASE WHEN doc_id % 5 = 2 THEN 'not_an_image' WHEN bytes > 2500 THEN 'too_large'
                  WHEN NOT [doc_id % 7 = 0, doc_id % 7 = 1, false, doc_id % 7 IN (2, 4), doc_id % 7 = 3][doc_id % 5 + 1] THEN 'wrong_content' END AS reject_reason
      FROM (SELECT doc_id, n_chars % 3000 + [3, 8, 6, 12, 6, 1, 1][doc_id % 7 + 1] AS bytes FROM documents))""")
def _(lab: Lab):
    return image_files.file_manifest(lab.spark, upload_folder(lab), 2500)


@register("missing_files_listed", sql("""
    SELECT id, stored_name FROM lab_report_images
    WHERE stored_name NOT IN (SELECT 'us-' || doc_id || '.jpg' FROM documents WHERE doc_id % 5 = 0)"""))
def _(lab: Lab):
    return images.missing_files(lab.images, image_files.list_files(lab.spark, upload_folder(lab))).select("id", "stored_name")


@register("unattached_images", sql(
    "SELECT id, stored_name FROM lab_report_images WHERE report_id IS NULL"
))
def _(lab: Lab):
    return images.unattached_images(lab.images).select("id", "stored_name")


@register("register_uploads", sql("""
    SELECT id, report_id, stored_name, original_name, created_by, display_order FROM lab_report_images
    UNION ALL SELECT (SELECT max(id) FROM lab_report_images) + row_number() OVER (ORDER BY c_custkey), NULL,
      'up-' || c_custkey || '.png', CASE WHEN c_custkey % 3 = 0 THEN 'up-' || c_custkey || '.png' ELSE c_name END,
      c_nationkey + 1, 0 FROM customer"""))
def _(lab: Lab):
    k = F.col("c_custkey")
    uploads = lab.raw("customer").select(
        k.alias("seq"), F.concat(F.lit("up-"), k.cast("string"), F.lit(".png")).alias("stored_name"),
        F.when(k % 3 == 0, "").otherwise(F.col("c_name")).alias("original_name"),
        (F.col("c_nationkey") + 1).alias("user_id"),
    )
    return images.register_uploads(lab.images, uploads, AS_OF).drop("created_at")


# -- lists and lookups ---------------------------------------------------------------------

LISTED = """id, report_no, patient_name, pet_name, species,
            CAST(sample_date AS VARCHAR) AS sample_date,
            CAST(report_date AS VARCHAR) AS report_date, status,
            CAST(created_at AS VARCHAR) AS created_at"""
SEARCH = "(lower(report_no) LIKE '{0}' OR lower(patient_name) LIKE '{0}' OR lower(pet_name) LIKE '{0}' OR lower(owner_phone) LIKE '{0}')"


@register("report_list", sql(f"SELECT {LISTED} FROM lab_reports ORDER BY id DESC LIMIT 50"))
def _(lab: Lab):
    return lists.report_list(lab.reports, limit=50)


@register("report_list_search", sql(
    f"SELECT {LISTED} FROM lab_reports WHERE {SEARCH.format('%000_7%')} ORDER BY id DESC LIMIT 500"
))
def _(lab: Lab):
    return lists.report_list(lab.reports, " 000_7 ", 500)


BATCH = ["Rex", "9230010", "customer#00000012", "", "pz-1997-", "no such text"]


@register("report_list_batch", sql(f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY query_no ORDER BY id DESC) AS INTEGER) AS position
    FROM ({' UNION ALL '.join(
        f"SELECT {LISTED}, {i} AS query_no FROM lab_reports WHERE {SEARCH.format('%' + q.lower() + '%') if q else 'true'}"
        for i, q in enumerate(BATCH))})
    QUALIFY position <= 20"""))
def _(lab: Lab):
    return lists.report_list_batch(lab.reports, BATCH, 20)


#: A search text of every customer, and some odd ones: whole and cut names, numbers, wildcards, escapes, short and blank ones.
SEARCH_TEXTS = """
      SELECT c_custkey AS query_no, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN ' ' || substr(c_name, 11) || ' '
             WHEN 2 THEN substr(c_name, 14) WHEN 3 THEN '92300' || (c_custkey + 1000000) WHEN 4 THEN 'PZ-199_-' || c_custkey
             WHEN 5 THEN '#0%' || c_custkey WHEN 6 THEN 'r\\' || (c_custkey % 100) WHEN 7 THEN '199' || (c_custkey % 10) || '-' || c_custkey END AS q
      FROM customer
      UNION ALL SELECT * FROM (VALUES (1000000001, ''), (1000000002, ' % '), (1000000003, '_________________'), (1000000004, 'M'), (1000000005, 'ex'),
             (1000000006, '\\_'), (1000000007, NULL), (1000000008, 'E_'), (1000000009, '12\\'), (1000000010, 'no such text'))"""


def search_texts(lab: Lab):
    k, name = F.col("c_custkey"), F.col("c_name")
    people = lab.raw("customer").select(k.alias("query_no"), pick(k % 8, {
        0: name, 1: F.concat(F.lit(" "), F.substring(name, 11, 100), F.lit(" ")), 2: F.substring(name, 14, 100),
        3: F.concat(F.lit("92300"), text(k + 1000000)), 4: F.concat(F.lit("PZ-199_-"), text(k)),
        5: F.concat(F.lit("#0%"), text(k)), 6: F.concat(F.lit("r\\"), text(k % 100)),
    }, F.concat(F.lit("199"), text(k % 10), F.lit("-"), text(k))).alias("q"))
    few = lab.spark.createDataFrame([(1000000001 + i, q) for i, q in enumerate(
        ["", " % ", "_" * 17, "M", "ex", "\\_", None, "E_", "12\\", "no such text"])], "query_no BIGINT, q STRING")
    return people.unionByName(few)


#: What the source's LIKE makes of a search: backslashes escape %, _ and each other, others are dropped.
ANY_TEXT = """SELECT query_no, '%' || lower(trim(coalesce(q, ''))) || '%' AS raw,
      regexp_replace('%' || lower(trim(coalesce(q, ''))) || '%', '\\\\([^%_\\\\])', '\\1', 'g') AS pattern FROM texts"""


@register("report_list_searches", sql("""
    SELECT query_no, r.id FROM any_text t JOIN lab_reports r ON t.raw = '%%'
      OR lower(report_no) LIKE t.pattern ESCAPE '\' OR lower(patient_name) LIKE t.pattern ESCAPE '\'
      OR lower(pet_name) LIKE t.pattern ESCAPE '\' OR lower(owner_phone) LIKE t.pattern ESCAPE '\'""",
    texts=SEARCH_TEXTS, any_text=ANY_TEXT))
def _(lab: Lab):
    return searches.report_list_searches(lab.reports, search_texts(lab)).select("query_no", "id")


@register("report_list_searches_newest", sql("""
    SELECT query_no, id, CAST(row_number() OVER (PARTITION BY query_no ORDER BY id DESC) AS INTEGER) AS position FROM (
      SELECT query_no, r.id FROM any_text t JOIN lab_reports r ON t.raw = '%%'
        OR lower(report_no) LIKE t.pattern ESCAPE '\' OR lower(patient_name) LIKE t.pattern ESCAPE '\'
        OR lower(pet_name) LIKE t.pattern ESCAPE '\' OR lower(owner_phone) LIKE t.pattern ESCAPE '\')
    QUALIFY position <= 3""", texts=SEARCH_TEXTS, any_text=ANY_TEXT))
def _(lab: Lab):
    return searches.report_list_searches(lab.reports, search_texts(lab), 3).select("query_no", "id", "position")


@register("report_list_half", sql(f"SELECT {LISTED} FROM lab_reports ORDER BY id DESC LIMIT (SELECT count(*) // 2 FROM lab_reports)"))
def _(lab: Lab):
    return lists.report_list(lab.reports, limit=lab.reports.count() // 2)


@register("reports_by_no", sql("""
    SELECT id, report_no FROM lab_reports WHERE report_no IN (
      SELECT 'PZ-' || year(l_shipdate) || '-' || (l_orderkey + 1) FROM lineitem)"""))
def _(lab: Lab):
    nos = lab.raw("lineitem").select(F.concat(
        F.lit("PZ-"), text(F.year("l_shipdate")), F.lit("-"), text(F.col("l_orderkey") + 1)
    ).alias("report_no"))
    return lists.reports_by_no(lab.reports, nos).select("id", "report_no")


@register("reports_by_id", sql("""
    SELECT id, report_no FROM lab_reports
    WHERE id IN (SELECT l_orderkey + 1 FROM lineitem WHERE l_returnflag = 'R')"""))
def _(lab: Lab):
    ids = lab.raw("lineitem").filter(F.col("l_returnflag") == "R").select(
        (F.col("l_orderkey") + 1).alias("report_id")
    )
    return lists.reports_by_id(lab.reports, ids).select("id", "report_no")


@register("active_users", sql("""
    SELECT id, name, lower(trim(email)) AS email, role FROM lab_users WHERE is_active = 1"""))
def _(lab: Lab):
    return lists.active_users(lab.users)


@register("needs_setup", sql("SELECT count(*) = 0 AS needs_setup FROM lab_users"))
def _(lab: Lab):
    return lists.needs_setup(lab.users)


@register("rebook_key", sql(f"""
    SELECT id AS report_id, {first_text('owner_phone', 'pet_name', 'patient_name', default='')}
           AS rebook_key FROM lab_reports"""))
def _(lab: Lab):
    return lists.rebook_key(lab.reports)


# -- catalog -------------------------------------------------------------------------------

CATALOG = """
    SELECT p.id AS panel_id, p.code, p.name, p.description, p.display_order, p.is_active,
           t.id AS parameter_id, t.code AS parameter_code, t.name AS parameter_name,
           t.unit AS parameter_unit,
           CASE WHEN t.id IS NOT NULL THEN coalesce(nullif(t.reference_range_dog, ''),
             nullif(t.reference_range, ''), '') END AS parameter_reference_range_dog,
           CASE WHEN t.id IS NOT NULL THEN coalesce(nullif(t.reference_range_cat, ''),
             nullif(t.reference_range, ''), '') END AS parameter_reference_range_cat,
           t.reference_range AS parameter_reference_range,
           t.display_order AS parameter_display_order, t.is_active AS parameter_is_active
    FROM lab_test_panels p LEFT JOIN {params} t ON t.panel_id = p.id {where}"""
ACTIVE = CATALOG.format(
    params="(SELECT * FROM lab_test_parameters WHERE is_active = 1)", where="WHERE p.is_active = 1"
)
FULL = CATALOG.format(params="lab_test_parameters", where="")


@register("active_catalog", sql(ACTIVE))
def _(lab: Lab):
    return catalog.panels_with_parameters(lab.panels, lab.params, True)


@register("full_catalog", sql(FULL))
def _(lab: Lab):
    return catalog.panels_with_parameters(lab.panels, lab.params)


@register("catalog_ranges", sql("""
    SELECT id, coalesce(nullif(reference_range_dog, ''), nullif(reference_range, ''), '') AS dog,
           coalesce(nullif(reference_range_cat, ''), nullif(reference_range, ''), '') AS cat
    FROM lab_test_parameters"""))
def _(lab: Lab):
    return details.catalog_ranges(lab.params).select(
        "id", F.col("reference_range_dog").alias("dog"), F.col("reference_range_cat").alias("cat")
    )


@register("catalog_order", sql("""
    SELECT id, code, row_number() OVER (ORDER BY display_order, id) AS place
    FROM lab_test_panels"""))
def _(lab: Lab):
    return catalog.catalog_order(lab.panels)


@register("catalog_bundles", sql(f"""
    SELECT *, CASE WHEN parameter_id IS NOT NULL THEN CAST(row_number() OVER (
      PARTITION BY panel_id ORDER BY parameter_display_order, parameter_id) - 1 AS INTEGER) END AS position
    FROM ({FULL})"""))
def _(lab: Lab):
    return bundles.catalog_bundles(lab.panels, lab.params)


@register("panel_parameter_counts", sql("""
    SELECT p.id AS panel_id, p.code, p.name, p.is_active, count(t.id) AS parameters
    FROM lab_test_panels p LEFT JOIN lab_test_parameters t ON t.panel_id = p.id GROUP BY ALL"""))
def _(lab: Lab):
    return catalog.panel_parameter_counts(lab.panels, lab.params)


@register("panel_kind", sql(f"""
    SELECT id, code, CASE WHEN upper(code) IN ({DOC_CODES}) THEN 'document'
           WHEN upper(code) IN ({FORM_CODES}) THEN 'form'
           WHEN upper(code) = 'CHEMISTRY' THEN 'chemistry' ELSE 'table' END AS kind
    FROM lab_test_panels"""))
def _(lab: Lab):
    return catalog.panel_kind(lab.panels)


# -- joins ---------------------------------------------------------------------------------


@register("with_author", sql(f"""
    SELECT r.id, {species('r.species')} AS species, u.name AS created_by_name
    FROM lab_reports r LEFT JOIN lab_users u ON u.id = r.created_by"""))
def _(lab: Lab):
    return details.report_headers(lab.reports, lab.users).select("id", "species", "created_by_name")


@register("report_panel_details", sql("""
    SELECT rp.report_id, p.id AS panel_id, p.code, p.name, p.description, p.display_order
    FROM lab_report_panels rp JOIN lab_test_panels p ON p.id = rp.panel_id"""))
def _(lab: Lab):
    return details.report_panel_details(lab.report_panels, lab.panels)


RESULT_DETAILS = """
    SELECT s.id, s.report_id, s.parameter_id, s.value, CAST(NULL AS VARCHAR) AS flag,
           CAST(NULL AS VARCHAR) AS remarks, t.panel_id, t.code, t.name, t.unit,
           t.reference_range, t.reference_range_dog, t.reference_range_cat, t.display_order
    FROM lab_report_results s JOIN lab_test_parameters t ON t.id = s.parameter_id"""


@register("report_result_details", sql(RESULT_DETAILS))
def _(lab: Lab):
    return details.report_result_details(lab.results, lab.params)


@register("results_in_panels", sql(f"""
    SELECT rp.report_id, p.id AS panel_id, p.code, p.display_order, d.id, d.parameter_id, d.value,
           d.code AS result_code, d.display_order AS result_display_order
    FROM lab_report_panels rp JOIN lab_test_panels p ON p.id = rp.panel_id
    LEFT JOIN ({RESULT_DETAILS}) d ON d.report_id = rp.report_id AND d.panel_id = p.id"""))
def _(lab: Lab):
    rows = details.results_in_panels(
        details.report_panel_details(lab.report_panels, lab.panels),
        details.report_result_details(lab.results, lab.params),
    )
    return rows.select(
        "report_id", "panel_id", "code", "display_order", "id", "parameter_id", "value",
        "result_code", "result_display_order",
    )


@register("panels_with_parameters", sql(f"""
    SELECT panel_id, parameter_id, parameter_code FROM ({ACTIVE})"""))
def _(lab: Lab):
    return catalog.panels_with_parameters(lab.panels, lab.params, True).select(
        "panel_id", "parameter_id", "parameter_code"
    )


@register("species_ranges", sql(f"""
    SELECT s.id, s.report_id, s.parameter_id, {reference('r.species', 't.')} AS reference_range
    FROM lab_report_results s JOIN lab_test_parameters t ON t.id = s.parameter_id
    JOIN lab_reports r ON r.id = s.report_id"""))
def _(lab: Lab):
    rows = details.report_result_details(lab.results, lab.params).join(
        lab.reports.select(F.col("id").alias("report_id"), "species"), "report_id"
    )
    return details.species_ranges(rows).select("id", "report_id", "parameter_id", "reference_range")


@register("report_traits", sql("""
    SELECT rp.report_id, bool_or(upper(p.code) = 'ULTRASOUND') AS has_ultrasound
    FROM lab_report_panels rp JOIN lab_test_panels p ON p.id = rp.panel_id GROUP BY 1"""))
def _(lab: Lab):
    return details.report_traits(lab.report_panels, lab.panels)


@register("fk_violations", sql("""
    SELECT id, report_id, stored_name FROM lab_report_images
    WHERE report_id IS NOT NULL AND report_id NOT IN (
      SELECT report_id FROM lab_report_panels WHERE panel_id = 3)"""))
def _(lab: Lab):
    with_us = lab.report_panels.filter(F.col("panel_id") == 3)
    return checks.fk_violations(lab.images, with_us, "report_id", "report_id").select(
        "id", "report_id", "stored_name"
    )


FOREIGN_KEYS = (
    ("lab_report_panels", "report_id", "lab_reports"), ("lab_report_panels", "panel_id", "lab_test_panels"),
    ("lab_report_results", "report_id", "lab_reports"), ("lab_report_results", "parameter_id", "lab_test_parameters"),
    ("lab_reports", "created_by", "lab_users"),
)


@register("fk_violations_all", sql(" UNION ALL ".join(
    f"SELECT '{child}.{fk}' AS reference, c.id FROM {child} c WHERE c.{fk} IS NOT NULL "
    f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{fk} AND p.id % 5 <> 0)"
    for child, fk, parent in FOREIGN_KEYS)))
def _(lab: Lab):
    # parents with ids divisible by 5 count as missing, so that every reference has violations
    return reduce(DataFrame.unionByName, [
        checks.fk_violations(
            lab.tables[child], lab.tables[parent].filter(F.col("id") % 5 != 0), fk
        ).select(F.lit(f"{child}.{fk}").alias("reference"), "id")
        for child, fk, parent in FOREIGN_KEYS
    ])


@register("unique_violations", sql("""
    SELECT report_id, form_code, count(*) AS rows FROM form_writes
    GROUP BY report_id, form_code HAVING count(*) > 1"""))
def _(lab: Lab):
    return checks.unique_violations(lab.form_writes, ["report_id", "form_code"])


# -- bundles -------------------------------------------------------------------------------


BUNDLES = f"""
    SELECT r.id AS report_id, {species('r.species')} AS species, u.name AS created_by_name,
           p.id AS panel_id, CASE WHEN p.id IS NOT NULL THEN CAST(dense_rank() OVER (
             PARTITION BY r.id ORDER BY p.display_order, p.id) - 1 AS INTEGER) END AS panel_pos,
           d.id AS result_id, d.parameter_id, d.value,
           CASE WHEN d.id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY r.id, p.id
             ORDER BY d.display_order, d.parameter_id, d.id) - 1 AS INTEGER) END AS result_pos,
           CASE WHEN d.id IS NOT NULL THEN {reference('r.species', 'd.')} END AS reference_range
    FROM lab_reports r LEFT JOIN lab_users u ON u.id = r.created_by
    LEFT JOIN lab_report_panels rp ON rp.report_id = r.id
    LEFT JOIN lab_test_panels p ON p.id = rp.panel_id
    LEFT JOIN ({RESULT_DETAILS}) d ON d.report_id = r.id AND d.panel_id = p.id"""


def _bundle_rows(b: dict[str, DataFrame]) -> DataFrame:
    panels = b["panels"].select("report_id", "panel_id", F.col("position").alias("panel_pos"))
    results = b["results"].select(
        "report_id", "panel_id", F.col("position").alias("result_pos"), F.col("id").alias("result_id"),
        "parameter_id", "value", "reference_range",
    )
    return b["reports"].select("report_id", "species", "created_by_name").join(
        panels, "report_id", "left").join(results, ["report_id", "panel_id"], "left")


@register("report_bundles", sql(BUNDLES))
def _(lab: Lab):
    return _bundle_rows(bundles.report_bundles(lab.tables))


@register("report_bundles_by_no", sql(BUNDLES + """ WHERE r.report_no IN (
    SELECT 'PZ-' || year(l_shipdate) || '-' || (l_orderkey + 1) FROM lineitem)"""))
def _(lab: Lab):
    """Whole reports, looked up by their numbers."""
    nos = lab.raw("lineitem").select(F.concat(
        F.lit("PZ-"), text(F.year("l_shipdate")), F.lit("-"), text(F.col("l_orderkey") + 1)
    ).alias("report_no")).distinct()
    return _bundle_rows(bundles.report_bundles(lab.tables, lists.reports_by_no(lab.reports, nos)))


@register("report_bundle_images", sql("""
    SELECT report_id, id, stored_name, original_name, display_order,
           '/api/uploads/file/' || stored_name AS url,
           CAST(row_number() OVER (PARTITION BY report_id ORDER BY display_order, id) - 1 AS INTEGER) AS position
    FROM lab_report_images WHERE report_id IS NOT NULL"""))
def _(lab: Lab):
    return bundles.report_bundles(lab.tables)["images"]


@register("report_drafts", sql(f"""
    SELECT r.id AS edit_id, coalesce(r.owner_phone, '') AS owner_phone,
           coalesce(CAST(r.sample_date AS VARCHAR), '2026-03-05') AS sample_date,
           d.parameter_id, coalesce(d.value, '') AS value
    FROM lab_reports r JOIN lab_report_panels rp ON rp.report_id = r.id
    JOIN ({RESULT_DETAILS}) d ON d.report_id = r.id AND d.panel_id = rp.panel_id"""))
def _(lab: Lab):
    d = bundles.report_drafts(lab.tables, F.lit(AS_OF))
    return d["drafts"].select("editId", "owner_phone", "sample_date").join(d["values"], "editId").select(
        F.col("editId").alias("edit_id"), "owner_phone", "sample_date", "parameter_id", "value"
    )


@register("report_draft_headers", sql(f"""
    SELECT id AS "editId", coalesce(patient_name, '') AS patient_name, coalesce(owner_phone, '') AS owner_phone,
           coalesce(pet_name, '') AS pet_name, {species('species')} AS species, coalesce(breed, '') AS breed,
           coalesce(age, '') AS age, coalesce(sex, '') AS sex, coalesce(referring_vet, '') AS referring_vet,
           coalesce(CAST(sample_date AS VARCHAR), '2026-03-05') AS sample_date,
           coalesce(CAST(report_date AS VARCHAR), '2026-03-05') AS report_date,
           coalesce(remarks, '') AS remarks, coalesce(clinical_notes, '') AS clinical_notes, 'final' AS status
    FROM lab_reports"""))
def _(lab: Lab):
    return bundles.report_drafts(lab.tables, F.lit(AS_OF))["drafts"]


@register("report_forms_map", sql("""
    SELECT report_id, form_code, k AS key, json_extract_string(form_json, '$.' || k) AS value
    FROM (SELECT report_id, form_code, form_json, unnest(json_keys(form_json)) AS k
          FROM lab_report_forms WHERE json_valid(form_json))
    UNION ALL SELECT report_id, form_code, NULL, NULL FROM lab_report_forms
    WHERE NOT json_valid(form_json)"""))
def _(lab: Lab):
    return bundles.report_forms_map(lab.forms).select(
        "report_id", "form_code", F.explode_outer("fields").alias("key", "value")
    )


#: Every form as some JSON: as it is, in an array, nested, a number, a text, null, or unreadable.
ANY_JSON = """SELECT id, report_id, form_code, CASE id % 7 WHEN 0 THEN form_json WHEN 1 THEN '[' || form_json || ',' || id || ',[]]'
      WHEN 2 THEN '{"deep":{"list":[' || form_json || ',{"n":' || id || ',"ok":true}],"none":null,"empty":{}}}' WHEN 3 THEN CAST(id AS VARCHAR)
      WHEN 4 THEN '"text ' || id || '"' WHEN 5 THEN 'null' ELSE '{bad' END AS form_json
    FROM lab_report_forms"""


@register("form_leaves", sql("""
    SELECT report_id, form_code, substr(fullkey, 2) AS path,
           CASE WHEN type = 'NULL' THEN 'null' WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('OBJECT', 'ARRAY', 'BOOLEAN') THEN lower(type)
                ELSE 'number' END AS kind, CAST(value AS VARCHAR) AS value
    FROM (SELECT report_id, form_code, CASE WHEN json_valid(form_json) THEN form_json ELSE '{}' END AS j FROM any_json) f, json_tree(f.j) t
    WHERE t.type NOT IN ('OBJECT', 'ARRAY') OR CAST(t.value AS VARCHAR) IN ('{}', '[]')""", any_json=ANY_JSON))
def _(lab: Lab):
    k = F.col("id")
    json = lab.forms.withColumn("form_json", pick(k % 7, {
        0: F.col("form_json"), 1: F.concat(F.lit("["), F.col("form_json"), F.lit(","), text(k), F.lit(",[]]")),
        2: F.concat(F.lit('{"deep":{"list":['), F.col("form_json"), F.lit(',{"n":'), text(k), F.lit(',"ok":true}],"none":null,"empty":{}}}')),
        3: text(k), 4: F.concat(F.lit('"text '), text(k), F.lit('"')), 5: "null",
    }, "{bad"))
    return forms.form_leaves(forms.form_values(json))


# -- directory -----------------------------------------------------------------------------

KEYED = f"(SELECT *, {duck_owner_key()} AS owner_key, {duck_pet_key()} AS pet_key FROM lab_reports)"


def newest(c: str) -> str:
    return f"coalesce(arg_max({c}, id) FILTER (WHERE {c} IS NOT NULL AND {c} <> ''), '') AS {c}"


@register("owner_directory", sql(f"""
    SELECT owner_key, {newest('patient_name')}, {newest('owner_phone')}, {newest('referring_vet')},
           max(id) AS last_report_id, count(*) AS reports
    FROM {KEYED} GROUP BY owner_key"""))
def _(lab: Lab):
    return directory.owner_directory(lab.reports)


PETS = f"""
    SELECT owner_key, pet_key, coalesce(pet_name, '') AS pet_name, coalesce(species, '') AS species,
           coalesce(breed, '') AS breed, coalesce(age, '') AS age, coalesce(sex, '') AS sex,
           id AS last_report_id, CAST(report_date AS VARCHAR) AS last_report_date
    FROM {KEYED} QUALIFY row_number() OVER (PARTITION BY owner_key, pet_key ORDER BY id DESC) = 1"""


@register("pet_directory", sql(PETS))
def _(lab: Lab):
    return directory.pet_directory(lab.reports)


@register("latest_pet_row", sql(f"""
    SELECT owner_key, pet_key, id, report_no, patient_name, status FROM {KEYED}
    QUALIFY row_number() OVER (PARTITION BY owner_key, pet_key ORDER BY id DESC) = 1"""))
def _(lab: Lab):
    return directory.latest_pet_row(lab.reports).select(
        "owner_key", "pet_key", "id", "report_no", "patient_name", "status"
    )


@register("owner_pet_counts", sql(f"""
    SELECT owner_key, count(DISTINCT pet_key) AS pets FROM {KEYED} GROUP BY owner_key"""))
def _(lab: Lab):
    return directory.owner_pet_counts(lab.reports)


def search_sql(like: str, recheck: str = "true", end: str = "") -> str:
    return sql(f"""
    SELECT o.owner_key, o.patient_name, o.owner_phone, o.referring_vet, o.seen AS owner_last_report_id, p.pet_key,
           p.pet_name, p.species, p.breed, p.age, p.sex, p.last_report_id, p.last_report_date
    FROM (SELECT owner_key, {newest('patient_name')}, {newest('owner_phone')},
                 {newest('referring_vet')}, max(id) AS seen FROM hits GROUP BY owner_key) o
    JOIN ({PETS.replace(KEYED, 'hits')}) p ON p.owner_key = o.owner_key {end}""", hits=f"""
      SELECT * FROM {KEYED} WHERE (lower(owner_phone) LIKE '{like}'
        OR lower(patient_name) LIKE '{like}' OR lower(pet_name) LIKE '{like}') AND {recheck}""")


@register("patient_search", search_sql("%ustomer#00%1_%"))
def _(lab: Lab):
    return directory.patient_search(lab.reports, "ustomer#00%1_")


@register("patient_search_newest", search_sql(
    "%ustomer#00%1_%", end="ORDER BY owner_last_report_id DESC, last_report_id DESC LIMIT 200"))
def _(lab: Lab):
    return directory.patient_search(lab.reports, "ustomer#00%1_", limit=200)


@register("patient_search_half", search_sql("%e%", end="""ORDER BY owner_last_report_id DESC, last_report_id DESC
    LIMIT (SELECT count(*) // 4 FROM lab_reports)"""))
def _(lab: Lab):
    return directory.patient_search(lab.reports, "e", limit=lab.reports.count() // 4)


PATIENT_HITS = {
    "texts": SEARCH_TEXTS,
    "asked": """SELECT query_no, x, CASE WHEN length(regexp_replace(x, '[^0-9]', '', 'g')) >= 7 THEN regexp_replace(x, '[^0-9]', '', 'g') END AS phone
      FROM (SELECT query_no, trim(coalesce(q, '')) AS x FROM texts) WHERE x <> ''""",
    "likes": "SELECT query_no, phone, regexp_replace('%' || lower(coalesce(phone, x)) || '%', '\\\\([^%_\\\\])', '\\1', 'g') AS pattern FROM asked",
    "hits": f"""SELECT query_no, r.* FROM {KEYED} r JOIN likes ON (lower(owner_phone) LIKE pattern ESCAPE '\\'
        OR lower(patient_name) LIKE pattern ESCAPE '\\' OR lower(pet_name) LIKE pattern ESCAPE '\\')
      AND (phone IS NULL OR contains(regexp_replace(coalesce(owner_phone, ''), '[^0-9]', '', 'g'), phone))""",
}


@register("patient_searches", sql(f"""
    SELECT o.query_no, o.owner_key, o.patient_name, o.owner_phone, o.referring_vet, o.seen AS owner_last_report_id, p.pet_key,
           p.pet_name, p.species, p.breed, p.age, p.sex, p.last_report_id, p.last_report_date
    FROM (SELECT query_no, owner_key, {newest('patient_name')}, {newest('owner_phone')},
                 {newest('referring_vet')}, max(id) AS seen FROM hits GROUP BY query_no, owner_key) o
    JOIN (SELECT query_no, owner_key, pet_key, coalesce(pet_name, '') AS pet_name, coalesce(species, '') AS species, coalesce(breed, '') AS breed,
                 coalesce(age, '') AS age, coalesce(sex, '') AS sex, id AS last_report_id, CAST(report_date AS VARCHAR) AS last_report_date
          FROM hits QUALIFY row_number() OVER (PARTITION BY query_no, owner_key, pet_key ORDER BY id DESC) = 1) p
      ON p.query_no = o.query_no AND p.owner_key = o.owner_key""", **PATIENT_HITS))
def _(lab: Lab):
    return searches.patient_searches(lab.reports, search_texts(lab))


@register("patient_search_phone", search_sql(
    "%9230010%", "regexp_replace(coalesce(owner_phone, ''), '[^0-9]', '', 'g') LIKE '%9230010%'"))
def _(lab: Lab):
    return directory.patient_search(lab.reports, " +92 300-10 ")


@register("search_owners", sql(f"""
    SELECT owner_key, {newest('patient_name')}, {newest('owner_phone')}, {newest('referring_vet')},
           max(id) AS owner_last_report_id, count(DISTINCT pet_key) AS pets
    FROM (SELECT * FROM {KEYED} WHERE lower(owner_phone) LIKE '%rex%'
      OR lower(patient_name) LIKE '%rex%' OR lower(pet_name) LIKE '%rex%') GROUP BY owner_key"""))
def _(lab: Lab):
    return directory.search_owners(lab.reports, "Rex")


# -- numbering -----------------------------------------------------------------------------


NUMBERS = sql("""
    WITH old AS (SELECT year(report_date) AS y, count(*) AS n FROM lab_reports
                 WHERE status = 'draft' GROUP BY 1)
    SELECT id, 'PZ-' || y || '-' || lpad(CAST(seq AS VARCHAR),
             CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS report_no
    FROM (SELECT r.id, year(report_date) AS y, coalesce(l.last, 0)
            + row_number() OVER (PARTITION BY year(report_date) ORDER BY r.id) AS seq
          FROM lab_reports r LEFT JOIN (
            SELECT year(report_date) AS ly, arg_max(id, id) AS last FROM lab_reports
            WHERE status = 'draft' GROUP BY 1) l ON l.ly = year(report_date)
          WHERE status = 'final')""").replace("\n\n    WITH old AS", ",\n old AS").replace("\n    WITH old AS", ", old AS")


@register("assign_report_no", NUMBERS)
def _(lab: Lab):
    new = lab.reports.filter(F.col("status") == "final").select(
        "id", F.year("report_date").alias("year")
    )
    # the drafts stand for what is numbered already: their number ends in their id
    old = lab.reports.filter(F.col("status") == "draft")
    return numbering.assign_report_no(new, old, "year", ["id"], bits=12).select("id", "report_no")


@register("assign_report_no_sparse", NUMBERS)
def _(lab: Lab):
    # arrival numbers as far apart as times in nanoseconds: each has a range of its own
    new = lab.reports.filter(F.col("status") == "final").select(
        "id", F.year("report_date").alias("year"), (F.col("id") * (1 << 36)).alias("at")
    )
    old = lab.reports.filter(F.col("status") == "draft")
    return numbering.assign_report_no(new, old, "year", ["at"]).select("id", "report_no")


# -- scalars -------------------------------------------------------------------------------


@register("header_scalars", sql(f"""
    SELECT id, {species('species')} AS species_norm,
           regexp_replace(coalesce(owner_phone, ''), '[^0-9]', '', 'g') AS digits,
           length(regexp_replace(coalesce(owner_phone, ''), '[^0-9]', '', 'g')) >= 7 AS is_phone,
           {duck_owner_key()} AS owner_key, {duck_pet_key()} AS pet_key,
           coalesce(nullif(substr(CAST(sample_date AS VARCHAR), 1, 10), ''), '-') AS sample_day,
           strftime(coalesce(created_at, CAST(report_date AS TIMESTAMP) + INTERVAL '14:07:09' HOUR TO SECOND), '%d %b %Y') AS stamp_date,
           lower(strftime(coalesce(created_at, CAST(report_date AS TIMESTAMP) + INTERVAL '14:07:09' HOUR TO SECOND), '%I:%M %p')) AS stamp_time,
           {first_text('pet_name', default='Unnamed')} || ' (' || {first_text('species', default='N/A')}
             || ')' || coalesce('  -  ' || {nz('breed')}, '') AS label,
           replace(replace(replace(replace(replace(coalesce(x, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe_remarks,
           coalesce(regexp_matches(y, '^[0-9]+$'), false) AS numeric_age
    FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN '<b title="' || coalesce(remarks, '&') || '">it''s &lt; ' || coalesce(patient_name, '') END AS x,
                 CASE WHEN id % 2 = 0 THEN split_part(age, ' ', 1) WHEN id % 5 = 0 THEN '' ELSE age END AS y FROM lab_reports)""".replace("INTERVAL '14:07:09' HOUR TO SECOND", "to_seconds(50829)")))
def _(lab: Lab):
    r = lab.reports
    stamp = report_date_parts(F.col("report_date"), F.col("created_at"), F.lit(AS_OF))
    return r.select(
        "id", normalize_species(F.col("species")).alias("species_norm"),
        digits_only(F.col("owner_phone")).alias("digits"),
        is_phone_query(F.col("owner_phone")).alias("is_phone"),
        owner_key(F.col("owner_phone"), F.col("patient_name")).alias("owner_key"),
        pet_key(F.col("pet_name"), F.col("id")).alias("pet_key"),
        date_only(F.col("sample_date")).alias("sample_day"),
        stamp["date"].alias("stamp_date"), stamp["time"].alias("stamp_time"),
        pet_label(F.col("pet_name"), F.col("species"), F.col("breed")).alias("label"),
        escape_html(F.when(F.col("id") % 3 != 0, F.concat(
            F.lit('<b title="'), F.coalesce("remarks", F.lit("&")), F.lit("\">it's &lt; "), F.coalesce("patient_name", F.lit(""))
        ))).alias("safe_remarks"),
        is_numeric_id(F.when(F.col("id") % 2 == 0, F.substring_index("age", " ", 1)).when(F.col("id") % 5 == 0, "").otherwise(F.col("age")))
        .alias("numeric_age"),
    )


@register("result_scalars", sql(f"""
    SELECT s.id, s.report_id, s.parameter_id, {number('s.value')} AS parsed,
           {low('t.reference_range_dog')} AS dog_min, {high('t.reference_range_dog')} AS dog_max,
           {out_of_range('s.value', 't.reference_range_dog')} AS dog_out,
           {first_text('trim(s.value)', default=' - ')} AS shown,
           {reference("'feline'", 't.')} AS cat_reference
    FROM lab_report_results s JOIN lab_test_parameters t ON t.id = s.parameter_id"""))
def _(lab: Lab):
    # ranges are parsed per parameter, before the results join
    dog, legacy = F.col("reference_range_dog"), F.col("reference_range")
    params = details.catalog_ranges(lab.params).select(
        F.col("id").alias("parameter_id"), parse_range(dog).alias("bounds"),
        reference_for(F.lit("feline"), dog, F.col("reference_range_cat"), legacy).alias("cat_reference"),
    )
    rows = lab.results.select(
        "id", "report_id", "parameter_id", parse_result(F.col("value")).alias("parsed"),
        display_value(F.col("value")).alias("shown"),
    )
    return rows.join(params, "parameter_id").select(
        "id", "report_id", "parameter_id", "parsed",
        F.col("bounds")["min"].alias("dog_min"), F.col("bounds")["max"].alias("dog_max"),
        outside(F.col("parsed"), F.col("bounds")).alias("dog_out"), "shown", "cat_reference",
    )


@register("catalog_scalars", """
    SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(upper(trim(' ' || p_name || ' (' || p_brand || ')')),
             '[^A-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS code,
           CASE p_partkey % 6 WHEN 0 THEN CAST(trunc(p_retailprice) AS INTEGER)
                WHEN 1 THEN -CAST(trunc(p_retailprice) AS INTEGER) WHEN 2 THEN 0
                WHEN 3 THEN 0 WHEN 4 THEN 77 ELSE 1200 END AS display_order,
           CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1
                WHEN 4 THEN 0 ELSE 1 END AS active
    FROM part""")
def _(lab: Lab):
    k, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    order = (
        F.when(k % 6 == 0, price).when(k % 6 == 1, F.concat(F.lit("-"), price))
        .when(k % 6 == 2, "").when(k % 6 == 3, None).when(k % 6 == 4, "12d").otherwise(" 1.2e3 ")
    )
    return lab.raw("part").select(
        "p_partkey",
        clean_code(F.concat(
            F.lit(" "), "p_name", F.lit(" ("), "p_brand", F.lit(")")
        )).alias("code"),
        to_order(order, 77).alias("display_order"), to_active(order, 1).alias("active"),
    )


@register("image_url", sql("""
    SELECT id, '/api/uploads/file/' || 'scan%20(' || doc_id || ')%2F' || lang || '*~%26.jpg' AS url
    FROM (SELECT doc_id + 1 AS id, doc_id, lang FROM documents)"""))
def _(lab: Lab):
    name = F.concat(
        F.lit("scan ("), text(F.col("doc_id")), F.lit(")/"), F.col("lang"), F.lit("*~&.jpg")
    )
    return lab.raw("documents").select(
        (F.col("doc_id") + 1).alias("id"), image_url(name).alias("url")
    )
