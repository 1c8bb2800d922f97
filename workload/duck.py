"""Building blocks of the DuckDB check queries: the lab views and the scalar rules as SQL text."""

from __future__ import annotations

import re

VIEWS = {
    "lab_users": """
        SELECT s_suppkey + 1 AS id, s_name AS name,
               concat(' U', s_suppkey, '@Lab.Example ') AS email,
               CASE WHEN s_suppkey % 10 = 0 THEN 'admin' ELSE 'staff' END AS role,
               CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 1 END AS is_active
        FROM supplier""",
    "lab_test_panels": """
        SELECT n AS id,
               CASE n WHEN 1 THEN 'CBC' WHEN 2 THEN 'LFT' WHEN 3 THEN 'ULTRASOUND'
                      WHEN 4 THEN 'SKIN_SCRAPING' WHEN 5 THEN 'SURGICAL_CONSENT'
                      ELSE 'PANEL_' || n END AS code,
               'Panel ' || n AS name, CAST(NULL AS VARCHAR) AS description,
               CAST((n * 7) % 5 AS INTEGER) AS display_order,
               CASE WHEN n % 6 = 0 THEN 0 ELSE 1 END AS is_active
        FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS BIGINT) AS n FROM part)""",
    "lab_test_parameters": """
        SELECT p_partkey + 1 AS id, CAST(substr(p_brand, 7) AS BIGINT) AS panel_id,
               'P' || p_partkey AS code, p_name AS name,
               CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS unit,
               CASE p_partkey % 6 WHEN 0 THEN p_size || ' - ' || (p_size + 20)
                    WHEN 1 THEN (p_size + 20) || '–' || p_size
                    WHEN 2 THEN p_size || ' to ' || (p_size + 10)
                    WHEN 3 THEN 'Not detected' WHEN 4 THEN '' END AS reference_range_dog,
               CASE p_partkey % 4 WHEN 0 THEN ''
                    WHEN 1 THEN p_size || '.5 - ' || (p_size + 15) || '.0'
                    WHEN 2 THEN NULL ELSE '0 - 10' END AS reference_range_cat,
               CASE WHEN p_partkey % 3 = 0 THEN '1 - 30' END AS reference_range,
               p_size % 7 AS display_order,
               CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS is_active
        FROM part""",
    "lab_reports": """
        SELECT o_orderkey + 1 AS id,
               'PZ-' || year(o_orderdate) || '-' || (o_orderkey + 1) AS report_no,
               CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS patient_name,
               CASE c_custkey % 5 WHEN 0 THEN '92300' || (c_custkey + 1000000)
                    WHEN 1 THEN '+92 300-' || (c_custkey + 999999)
                    WHEN 2 THEN '0301 ' || (c_custkey + 1000000) WHEN 3 THEN NULL
                    ELSE '' END AS owner_phone,
               CASE o_orderkey % 4 WHEN 0 THEN 'Rex' WHEN 1 THEN ' rex ' WHEN 2 THEN 'MILO'
                    ELSE '' END AS pet_name,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Dog' WHEN 'BUILDING' THEN 'canine'
                    WHEN 'FURNITURE' THEN ' CAT ' WHEN 'HOUSEHOLD' THEN 'feline'
                    ELSE 'Rabbit' END AS species,
               CASE WHEN c_custkey % 4 <> 0 THEN 'Breed ' || c_nationkey END AS breed,
               (o_orderkey % 15) || ' years' AS age,
               CASE o_orderkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS sex,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS referring_vet,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS sample_date,
               CAST(o_orderdate AS DATE) AS report_date,
               CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ''
                    ELSE 'note ' || o_orderpriority END AS clinical_notes,
               CASE o_orderkey % 4 WHEN 1 THEN '' WHEN 2 THEN NULL
                    ELSE o_orderpriority END AS remarks,
               CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'final' END AS status,
               CAST(c_nationkey + 1 AS BIGINT) AS created_by,
               CASE WHEN o_orderkey % 7 <> 0
                    THEN o_orderdate + to_seconds(o_orderkey % 86400) END AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "lab_report_results": """
        SELECT m + l_orderkey * 10 AS id, l_orderkey + 1 AS report_id,
               l_partkey + 1 AS parameter_id,
               CASE m % 6 WHEN 0 THEN NULL WHEN 1 THEN CAST(q AS VARCHAR)
                    WHEN 2 THEN q || '.5 H' WHEN 3 THEN 'N/A' WHEN 4 THEN '<' || q
                    ELSE '—' END AS value
        FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS m,
                     min(CAST(trunc(l_quantity) AS INTEGER)) AS q
              FROM lineitem GROUP BY l_orderkey, l_partkey)""",
    "lab_report_panels": """
        SELECT report_id * 100 + panel_id AS id, report_id, panel_id
        FROM (SELECT DISTINCT l_orderkey + 1 AS report_id,
                     CAST(substr(p_brand, 7) AS BIGINT) AS panel_id
              FROM lineitem JOIN part ON l_partkey = p_partkey)
        WHERE (report_id + panel_id) % 5 <> 0""",
    "lab_report_images": """
        SELECT doc_id + 1 AS id,
               CASE WHEN doc_id % 4 <> 0 THEN doc_id // 2 + 1 END AS report_id,
               'us-' || doc_id || '.jpg' AS stored_name,
               CASE WHEN doc_id % 3 <> 0 THEN 'scan ' || doc_id END AS original_name,
               doc_id % 20 + 1 AS created_by, CAST(n_chars % 3 AS INTEGER) AS display_order
        FROM documents""",
    "form_writes": """
        SELECT event_id AS seq, event_id // 14 + 1 AS report_id,
               CASE event_id % 3 WHEN 0 THEN 'SKIN_SCRAPING' WHEN 1 THEN 'ULTRASOUND'
                    ELSE 'BLOOD_PARASITE' END AS form_code,
               CASE WHEN event_id % 13 = 0 THEN '{bad'
                    WHEN event_id % 3 = 0 THEN '{"lesion_types":["alopecia","'
                         || CASE WHEN event_id % 2 = 0 THEN 'other' ELSE 'crusts' END
                         || '"],"lesion_other":"L' || user_id
                         || '","mites":["demodex","bogus"],"result":"'
                         || CASE WHEN event_id % 5 = 0 THEN 'positive' ELSE 'negative' END
                         || '","positive_for":"P' || user_id || '","sample_site":"site '
                         || user_id || '"}'
                    WHEN event_id % 3 = 1 THEN
                         '{"us_types":["urinary","other","bogus"],"us_type_other":" U' || user_id
                         || ' ","findings":" F' || user_id || ' ","impression":""}'
                    ELSE '{"parasites":["other","babesia"],"parasite_other":" X' || user_id
                         || ' ","result":["suspected"],"stain":"giemsa"'
                         || CASE WHEN event_id % 2 = 0 THEN ',"examined_by":""' ELSE '' END
                         || ',"comments":" C' || user_id || ' "}' END AS form_json,
               ts, user_id, event_type
        FROM events""",
    "lab_report_forms": """
        SELECT report_id * 10 + CASE form_code WHEN 'SKIN_SCRAPING' THEN 0
                    WHEN 'ULTRASOUND' THEN 1 ELSE 2 END AS id,
               report_id, form_code, arg_max(form_json, seq) AS form_json, max(ts) AS updated_at
        FROM form_writes GROUP BY report_id, form_code""",
    # One body per order; the child lists as columns: two panel ids, two results, two images.
    "bodies": """
        SELECT r.id - 1 AS seq, r.patient_name, r.owner_phone, r.pet_name, r.species, r.breed,
               r.age, r.sex, r.referring_vet,
               CASE WHEN (r.id - 1) % 41 = 0 THEN 'soon' ELSE CAST(r.sample_date AS VARCHAR) END
                   AS sample_date,
               CASE WHEN (r.id - 1) % 8 <> 0 THEN CAST(r.report_date AS VARCHAR) END AS report_date,
               r.clinical_notes, r.remarks, r.status,
               CASE WHEN o_orderkey % 50 = 2 THEN 'x'
                    WHEN o_orderkey % 50 = 3 THEN CAST(o_orderkey + 1000000000000 AS VARCHAR)
                    WHEN o_orderkey % 10 = 4 THEN CAST(o_orderkey AS VARCHAR)
                    ELSE CAST(o_orderkey + 1 AS VARCHAR) END AS report_id,
               o_orderkey % 20 <> 0 AS has_children, o_orderkey % 20 = 1 AS empty_children,
               o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0 AS has_images,
               o_orderkey % 25 + 1 AS panel_a, (o_orderkey * 7) % 25 + 1 AS panel_b,
               o_custkey % 100 + 1 AS param_a,
               CASE WHEN o_orderkey % 29 = 0 THEN 999999999999
                    ELSE o_custkey % 100 + o_orderkey % 30 + 1 END AS param_b,
               CAST(o_orderkey % 60 AS VARCHAR) AS value_a,
               CASE WHEN o_orderkey % 37 = 0 THEN 'r' END AS result_remarks,
               o_orderkey // 15 + 1 AS image_a, o_orderkey // 20 + 1 AS image_b,
               '{"findings":"n' || o_orderkey || '"}' AS us_json
        FROM lab_reports r JOIN orders ON o_orderkey = r.id - 1""",
}

NUM = r"-?[0-9]+(?:\.[0-9]+)?"


def nz(x: str) -> str:
    return f"nullif({x}, '')"


def first_text(*xs: str, default: str | None = None) -> str:
    tail = f", '{default}'" if default is not None else ""
    return f"coalesce({', '.join(nz(x) for x in xs)}{tail})"


def species(x: str) -> str:
    return (
        f"CASE WHEN lower(trim({x})) IN ('cat','feline') THEN 'Cat' "
        f"WHEN lower(trim({x})) IN ('dog','canine') THEN 'Dog' ELSE coalesce({x}, '') END"
    )


def reference(sp: str, p: str = "") -> str:
    return (
        f"CASE WHEN {species(sp)} = 'Cat' THEN "
        f"{first_text(f'{p}reference_range_cat', f'{p}reference_range', default='')} ELSE "
        f"{first_text(f'{p}reference_range_dog', f'{p}reference_range', default='')} END"
    )


def number(x: str) -> str:
    return f"TRY_CAST({nz(f'regexp_extract({x}, $${NUM}$$)')} AS DOUBLE)"


def bound(x: str, i: int) -> str:
    s = (
        f"regexp_replace(regexp_replace(coalesce({x}, ''), '[–—]', '-', 'g'), "
        rf"'(?i)\s+to\s+', '-', 'g')"
    )
    return f"TRY_CAST({nz(rf'regexp_extract({s}, $$({NUM})\s*-\s*({NUM})$$, {i})')} AS DOUBLE)"


def low(x: str) -> str:
    return f"least({bound(x, 1)}, {bound(x, 2)})"


def high(x: str) -> str:
    return f"greatest({bound(x, 1)}, {bound(x, 2)})"


def out_of_range(v: str, r: str) -> str:
    return f"coalesce({number(v)} < {low(r)} OR {number(v)} > {high(r)}, false)"


def owner_key(phone: str = "owner_phone", name: str = "patient_name") -> str:
    return (
        f"coalesce({nz(f'''regexp_replace(coalesce({phone}, ''), '[^0-9]', '', 'g')''')}, "
        f"'name:' || lower(coalesce({name}, '')))"
    )


def pet_key(name: str = "pet_name", report_id: str = "id") -> str:
    return f"coalesce({nz(f'lower(trim({name}))')}, 'id-' || {report_id})"


FORM_CODES = (
    "'SKIN_SCRAPING','ULTRASOUND','BLOOD_PARASITE','FNA_CYTOLOGY','SURGICAL_CONSENT','TRAVEL_CERT'"
)
DOC_CODES = "'SURGICAL_CONSENT','TRAVEL_CERT'"


def sql(body: str, **extra: str) -> str:
    """The query with a WITH clause of the views it uses, directly or through others."""
    named = {**VIEWS, **extra}
    used: list[str] = []

    def visit(text: str) -> None:
        for name, view in named.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(view)
                if name not in used:
                    used.append(name)

    visit(body)
    if not used:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({named[n]})" for n in used) + "\n" + body
