import pytest
from pyspark.sql import functions as F

from assaybook.operators import bundles, directory, drafts, forms, intake, lists, numbering
from assaybook.plans.print import page_plan, preview_lines, report_lines
from assaybook.schemas import TABLES, conform, empty_table
from assaybook.sources.catalog_seed import seed_catalog

DAY = "2026-03-05 10:00:00"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def lab(spark, tmp_path_factory):
    """The seeded catalog and three small reports, stored as they would be between jobs."""
    place = str(tmp_path_factory.mktemp("lab"))

    def stored(df, name):
        df.coalesce(1).write.parquet(f"{place}/{name}")
        return spark.read.schema(TABLES[name]).parquet(f"{place}/{name}")

    panels, params = seed_catalog(spark, addons=True)
    panels, params = stored(panels, "lab_test_panels"), stored(params, "lab_test_parameters")
    ids = {r.code: r.id for r in panels.collect()}
    tests = {(r.panel_id, r.code): r.id for r in params.collect()}
    reports = conform(spark.createDataFrame([
        (1, "PZ-2026-0001", "Ann", "0300-1234567", "Rex", "feline", "note", "rem", 1),
        (2, "PZ-2026-0002", "Ann", "0300 1234567", " REX ", "Dog", "", None, 9),
        (3, "PZ-2026-0007", "Bob", None, "", "Rabbit", "n", "r", None),
    ], "id BIGINT, report_no STRING, patient_name STRING, owner_phone STRING, pet_name STRING, species STRING, clinical_notes STRING, remarks STRING, created_by BIGINT"), "lab_reports")
    cbc, us = ids["CBC"], ids["ULTRASOUND"]
    report_panels = spark.createDataFrame(
        [(1, 1, cbc), (2, 1, us), (3, 2, cbc), (4, 2, ids["LFT"]), (5, 3, ids["TRAVEL_CERT"]), (6, 3, us)],
        TABLES["lab_report_panels"])
    results = spark.createDataFrame([
        (1, 1, tests[cbc, "WBC"], "19.6", None, None), (2, 1, tests[cbc, "RBC"], " 7 ", None, None),
        (3, 2, tests[cbc, "WBC"], "<5", None, None), (4, 2, tests[ids["GLUCOSE"], "GLU"], "1", None, None),
        (5, 2, tests[cbc, "BASO"], None, None, None),
    ], TABLES["lab_report_results"])
    images = spark.createDataFrame([
        (1, 1, "b c.png", None, None, 1, None), (2, 1, "a.png", "A", None, 0, None),
        (3, None, "c.png", None, None, 0, None),
    ], TABLES["lab_report_images"])
    saved = spark.createDataFrame([
        (1, 1, "ULTRASOUND", '{"us_types":["urinary"],"findings":" f "}', None), (2, 1, "X", "{bad", None),
    ], TABLES["lab_report_forms"])
    users = spark.createDataFrame([(1, "Dr U", " A@B ", "h", "admin", 1, None, None)], TABLES["lab_users"])
    tables = {
        "lab_users": users, "lab_test_panels": panels, "lab_test_parameters": params,
        "lab_reports": reports, "lab_report_panels": report_panels, "lab_report_results": results,
        "lab_report_images": images, "lab_report_forms": saved,
    }
    done = ("lab_test_panels", "lab_test_parameters")
    tables = {n: df if n in done else stored(df, n) for n, df in tables.items()}
    return tables, ids, tests


def test_report_lines(lab):
    tables, ids, _ = lab
    got = rows(report_lines(tables), "report_id", "parameter_name", "display_value", "unit", "reference", "result_out")
    assert got == [
        (1, "RBC (Red Blood Cells)", "7", "x10^12/L", "5.0 - 10.0", False),
        (1, "WBC (White Blood Cells)", "19.6", "x10^9/L", "5.5 - 19.5", True),
        (2, "Basophils", " - ", "%", "0 - 1", False),
        (2, "WBC (White Blood Cells)", "<5", "x10^9/L", "6.0 - 17.0", True),
    ]


def test_page_plan(lab):
    tables, ids, _ = lab
    got = rows(page_plan(tables), "report_id", "page", "pages", "code", "kind", "is_first", "is_last",
               "has_footer", "has_doctor_remarks", "has_remarks")
    assert got == [
        (1, 1, 2, "CBC", "table", True, False, True, False, False),
        (1, 2, 2, "ULTRASOUND", "form", False, True, True, False, True),
        (2, 1, 1, "CBC", "table", True, True, True, False, False),
        (3, 1, 2, "ULTRASOUND", "form", True, False, True, False, False),
        (3, 2, 2, "TRAVEL_CERT", "document", False, True, False, False, False),
    ]
    empty = {**tables, "lab_report_panels": tables["lab_report_panels"].limit(0)}
    assert rows(page_plan(empty), "report_id", "kind", "has_doctor_remarks") == [
        (1, "placeholder", True), (2, "placeholder", False), (3, "placeholder", True),
    ]


def test_bundles(lab):
    tables, ids, tests = lab
    b = bundles.report_bundles(tables)
    cbc, us = ids["CBC"], ids["ULTRASOUND"]
    assert rows(b["reports"], "report_id", "species", "created_by_name") == [(1, "Cat", "Dr U"), (2, "Dog", None), (3, "Rabbit", None)]
    assert rows(b["panels"].filter("report_id = 1"), "position", "panel_id", "code") == [(0, cbc, "CBC"), (1, us, "ULTRASOUND")]
    got = rows(b["results"].filter("report_id = 1"), "panel_id", "position", "code", "reference_range")
    assert [x[:3] for x in got] == [(cbc, 0, "WBC"), (cbc, 1, "RBC")] and got[0][3] == "5.5 - 19.5"
    assert [x[1] for x in rows(b["images"].filter("report_id = 1"), "position", "url")] == ["/api/uploads/file/a.png", "/api/uploads/file/b%20c.png"]
    assert {r.form_code: r.fields for r in b["forms"].filter("report_id = 1").collect()} == {"ULTRASOUND": {"us_types": '["urinary"]', "findings": " f "}, "X": {}}
    # the glucose result has no selected panel
    assert rows(b["results"].filter("report_id = 2"), "position", "code") == [(0, "WBC"), (1, "BASO")]
    one = bundles.report_bundles(tables, tables["lab_reports"].filter("report_no = 'PZ-2026-0002'"))
    assert {name: {r.report_id for r in df.collect()} for name, df in one.items()} == {"reports": {2}, "panels": {2}, "results": {2}, "images": set(), "forms": set()}


def test_large_draft_round_trip(spark):
    n = 12_000
    params = spark.range(1, n + 1).selectExpr("id", "id % 7 + 1 AS panel_id", "string(id) AS code", "string(id) AS name", "int(id % 5) AS display_order", "1 AS is_active")
    empty = {t: empty_table(spark, t) for t in TABLES}
    tables = {
        **empty, "lab_test_parameters": conform(params, "lab_test_parameters"),
        "lab_test_panels": conform(spark.range(1, 8).selectExpr("id", "string(id) AS code", "'p' AS name", "1 AS display_order", "1 AS is_active"), "lab_test_panels"),
        "lab_reports": conform(spark.createDataFrame([(1, "PZ-2026-0001", "Ann", "Rex", "Cat")], "id BIGINT, report_no STRING, patient_name STRING, pet_name STRING, species STRING"), "lab_reports"),
        "lab_report_panels": spark.range(1, 8).selectExpr("id", "1L AS report_id", "id AS panel_id"),
        "lab_report_results": conform(spark.range(1, n + 1).selectExpr("id", "1L AS report_id", "id AS parameter_id", "string(id % 100) AS value"), "lab_report_results"),
    }
    d = bundles.report_drafts(tables, F.lit(DAY))
    assert d["drafts"].count() == 1 and d["values"].count() == n
    values = d["values"].agg(F.collect_list(F.struct(
        F.col("parameter_id").cast("string").alias("parameter_id"), "value", F.lit(None).cast("string").alias("flag"), F.lit(None).cast("string").alias("remarks"))).alias("results"))
    body = d["drafts"].select(F.lit(1).cast("bigint").alias("seq"), F.col("editId").cast("string").alias("report_id"), "patient_name", "pet_name", "species", *[F.lit(None).cast("array<string>").alias(c) for c in ("panel_ids", "image_ids")]).join(values, how="cross")
    out, rejects = intake.apply_updates(tables, full_body(body), DAY)
    assert rejects.count() == 0
    again = bundles.report_drafts(out, F.lit(DAY))
    assert rows(again["values"], "panel_id", "position", "parameter_id", "value") == rows(d["values"], "panel_id", "position", "parameter_id", "value")


def test_drafts_round_trip(spark, lab):
    tables, ids, tests = lab
    d = bundles.report_drafts(tables, F.lit(DAY))
    values = {(r.editId, r.parameter_id): r.value for r in d["values"].collect()}
    assert {k: v for k, v in values.items() if k[0] == 2} == {(2, tests[ids["CBC"], "WBC"]): "<5", (2, tests[ids["CBC"], "BASO"]): ""}
    assert rows(d["panels"].filter("editId = 1"), "position", "panel_id") == [(0, ids["CBC"]), (1, ids["ULTRASOUND"])]
    heads = {r.editId: r for r in d["drafts"].collect()}
    assert heads[1].sample_date == "2026-03-05" and heads[3].owner_phone == "" and heads[3].status == "final"
    # saving the draft of report 1 again gives the same lines
    body = spark.createDataFrame(
        [(1, "1", "Ann", "Rex", "Cat", [str(ids["CBC"]), str(ids["ULTRASOUND"])],
          [(str(k[1]), v, None, None) for k, v in values.items() if k[0] == 1], ["2", "1"])],
        "seq BIGINT, report_id STRING, patient_name STRING, pet_name STRING, species STRING, panel_ids ARRAY<STRING>, "
        "results ARRAY<STRUCT<parameter_id: STRING, value: STRING, flag: STRING, remarks: STRING>>, image_ids ARRAY<STRING>")
    out, rejects = intake.apply_updates(tables, full_body(body), DAY)
    assert rejects.count() == 0
    cols = ("report_id", "parameter_name", "display_value", "result_out")
    assert rows(report_lines(out), *cols) == rows(report_lines(tables), *cols)


def full_body(df):
    for c in ("owner_phone", "breed", "age", "sex", "referring_vet", "sample_date", "report_date",
              "clinical_notes", "remarks", "status"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    if "forms" not in df.columns:
        df = df.withColumn("forms", F.lit(None).cast("map<string,string>"))
    return df


RESULTS = "ARRAY<STRUCT<parameter_id: STRING, value: STRING, flag: STRING, remarks: STRING>>"
BODY = (
    "seq BIGINT, patient_name STRING, pet_name STRING, species STRING, status STRING, panel_ids ARRAY<STRING>, "
    f"results {RESULTS}, image_ids ARRAY<STRING>, forms MAP<STRING,STRING>, sample_date STRING"
)


def test_apply_creates(spark, lab):
    tables, ids, tests = lab
    cbc, wbc = str(ids["CBC"]), str(tests[ids["CBC"], "WBC"])
    ok = [(wbc, "5", "", None), ("", "skipped", None, None)]
    bodies = full_body(spark.createDataFrame([
        (1, " Zed ", " Kit ", "CAT", "draft", [cbc, "x"], ok, ["3", "1"], {"ULTRASOUND": "{}", "": "1", "N": None}, ""),
        (2, "A", "B", "Fish", None, [cbc], ok, None, None, None),
        (3, "", "B", "Dog", None, [cbc], ok, None, None, None),
        (4, "A", "B", "Dog", None, ["x"], ok, None, None, None),
        (5, "A", "B", "Dog", None, [cbc, cbc], ok, None, None, None),
        (6, "A", "B", "Dog", None, ["999"], ok, None, None, None),
        (7, "A", "B", "Dog", None, [cbc], [("888", "1", None, None)], None, None, None),
        (8, "A", "B", "Dog", None, [cbc], [(wbc, "1", None, None), (wbc, "2", None, None)], None, None, None),
        (9, "A" * 151, "B", "Dog", None, [cbc], None, None, None, None),
        (10, "A", "B", "Dog", None, [cbc], None, None, None, "31-31-2020"),
        (11, "A", "B", "Dog", None, [cbc], [("q", "1", None, None)], None, None, None),
        (12, "A", "B", "canine", "other", [cbc], None, ["3"], {}, "2026-01-02"),
    ], BODY))
    out, rejects = intake.apply_creates(tables, bodies, DAY, 5)
    assert rows(rejects, "seq", "reject_reason") == sorted([
        (2, "species_required"), (3, "names_required"), (4, "panel_required"), (5, "duplicate_panel"),
        (6, "unknown_panel"), (7, "unknown_parameter"), (8, "duplicate_parameter"),
        (9, "too_long:patient_name"), (10, "bad_date:sample_date"), (11, "bad_parameter_id"),
    ], key=repr)
    new = rows(out["lab_reports"].filter("id > 3"), "id", "report_no", "patient_name", "pet_name",
               "species", "status", F.col("report_date").cast("string"), "created_by")
    assert new == [
        (4, "PZ-2026-0008", "Zed", "Kit", "Cat", "draft", "2026-03-05", 5),
        (5, "PZ-2026-0009", "A", "B", "Dog", "final", "2026-03-05", 5),
    ]
    assert rows(out["lab_report_panels"].filter("report_id > 3"), "id", "report_id", "panel_id") == [
        (7, 4, int(cbc)), (8, 5, int(cbc))]
    assert rows(out["lab_report_results"].filter("report_id > 3"), "id", "report_id", "value", "flag") == [(6, 4, "5", None)]
    assert rows(out["lab_report_forms"].filter("report_id > 3"), "report_id", "form_code", "form_json") == [
        (4, "N", "{}"), (4, "ULTRASOUND", "{}")]
    # image 3 was free and goes to the first body; image 1 belongs to report 1
    assert rows(out["lab_report_images"], "id", "report_id", "display_order") == [(1, 1, 1), (2, 1, 0), (3, 4, 0)]


def test_apply_updates(spark, lab):
    tables, ids, tests = lab
    lft, alt = str(ids["LFT"]), str(tests[ids["LFT"], "ALT"])
    ddl = "report_id STRING, " + BODY
    bodies = full_body(spark.createDataFrame([
        ("1", 1, "New", "P", "dog", None, [lft], [(alt, "1", None, None)], None, None, None),
        ("1", 2, "Newer", " P ", "dog", None, None, [], ["3"], {}, None),
        ("2", 3, "X", "Y", "cat", None, [], None, ["1", "2", "1"], {"A" * 40: "[1]"}, None),
        ("77", 4, "X", "Y", "cat", None, None, None, None, None, None),
        ("z", 5, "X", "Y", "cat", None, None, None, None, None, None),
        ("3", 6, None, "Y", "cat", None, None, None, None, None, None),
        ("3", 7, "", "Y", "rat", None, None, None, None, None, None),
        ("3", 8, "", "", "cat", None, None, None, None, None, None),
    ], ddl))
    out, rejects = intake.apply_updates(tables, bodies, DAY)
    assert rows(rejects, "seq", "reject_reason") == [
        (4, "report_not_found"), (5, "bad_report_id"), (6, "null:patient_name"), (7, "species_required")]
    assert rows(out["lab_reports"], "id", "report_no", "patient_name", "pet_name", "species", "remarks") == [
        (1, "PZ-2026-0001", "Newer", " P ", "Dog", None), (2, "PZ-2026-0002", "X", "Y", "Cat", None),
        (3, "PZ-2026-0007", "", "", "Cat", None)]
    assert rows(out["lab_report_panels"], "report_id", "panel_id") == sorted([
        (1, int(lft)), (3, ids["TRAVEL_CERT"]), (3, ids["ULTRASOUND"])], key=repr)
    assert rows(out["lab_report_results"], "report_id", "parameter_id")[0][0] == 2
    assert out["lab_report_results"].filter("report_id = 1").count() == 0
    # body 2 frees 1 and 2 and takes 3; body 3 takes 1 (last place) and 2
    assert rows(out["lab_report_images"], "id", "report_id", "display_order") == [(1, 2, 2), (2, 2, 1), (3, 1, 0)]
    assert rows(out["lab_report_forms"], "report_id", "form_code", "form_json") == [(2, "A" * 40, "[1]")]


def test_attach_update_later_body_frees(spark):
    images = spark.createDataFrame([(1, 7, "a", None, None, 3, None), (2, None, "b", None, None, 4, None)], TABLES["lab_report_images"])
    ask = spark.createDataFrame([(1, 7, [1, 2]), (2, 7, [2])], "seq BIGINT, report_id BIGINT, image_ids ARRAY<BIGINT>")
    assert rows(intake.attach_images(images, ask, "update"), "id", "report_id", "display_order") == [(1, None, 0), (2, 7, 0)]


def test_deletes(spark, lab):
    tables, ids, tests = lab
    gone = spark.createDataFrame([(1,)], "report_id BIGINT")
    out = intake.delete_reports(tables, gone)
    assert [out[t].count() for t in ("lab_reports", "lab_report_panels", "lab_report_results", "lab_report_images", "lab_report_forms")] == [2, 4, 3, 1, 0]
    cbc = spark.createDataFrame([(ids["CBC"],)], "panel_id BIGINT")
    out = intake.delete_panels_cascade(tables, cbc)
    assert out["lab_test_parameters"].count() == 60 and out["lab_report_results"].count() == 1
    users = spark.createDataFrame([(1,)], "user_id BIGINT")
    out = intake.null_deleted_users(tables, users)
    assert rows(out["lab_reports"], "id", "created_by") == [(1, None), (2, 9), (3, None)]
    assert out["lab_users"].count() == 0


def test_numbering(spark):
    old = conform(spark.createDataFrame([
        (1, "PZ-2026-0050"), (2, "PZ-2026-0041"), (3, "PZ-2025-9999"), (4, "PZ-2024-x"),
    ], "id BIGINT, report_no STRING"), "lab_reports")
    new = spark.createDataFrame([(i * 3, y) for i, y in enumerate([2026, 2025, 2026, 2024, 2023, 2026])], "seq BIGINT, y INT")
    want = ["PZ-2026-0042", "PZ-2025-10000", "PZ-2026-0043", "PZ-2024-0001", "PZ-2023-0001", "PZ-2026-0044"]
    for bits in (0, 2, 20):
        got = numbering.assign_report_no(new, old, "y", bits=bits).orderBy("seq").collect()
        assert [r.report_no for r in got] == want
    one = numbering.assign_report_no(new.repartition(5), old, 2026, bits=1).orderBy("seq").collect()
    assert [r.report_no for r in one] == [f"PZ-2026-{n:04d}" for n in range(42, 48)]
    none = numbering.assign_report_no(new.limit(1), old.limit(0), 2026).collect()
    assert none[0].report_no == "PZ-2026-0001"


def test_running_totals_match_plain_window(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("seq"), (F.col("id") % 3).alias("g"), (F.col("id") % 5).alias("v"))
    got = numbering.running_totals(df, ["seq"], {"t": F.col("v")}, ["g"], bits=4)
    from pyspark.sql import Window
    w = Window.partitionBy("g").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("t", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert rows(got, "seq", "g", "t") == rows(want, "seq", "g", "t")


def test_directory_and_search(lab):
    tables, _, _ = lab
    r = tables["lab_reports"]
    assert rows(directory.owner_directory(r), "owner_key", "patient_name", "owner_phone", "reports") == [
        ("03001234567", "Ann", "0300 1234567", 2), ("name:bob", "Bob", "", 1)]
    pets = rows(directory.pet_directory(r), "owner_key", "pet_key", "pet_name", "species", "last_report_id")
    assert pets == [("03001234567", "rex", " REX ", "Dog", 2), ("name:bob", "id-3", "", "Rabbit", 3)]
    # stored separators hide a phone from a digit search
    assert directory.patient_search(r, "03001234567").count() == 0
    assert rows(directory.patient_search(r, "ann", limit=9), "last_report_id", "pet_name", "owner_phone") == [(2, " REX ", "0300 1234567")]
    assert directory.patient_search(r, "  ").count() == 0
    assert rows(directory.search_owners(r, "b"), "owner_key", "pets") == [("name:bob", 1)]
    assert directory.search_mode(" 0300-123 ") == {"query": "0300-123", "phone": "0300123", "is_phone_search": True}


def test_lists(lab):
    tables, _, _ = lab
    r = tables["lab_reports"]
    assert [x.id for x in lists.report_list(r, "ann").collect()] == [2, 1]
    assert [x.id for x in lists.report_list(r, limit="1").collect()] == [3]
    batch = lists.report_list_batch(r, ["ann", "", "zz"] * 30, 2)
    assert batch.filter("query_no = 0").count() == 2 and batch.filter("query_no = 89").count() == 0
    assert rows(batch.filter("query_no = 88"), "id", "position") == [(2, 2), (3, 1)]
    assert rows(lists.reports_by_no(r, ["PZ-2026-0007"]), "id") == [(3,)]
    assert rows(lists.active_users(tables["lab_users"]), "email") == [("a@b",)]


def test_drafts(spark, lab):
    tables, ids, tests = lab
    d = spark.createDataFrame([
        (1, [1, 2, 3], [1], [1, 2]), (2, [1, 2, 3], None, [1]), (3, [1, 2, 3], [], []), (4, [1, 2], [2], None),
    ], "i INT, all_ids ARRAY<BIGINT>, included_parameter_ids ARRAY<BIGINT>, parameter_ids_snapshot ARRAY<BIGINT>")
    assert rows(drafts.included_parameters(d), "i", "included_ids") == [
        (1, [1, 3]), (2, [1, 2, 3]), (3, [1, 2, 3]), (4, [1, 2])]
    d = spark.createDataFrame([
        (1, ["2", "1"], {"1": "a", "9": "z"}), (2, None, {"10": "b", "9": None, "x": "q"}), (3, [], None),
    ], "i INT, included_parameter_ids ARRAY<STRING>, results MAP<STRING,STRING>")
    got = {r.i: [(x.parameter_id, x.value) for x in r.payload_results or []] for r in drafts.draft_payload_results(d).collect()}
    assert got == {1: [(2, ""), (1, "a")], 2: [(9, ""), (10, "b")], 3: []}
    d = spark.createDataFrame([
        (1, "A", "B", "cat", ["1"]), (2, "A", "B", "cat", []), (3, "A", "", "cat", ["1"]), (4, "A", "B", "cow", ["1"]), (5, "A", "B", "Dog", None),
    ], "i INT, patient_name STRING, pet_name STRING, species STRING, panel_ids ARRAY<STRING>")
    assert rows(drafts.draft_stage(d), "i", "stage") == [(1, "results"), (2, "tests"), (3, "patient"), (4, "patient"), (5, "tests")]


def test_preview(spark, lab):
    tables, ids, tests = lab
    cbc = ids["CBC"]
    wbc, rbc = tests[cbc, "WBC"], tests[cbc, "RBC"]
    d = spark.createDataFrame([
        (1, "Cat", {str(wbc): "30"}, [str(wbc)], [str(p) for (c, _), p in tests.items() if c == cbc and p != rbc],
         [str(cbc), str(ids["ULTRASOUND"]), "999"]),
    ], "draft_id INT, species STRING, results MAP<STRING,STRING>, included_parameter_ids ARRAY<STRING>, parameter_ids_snapshot ARRAY<STRING>, panel_ids ARRAY<STRING>")
    got = rows(preview_lines(d, tables["lab_test_panels"], tables["lab_test_parameters"]), "parameter_id", "display_value", "reference", "result_out")
    assert got == sorted([(wbc, "30", "5.5 - 19.5", True), (rbc, " - ", "5.0 - 10.0", False)], key=repr)


def test_forms(spark, lab):
    tables, ids, _ = lab
    f = spark.createDataFrame([
        (1, 1, "SKIN_SCRAPING", '{"mites":["demodex","demodex","other"],"mites_other":" m ","result":["negative"],"yeast":"malassezia"}', None),
        (2, 1, "BLOOD_PARASITE", '{"result":["negative"],"stain":["other"],"stain_other":" s "}', None),
        (3, 2, "SURGICAL_CONSENT", '{"emergency":"yes","vet_name":"","cnic":5}', None),
        (4, 2, "skin_scraping", '{"mites":["demodex"]}', None), (5, 3, "ULTRASOUND", "[1]", None),
    ], TABLES["lab_report_forms"])
    assert rows(forms.form_findings(f), "report_id", "field", "code", "free_text") == [
        (1, "mites", "demodex", None), (1, "mites", "other", " m "), (1, "result", "negative", None),
        (1, "stain", "other", "s"), (2, "emergency", "yes", None)]
    fields = {(r.report_id, r.field): r.value for r in forms.form_fields(f, tables["lab_reports"], DAY).collect() if r.form_code == "SURGICAL_CONSENT"}
    assert fields[2, "vet_name"] is None and fields[2, "cnic"] == "5" and fields[2, "owner_name"] == "Ann"
    assert fields[2, "date_of_surgery"] == "2026-03-05" and fields[2, "animal_name"] == "REX"
    us = rows(forms.ultrasound_sections(tables["lab_report_forms"], tables["lab_report_images"]), "kind", "ord", "title", "text")
    assert ("heading", 0, "Ultrasound - Urinary Tract", None) in us and ("field", 2, "Ultrasound Findings", "f") in us
    assert [u for u in us if u[0] == "image"] == [
        ("image", 0, "A", "/api/uploads/file/a.png"), ("image", 1, "Ultrasound", "/api/uploads/file/b%20c.png")]


def test_upsert_forms_is_idempotent(spark):
    base = spark.createDataFrame([(4, 1, "A", "old", None), (5, 2, "A", "keep", None)], TABLES["lab_report_forms"])
    w = spark.createDataFrame([(1, 1, "a ", "x"), (2, 1, "A", None), (3, 3, "B", "y"), (4, 3, "", "z"), (5, 3, None, "z")],
                              "seq BIGINT, report_id BIGINT, form_code STRING, form_json STRING")
    once = forms.upsert_forms(base, w)
    want = [(4, 1, "A", "{}"), (5, 2, "A", "keep"), (6, 3, "B", "y")]
    cols = ("id", "report_id", "form_code", "form_json")
    assert rows(once, *cols) == want
    assert rows(forms.upsert_forms(once, w), *cols) == want
    touched = spark.createDataFrame([(2,), (3,)], "report_id BIGINT")
    assert rows(forms.replace_forms(base, w.filter("report_id = 3"), touched), "report_id", "form_code") == [(1, "A"), (3, "B")]


def test_missing_optional_tables(spark, lab, tmp_path):
    from assaybook.sources.tables import load_tables
    tables, _, _ = lab
    for name in ("lab_users", "lab_reports"):
        tables[name].write.parquet(str(tmp_path / name))
    loaded = load_tables(spark, str(tmp_path))
    assert loaded["lab_report_forms"].count() == 0 and loaded["lab_reports"].count() == 3
    with pytest.raises(Exception):
        loaded["lab_report_panels"].count()
    assert empty_table(spark, "lab_report_forms").columns == loaded["lab_report_forms"].columns


def test_preview_lines_are_dealt(spark):
    """A panel that many drafts pick isn't one task's work; every draft meets each parameter once."""
    panels = spark.createDataFrame([(1, "CBC", "Blood", None, 1, 1, None)], TABLES["lab_test_panels"])
    params = spark.range(1, 41).select(
        "id", F.lit(1).cast("bigint").alias("panel_id"), F.concat(F.lit("P"), "id").alias("code"), F.lit("n").alias("name"), F.lit("").alias("unit"),
        F.lit("1 - 5").alias("reference_range_dog"), F.lit("").alias("reference_range_cat"), F.lit("2 - 3").alias("reference_range"),
        F.lit(0).alias("display_order"), F.lit(1).alias("is_active"),
    )
    drafts = spark.range(500).select(
        F.col("id").alias("draft_id"), F.when(F.col("id") % 2 == 0, "cat").otherwise("dog").alias("species"),
        F.array(F.lit("1"), F.lit(" 1")).alias("panel_ids"), F.lit(None).cast("array<string>").alias("included_parameter_ids"),
        F.lit(None).cast("array<string>").alias("parameter_ids_snapshot"), F.create_map(F.lit("7"), F.lit("4")).alias("results"),
    )
    lines = preview_lines(drafts, panels.coalesce(1), params.coalesce(1))
    parts = lines.groupBy(F.spark_partition_id()).count().count()
    got = lines.agg(F.count("*"), F.countDistinct("draft_id", "parameter_id"), F.sum(F.col("result_out").cast("int"))).first()
    assert tuple(got) == (20000, 20000, 250) and parts > 1


def test_checked_bodies_travel_once(spark, sf):
    """With a store the few faulty bodies are known first, and whole bodies meet them where they are read."""
    from assaybook.session import stored
    from workload.labviews import AS_OF, Lab

    lab = Lab(spark, sf)
    for accept in (intake.accept_creates, intake.accept_updates):
        good, rejects = accept(lab.tables, lab.payloads, AS_OF)
        kept, refused = accept(lab.tables, lab.payloads, AS_OF, store=stored)
        assert rows(refused, "seq", "reject_reason") == rows(rejects, "seq", "reject_reason")
        assert rows(kept, "seq", "report_id", "_panels", "_forms") == rows(good, "seq", "report_id", "_panels", "_forms")
        assert "hashpartitioning(seq" not in kept._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_read_once(spark, sf):
    from assaybook.session import stored
    from workload.labviews import AS_OF, Lab

    lab, frames = Lab(spark, sf), {}

    def keep(df, name):
        frames[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    for accept in (intake.accept_creates, intake.accept_updates):
        kept, _ = accept(lab.tables, lab.payloads, AS_OF, store=keep)
        # after the first look at the bodies only the stored ones are read
        assert "read-" in frames["missing-parents"] and "customer.parquet" not in frames["missing-parents"]
