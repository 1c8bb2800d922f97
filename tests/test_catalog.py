from pyspark.sql import functions as F

from assaybook.operators import catalog, checks
from assaybook.operators.bundles import catalog_bundles
from assaybook.schemas import TABLES, empty_table
from assaybook.sources.catalog_seed import range_changes, seed_catalog


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def make_panels(spark, data):
    df = spark.createDataFrame(data, "id BIGINT, code STRING, name STRING, description STRING, display_order INT, is_active INT")
    return df.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))


def make_params(spark, data):
    return spark.createDataFrame(data, TABLES["lab_test_parameters"])


def test_seed_base_and_addons(spark, tmp_path):
    def seeded(step, *tables, addons=False):
        # stored between runs, as the scripts are
        out = []
        for name, df in zip(("panels", "params"), seed_catalog(spark, *tables, addons=addons)):
            df.coalesce(1).write.parquet(f"{tmp_path}/{step}/{name}")
            out.append(spark.read.schema(df.schema).parquet(f"{tmp_path}/{step}/{name}"))
        return out

    panels, params = seeded(1)
    assert panels.count() == 13 and params.count() == 54
    assert [r.code for r in panels.orderBy("id").collect()][:3] == ["CBC", "LFT", "RFT"]
    assert params.filter("reference_range <> reference_range_dog").count() == 0
    with_counts = {r.code: r.parameters for r in catalog.panel_parameter_counts(panels, params).collect()}
    assert with_counts["CBC"] == 13 and with_counts["CHEMISTRY"] == 0
    panels2, params2 = seeded(2, panels, params, addons=True)
    assert panels2.count() == 14 and params2.count() == 73
    skin = panels2.filter("code = 'SKIN_SCRAPING'").first()
    assert skin.description == "Tickable dermatology scraping report"
    off = params2.filter("is_active = 0")
    assert {r.panel_id for r in off.collect()} == {skin.id} and off.count() == 9
    # running everything again changes nothing
    panels3, params3 = seeded(3, panels2, params2, addons=True)
    cols = [c for c in panels2.columns if c != "created_at"]
    assert rows(panels3, *cols) == rows(panels2, *cols)
    assert rows(params3, *params2.columns) == rows(params2, *params2.columns)


def test_backfill_is_idempotent_and_ordered(spark):
    panels = make_panels(spark, [(1, "cbc", "x", None, 1, 1), (2, "OWN", "y", None, 2, 1)])
    params = make_params(spark, [
        (1, 1, "wbc", "W", "", "", None, "9 - 9", 1, 1), (2, 1, "ZZZ", "Z", "", None, None, "1 - 2", 1, 1),
        (3, 2, "WBC", "W", "", "", None, None, 1, 1), (4, 2, "A", "A", "", "5 - 6", "", "7 - 8", 1, 0),
    ])
    out = catalog.backfill_ranges(params, panels, range_changes(spark))
    want = [
        (1, "6.0 - 17.0", "5.5 - 19.5", "6.0 - 17.0"), (2, "1 - 2", None, "1 - 2"),
        (3, "", None, ""), (4, "5 - 6", "", "5 - 6"),
    ]
    cols = ("id", "reference_range_dog", "reference_range_cat", "reference_range")
    assert rows(out, *cols) == want
    assert rows(catalog.backfill_ranges(out, panels, range_changes(spark)), *cols) == want


def test_evolve_schema(spark):
    old = spark.createDataFrame([(1, 1, "A", "a", "", "1 - 2", 1, 1)],
        "id BIGINT, panel_id BIGINT, code STRING, name STRING, unit STRING, reference_range STRING, display_order INT, is_active INT")
    out = catalog.evolve_schema(old)
    assert out.columns == empty_table(spark, "lab_test_parameters").columns
    assert out.first().reference_range_dog is None


def test_create_panels(spark):
    panels = make_panels(spark, [(5, "CBC ", "x", None, 1, 1)])
    changes = spark.createDataFrame([
        (1, "cbc", "dup", "", "1"), (2, " t 4 ", " T4 ", " d ", "2.9"), (3, "T-4", "again", None, "3"),
        (4, "--", "no code", None, "1"), (5, "ok", " ", None, "1"), (6, "late", "Late", "", "x"),
        (7, "x" * 31, "long", None, "1"), (8, "BIG", "big", None, "9999999999"),
    ], "seq BIGINT, code STRING, name STRING, description STRING, display_order STRING")
    out, rejects = catalog.create_panels(panels, changes)
    assert rows(out, "id", "code", "name", "description", "display_order", "is_active") == [
        (5, "CBC ", "x", None, 1, 1), (6, "T_4", "T4", "d", 2, 1), (7, "LATE", "Late", None, 0, 1),
    ]
    assert rows(rejects, "seq", "reject_reason") == [
        (1, "code_exists"), (3, "code_exists"), (4, "code_and_name_required"),
        (5, "code_and_name_required"), (7, "too_long:code"), (8, "order_out_of_range"),
    ]


def test_create_parameters(spark):
    panels = make_panels(spark, [(1, "CBC", "x", None, 1, 1), (2, "LFT", "y", None, 1, 1)])
    params = make_params(spark, [(1, 1, "WBC", "W", None, None, None, None, 1, 1)])
    changes = spark.createDataFrame([
        (1, 1, "wbc", "dup", "", "", "", "1"), (2, 2, "wbc", "W", " u ", " 1 - 2 ", "", ""),
        (3, 9, "a", "a", "", "", "", "1"),
    ], "seq BIGINT, panel_id BIGINT, code STRING, name STRING, unit STRING, reference_range_dog STRING, reference_range_cat STRING, display_order STRING")
    out, rejects = catalog.create_parameters(params, panels, changes)
    new = out.filter("id = 2").first()
    assert (new.panel_id, new.code, new.unit, new.reference_range_dog, new.reference_range_cat,
            new.reference_range, new.display_order, new.is_active) == (2, "WBC", "u", "1 - 2", None, "1 - 2", 0, 1)
    assert rows(rejects, "seq", "reject_reason") == [(1, "code_exists"), (3, "panel_not_found")]


def test_patch(spark):
    params = make_params(spark, [
        (1, 1, "A", "a", "u", "1 - 2", "3 - 4", "old", 5, 1), (2, 1, "B", "b", "u", None, None, "old", 5, 1),
        (3, 1, "C", "c", "u", "1 - 2", None, "old", 5, 0),
    ])
    changes = spark.createDataFrame([
        (1, 1, {"name": " new ", "unit": ""}), (2, 1, {"unit": "x", "display_order": "zz"}),
        (3, 1, {"name": " ", "unit": "lost"}), (4, 1, {"is_active": "0", "display_order": None}),
        (5, 2, {"is_active": "", "reference_range_cat": " 7 - 8 "}), (6, 9, {"name": "x"}),
    ], "seq BIGINT, id BIGINT, fields MAP<STRING,STRING>")
    out, rejects = catalog.patch_parameters(params, changes)
    got = rows(out, "id", "name", "unit", "reference_range_dog", "reference_range_cat", "reference_range", "display_order", "is_active")
    assert got == [
        (1, "new", "x", "1 - 2", "3 - 4", "1 - 2", 0, 0),
        (2, "b", "u", None, "7 - 8", None, 5, 1),
        (3, "c", "u", "1 - 2", None, "old", 5, 0),
    ]
    assert rows(rejects, "seq", "reject_reason") == [(3, "name_required"), (6, "not_found")]


def test_seed_if_empty(spark):
    new = spark.createDataFrame([(1, "lab")], "id BIGINT, lab_name STRING")
    empty = empty_table(spark, "lab_settings")
    once = catalog.seed_if_empty(empty, new)
    assert once.count() == 1 and once.columns == empty.columns
    other = spark.createDataFrame([(2, "other")], "id BIGINT, lab_name STRING")
    assert rows(catalog.seed_if_empty(once, other), "lab_name") == [("lab",)]


def test_catalog_bundle_order(spark):
    panels = make_panels(spark, [(2, "A", "a", None, 1, 1), (1, "B", "b", None, 9, 1), (3, "C", "c", None, 0, 0)])
    params = make_params(spark, [
        (10 + i, 1, f"P{i}", f"p{i}", None, None, "", "1 - 2", 10 - i, 1) for i in range(5)
    ] + [(30, 2, "X", "x", None, None, None, None, 1, 0)])
    got = catalog_bundles(panels, params, True)
    assert rows(got.filter("panel_id = 2"), "parameter_id", "position") == [(None, None)]
    assert rows(got.filter("panel_id = 1"), "position", "parameter_id") == [(i, 14 - i) for i in range(5)]
    assert rows(got.filter("position = 0"), "parameter_reference_range_cat") == [("1 - 2",)] and got.filter("panel_id = 3").count() == 0


def test_unique_and_conflicts_ignore_case_accents_and_trailing_blanks(spark):
    df = spark.createDataFrame([("cbc",), ("CBC ",), ("cbç",), (" cbc",), ("x",)], "code STRING")
    assert rows(checks.unique_violations(df, ["code"]), "rows") == [(3,)]
    new = spark.createDataFrame([(1, "Cbc"), (2, "y"), (3, "Y ")], "seq BIGINT, code STRING")
    ok, bad = checks.code_conflicts(new, df, ["code"])
    assert rows(ok, "seq") == [(2,)] and rows(bad, "seq") == [(1,), (3,)]
