"""Golden rows of the column rules."""

import pytest
from pyspark.sql import functions as F

from assaybook import functions as fn
from assaybook.sources.images import image_manifest
from assaybook.operators.numbering import _last_number


def run(spark, rule, values, ddl="v STRING"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, {ddl}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


CASES = [
    ("normalize_species", fn.normalize_species, [
        (" CAT ", "Cat"), ("canine", "Dog"), (" Rabbit ", " Rabbit "), (None, ""), ("", ""),
        (" feline﻿", "Cat"), ("DOG", "Dog"),
    ]),
    ("parse_range", fn.parse_range, [
        ("6.0 - 17.0", (6.0, 17.0)), ("40–5", (5.0, 40.0)), ("5 to 9", (5.0, 9.0)),
        ("5 TO 9", (5.0, 9.0)), ("5--1", (-1.0, 5.0)), ("1,000 - 2,000", (0.0, 2.0)),
        ("—", None), ("<5", None), ("Not detected", None), ("", None), (None, None),
        ("about 1 - 2 x", (1.0, 2.0)), ("5to9", None), ("0.0 - 0.2", (0.0, 0.2)),
    ]),
    ("parse_result", fn.parse_result, [
        ("5.2", 5.2), ("<5", 5.0), ("1,200", 1.0), (".5", 5.0), ("1e3", 1.0), ("A-5", -5.0),
        ("N/A", None), ("-", None), ("—", None), ("", None), (None, None), (" 7 H", 7.0),
    ]),
    ("display_value", fn.display_value, [
        (" 5 ", "5"), ("", " - "), (None, " - "), ("  ", " - "), ("N/A", "N/A"),
    ]),
    ("digits_only", fn.digits_only, [("+92 300-1", "923001"), (None, ""), ("٣4", "4")]),
    ("is_phone_query", fn.is_phone_query, [("123456", False), ("0301 234", True), (None, False)]),
    ("clean_code", fn.clean_code, [
        (" t-4 (free) ", "T_4_FREE"), ("--", ""), (None, ""), ("__a__", "A"), ("a  b", "A_B"),
    ]),
    ("to_order", lambda c: fn.to_order(c, 42), [
        ("7.9", 7), ("-7.9", -7), ("", 0), (None, 0), ("x", 42), ("12d", 42), (" 3 ", 3),
        ("0x10", 16), ("1e2", 100), ("Infinity", 42), ("1e20", None), ("5.", 5), (".5", 0),
    ]),
    ("to_active", lambda c: fn.to_active(c, 7), [
        ("", 7), (None, 7), ("0", 0), ("2", 1), ("x", 0), ("-1", 1), ("0.0", 0), ("true", 1),
    ]),
    ("to_id", fn.to_id, [
        ("12", 12), (" 12 ", 12), ("0", None), ("x", None), (None, None), ("1e3", 1000),
        ("12d", None), ("1e300", None), ("", None),
    ]),
    ("is_numeric_id", fn.is_numeric_id, [
        ("12", True), ("12\n", False), ("-1", False), ("", False), (None, False),
    ]),
    ("safe_ext", fn.safe_ext, [
        ("A.JPG", ".jpg"), ("a.tiff", ".jpg"), (".png", ".jpg"), ("x/.png", ".jpg"),
        ("..png", ".png"), ("a.webp/", ".webp"), (None, ".jpg"), ("a.b.GIF", ".gif"),
        ("a.png\n", ".jpg"),
    ]),
    ("image_url", fn.image_url, [
        ("a b.jpg", "/api/uploads/file/a%20b.jpg"),
        ("a+b!'()*~.jpg", "/api/uploads/file/a%2Bb!'()*~.jpg"),
        ("é/x", "/api/uploads/file/%C3%A9%2Fx"),
    ]),
    ("escape_html", fn.escape_html, [
        ("<a href=\"x\">'&amp;", "&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;"), (None, ""),
    ]),
    ("fill_text", fn.fill_text, [(" x ", "x"), ("  ", None), (None, None)]),
    ("doc_subtitle", fn.doc_subtitle, [
        ("surgical_consent", "Surgical Consent Form"),
        ("TRAVEL_CERT", "Animal Health Certificate for Travel"),
        ("CBC", "Diagnostic Laboratory Report"), (None, "Diagnostic Laboratory Report"),
    ]),
    ("panel_kind", fn.panel_kind, [
        ("travel_cert", "document"), ("ULTRASOUND", "form"), ("Chemistry", "chemistry"),
        ("CBC", "table"), (None, "table"),
    ]),
    ("date_only", fn.date_only, [("2026-01-02T03:04", "2026-01-02"), (None, "-"), ("", "-")]),
    ("last_number", _last_number, [
        ("PZ-2026-0041", 41), ("PZ-2026-x", None), ("PZ-2026-12ab", 12), ("PZ-2026-", None),
    ]),
]


@pytest.mark.parametrize("rule,pairs", [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_rule(spark, rule, pairs):
    got = run(spark, rule, [p[0] for p in pairs])
    got = [tuple(g) if isinstance(g, tuple) else g for g in got]
    assert got == [p[1] for p in pairs]


def test_is_out_of_range(spark):
    rows = [
        ("17", "6.0 - 17.0", False), ("17.1", "6.0 - 17.0", True), ("5.9", "6.0 - 17.0", True),
        ("abc", "6.0 - 17.0", False), ("5", "—", False), (None, "1 - 2", False), ("5", None, False),
    ]
    df = spark.createDataFrame(rows, "v STRING, r STRING, want BOOLEAN")
    assert df.filter(fn.is_out_of_range(F.col("v"), F.col("r")) != F.col("want")).count() == 0


def test_reference_for(spark):
    rows = [
        ("Cat", "1 - 2", "", "3 - 4", "3 - 4"), ("feline", "1 - 2", "5 - 6", "3 - 4", "5 - 6"),
        ("Rabbit", "1 - 2", "5 - 6", "3 - 4", "1 - 2"), (None, None, "5 - 6", "3 - 4", "3 - 4"),
        ("Cat", "1 - 2", None, None, ""), ("Dog", "", "", "", ""),
    ]
    df = spark.createDataFrame(rows, "s STRING, d STRING, c STRING, l STRING, want STRING")
    got = fn.reference_for(F.col("s"), F.col("d"), F.col("c"), F.col("l"))
    assert df.filter(got != F.col("want")).count() == 0


def test_keys_and_labels(spark):
    df = spark.createDataFrame(
        [(7, "+92 1", "Ann", " Rex ", "Dog", "Pug"), (8, None, "Ann", "", None, ""),
         (9, "--", None, None, "", None)],
        "id BIGINT, phone STRING, name STRING, pet STRING, species STRING, breed STRING",
    ).orderBy("id")
    got = df.select(
        fn.owner_key(F.col("phone"), F.col("name")), fn.pet_key(F.col("pet"), F.col("id")),
        fn.pet_label(F.col("pet"), F.col("species"), F.col("breed")),
        fn.rebook_key(F.col("phone"), F.col("pet"), F.col("name")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("921", "rex", " Rex  (Dog)  -  Pug", "+92 1"),
        ("name:ann", "id-8", "Unnamed (N/A)", "Ann"),
        ("name:", "id-9", "Unnamed (N/A)", "--"),
    ]


@pytest.mark.parametrize("q,text,hit", [
    ("abc", "xABCx", True), ("a_c", "abc", True), ("a%c", "a--c", True), ("a\\_c", "abc", False),
    ("a\\_c", "a_c", True), ("a\\b", "ab", True), ("a\\\\b", "a\\b", True), ("x\\", "x%", True),
    ("x\\", "x", False), ("é", "É", True),
])
def test_like(spark, q, text, hit):
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.filter(fn.like_any(q, [F.col("t")])).count() == int(hit)


def test_like_accent_blind(spark):
    df = spark.createDataFrame([("José",), ("x%y",)], "t STRING")
    assert df.filter(fn.like_any("JOSE", [F.col("t")], accent_blind=True)).count() == 1
    assert df.filter(fn.like_any("jose", [F.col("t")])).count() == 0


@pytest.mark.parametrize("value,want", [
    (None, None), ("0", 0), (" 12 ", 12), ("999", 999), (7, 7), ("", None), (10**9, 10**9),
])
def test_list_limit(value, want):
    assert fn.list_limit(value) == want


@pytest.mark.parametrize("value", ["-3", "x", "12abc", 1.5, "²"])
def test_unusable_limit(value):
    with pytest.raises(ValueError):
        fn.list_limit(value)


def test_clean_ids(spark):
    got = run(spark, fn.clean_ids, [["1", "x", "0", None, " 2 "], [], None], "v ARRAY<STRING>")
    assert got == [[1, 2], [], None]


def test_report_date_parts(spark):
    df = spark.createDataFrame(
        [(1, "2026-02-03", "2026-01-02 00:05:00"), (2, "2026-02-03", None), (3, None, None)],
        "i INT, d STRING, c STRING",
    ).orderBy("i")
    parts = fn.report_date_parts(
        F.col("d").cast("date"), F.col("c").cast("timestamp_ntz"), F.lit("2026-03-05 14:07:09")
    )
    assert [r[0] for r in df.select(parts["full"]).collect()] == [
        "02 Jan 2026 · 12:05 am", "03 Feb 2026 · 02:07 pm", "05 Mar 2026 · 02:07 pm",
    ]


def test_ultrasound(spark):
    rows = [
        (1, ["urinary", "bogus", "other"], " x "), (2, ["other", "thoracic"], ""), (3, None, None),
        (4, [], "x"), (5, ["urinary", "urinary"], None),
    ]
    df = spark.createDataFrame(rows, "i INT, t ARRAY<STRING>, o STRING").orderBy("i")
    got = df.select(
        fn.ultrasound_labels(F.col("t"), F.col("o")), fn.ultrasound_heading(F.col("t"), F.col("o"))
    ).collect()
    assert [tuple(r) for r in got] == [
        (["Urinary Tract", "Other: x"], "Ultrasound - Urinary Tract / Other: x"),
        (["Other", "Thoracic"], "Ultrasound - Other / Thoracic"),
        ([], "Ultrasound"), ([], "Ultrasound"),
        (["Urinary Tract", "Urinary Tract"], "Ultrasound - Urinary Tract / Urinary Tract"),
    ]


def test_form_defaults(spark):
    df = spark.createDataFrame(
        [(1, '{"examined_by":"","x":"y"}'), (2, '{"examined_by":null}'), (3, "{bad"), (4, "{}")],
        "i INT, j STRING",
    ).orderBy("i")
    header = {"referring_vet": F.lit("Dr A")}
    got = [r[0] for r in df.select(
        fn.form_defaults("FNA_CYTOLOGY", header, fn.form_map(F.col("j")))
    ).collect()]
    assert [g["examined_by"] for g in got] == ["", None, "Dr A", "Dr A"]
    assert got[0]["x"] == "y" and got[0]["features"] == "[]" and got[0]["slides"] == ""


def test_image_manifest(spark):
    rows = [
        ("a.PNG", "IMAGE/png", 10), ("b", "image/svg+xml", 10), ("c.gif", "image/gif", 9 << 20),
        ("d.gif", None, 1), ("e.jpg", "image/jpeg\n", 1),
    ]
    df = spark.createDataFrame(rows, "original_name STRING, mime STRING, bytes BIGINT")
    assert image_manifest(df).filter("original_name = 'c.gif' and accepted").count() == 1
    got = {r.original_name: (r.accepted, r.reject_reason, r.safe_ext) for r in image_manifest(df, 8 << 20).collect()}
    assert got == {
        "a.PNG": (True, None, ".png"), "b": (False, "not_an_image", ".jpg"),
        "c.gif": (False, "too_large", ".gif"), "d.gif": (False, "not_an_image", ".gif"),
        "e.jpg": (False, "not_an_image", ".jpg"),
    }
