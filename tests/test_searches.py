"""Searches as rows, cuts by value: against plain loops."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaybook.functions.text import digits_only, like_any, like_pattern, owner_key, pet_key
from assaybook.operators.lists import report_list, report_list_batch
from assaybook.operators.newest import kth_largest, newest_rows
from assaybook.operators.searches import SIZES, matches, patient_searches, pattern_column, prepare, report_list_searches, text_places
from assaybook.schemas import conform
from workload.labviews import Lab

ALPHABET = "abAB%_\\ é\n1"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def like(pattern, text):
    """What LIKE does, written out."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        i += 1
    return text is not None and re.fullmatch(out, text, re.S) is not None


def test_matches_equal_all_pairs(spark):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most)))
    texts = [(i, word(9) if i % 7 else None, word(5) if i % 5 else None) for i in range(150)]
    queries = [(i, word(5) if i % 31 else None) for i in range(250)] + [(900, "%"), (901, "___"), (902, ""), (903, "a\\"), (904, "\\\\"), (905, "%%__%")]
    df = spark.createDataFrame(texts, "id long, a string, b string")
    found = matches(df, spark.createDataFrame(queries, "query_no int, q string"), ["a", "b"])
    want = set()
    for n, q in queries:
        q = (q or "").strip(" \n")
        want |= {(n, i) for i, *cols in texts if q == "" or any(like(like_pattern(q), c and c.lower()) for c in cols)}
    got = [(r.query_no, r.id) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found) and "Python" not in plan(found)


def test_patterns_of_a_column(spark):
    qs = ["a", "%", "\\", "\\%", "\\\\", "a\\b\\", "\\_\\x", "A_é"]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert [r[0] for r in df.select(pattern_column(F.col("q"))).collect()] == [like_pattern(q) for q in qs]


def test_grams_of_a_search(spark):
    rows = {r.query_no: r for r in prepare(spark.createDataFrame([(1, "abcd%xy"), (2, "ab_c"), (3, "a"), (4, " _% "), (5, "a\\%b")], "query_no int, q string")).collect()}
    assert sorted(rows[1].grams) == ["abc", "bcd"] and rows[2].grams == ["ab"] and rows[3].grams == ["a"]
    assert rows[4].grams == [] and rows[4].least_length == 1 and sorted(rows[5].grams) == ["a%b"]


def test_five_thousand_searches_equal_single_ones(spark, sf):
    lab = Lab(spark, sf)
    reports = lab.reports
    names = [r[0] for r in reports.select("patient_name").distinct().collect() if r[0]]
    queries = [f"{names[i % len(names)][: 8 + i % 12]}{'' if i % 3 else i % 10}" for i in range(4990)] + ["Rex", "9230010", "", "pz-1997-", "no", "%", "_1", "M", "#0%7", "z\\9"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_no int, q string")
    got = report_list_searches(reports, asked)
    counts = {r.query_no: (r.n, r.s) for r in got.groupBy("query_no").agg(F.count("*").alias("n"), F.sum("id").alias("s")).collect()}
    for i in [*range(0, 4990, 499), *range(4990, 5000)]:
        want = report_list(reports, queries[i]).agg(F.count("*").alias("n"), F.sum("id").alias("s")).first()
        assert counts.get(i, (0, None)) == (want.n, want.s), queries[i]
    last = queries[4990:]
    old = report_list_batch(reports, last, 7).select("query_no", "id", "position").collect()
    new = report_list_searches(reports, spark.createDataFrame(list(enumerate(last)), "query_no int, q string"), 7).select("query_no", "id", "position").collect()
    assert sorted(map(tuple, old)) == sorted(map(tuple, new))


def test_hot_text_and_no_rows(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"other {i}") for i in range(3000)], "id long, a string")
    asked = spark.createDataFrame([(1, "same"), (2, "r 27"), (3, "me te")], "query_no int, q string")
    assert sorted((r.query_no, r.n) for r in matches(df, asked, ["a"]).groupBy("query_no").agg(F.count("*").alias("n")).collect()) == [(1, 2000), (2, 39), (3, 2000)]
    assert matches(df.limit(0), asked, ["a"]).count() == 0 and matches(df, asked.limit(0), ["a"]).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.one_of(st.integers(-5, 5), st.integers(-(2**63), 2**63 - 1)), min_size=1, max_size=40), st.integers(1, 40))
def test_kth_largest(spark, values, k):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    ordered = sorted(values, reverse=True)
    want = None if k > len(values) else (ordered[k - 1], sum(v > ordered[k - 1] for v in values))
    assert kth_largest(df, k) == want


@pytest.mark.parametrize("n", [1, 501, 1500, 2999, 3000, 9000])
def test_newest_rows(spark, n):
    rows = [(i % 7, i * 2_000_000_011) for i in range(3000)]
    df = spark.createDataFrame(rows, "a long, b long")
    cut = newest_rows(df, ["a", "b"], n)
    assert [tuple(r) for r in cut.collect()] == sorted(rows, reverse=True)[:n]
    assert n <= 500 or ("TakeOrdered" not in plan(cut) and "SinglePartition" not in plan(cut))
    assert newest_rows(df.limit(0), ["a"], n).count() == 0


def test_any_text_single(spark):
    df = spark.createDataFrame([("A%b",), ("ab",)], "a string")
    assert df.filter(like_any("a\\%", [F.col("a")])).count() == 1


def test_candidates_are_few(spark):
    # digits: by three characters each search would meet about one text in 70
    df = spark.createDataFrame([(i, f"customer#{i * 7919 % 10**9:09d}") for i in range(3000)], "id long, a string")
    asked = spark.createDataFrame([(i, f"#{i * 7919 % 10**9:09d}") for i in range(0, 3000, 3)] + [(9000 + i, f"mer%{i}7919") for i in range(10)], "query_no int, q string")
    each = prepare(asked, sizes=SIZES).select("query_no", F.explode("grams").alias("gram"))
    places = text_places(df.select(F.col("a").alias("text")), each).groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(places, "gram", "left").groupBy("query_no").agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))
    assert rarest.agg(F.sum("n")).first()[0] < 3 * matches(df, asked, ["a"]).count()


def test_no_place_is_lost(spark):
    texts = spark.createDataFrame([("abcabc é",), ("xyz",)], "text string")
    every = sorted({(t, t[i : i + n]) for t in ("abcabc é", "xyz") for n in SIZES for i in range(len(t) - n + 1)})
    wanted = spark.createDataFrame([(g,) for _, g in every], "gram string")
    assert sorted(map(tuple, text_places(texts, wanted).collect())) == every


def _texts_asked_often(spark):
    pets = ["Rex", " rex ", "MILO", "", None]
    rows = [(i, f"PZ-2026-{i}", f"Customer#{i % 23:09d}", pets[i % 5], f"0301 {i % 23}") for i in range(1, 121)]
    reports = conform(spark.createDataFrame(rows, "id long, report_no string, patient_name string, pet_name string, owner_phone string"), "lab_reports")
    # the same text from many, a query_no with two texts, one that comes twice
    asked = [(i, "Rex" if i % 2 else " rex") for i in range(40)] + [(100, "Milo"), (100, "Customer#00000002"), (101, "ex"), (101, "ex"), (102, "")]
    return reports, spark.createDataFrame(asked, "query_no int, q string")


def test_equal_searches_are_worked_out_once(spark):
    reports, asked = _texts_asked_often(spark)
    found = report_list_searches(reports, asked)
    hits = {n: {r.id for r in report_list(reports, q).select("id").collect()} for n, q in ((1, "rex"), (2, "Milo"), (3, "Customer#00000002"), (4, "ex"))}
    got = [(r.query_no, r.id) for r in found.select("query_no", "id").collect()]
    assert len(got) == len(set(got))
    for n, want in ((0, hits[1]), (39, hits[1]), (100, hits[2] | hits[3]), (101, hits[4])):
        assert {i for q, i in got if q == n} == want
    assert sum(q == 102 for q, _ in got) == reports.count()
    top = report_list_searches(reports, asked, 3).select("query_no", "id", "position").collect()
    for n, want in ((5, hits[1]), (100, hits[2] | hits[3])):
        assert sorted((r.position, r.id) for r in top if r.query_no == n) == list(enumerate(sorted(want, reverse=True)[:3], 1))


def test_answers_to_equal_searches_dont_travel(spark):
    reports, asked = _texts_asked_often(spark)
    text = plan(report_list_searches(reports, asked.filter("query_no <> 100")).select("query_no", "id"))
    # the last join multiplies a text's reports by those who ask for it: nothing is dealt out after it
    assert re.search(r"Join \[question", text.split("Exchange")[0])
    ranked = plan(report_list_searches(reports, asked.filter("query_no <> 100"), 3))
    assert re.search(r"WindowGroupLimit \[question.*Partial", ranked)


def test_patients_found_often_are_worked_out_once(spark):
    reports, asked = _texts_asked_often(spark)
    more = asked.union(spark.createDataFrame([(200, "0301 00"), (200, "milo"), (201, "030 119"), (202, None)], asked.schema))
    got = [tuple(r) for r in patient_searches(reports, more).collect()]
    assert len(got) == len(set(got)) and not {102, 202} & {r[0] for r in got}

    def want(n, *qs):  # newest hit of each pet of each owner, hits of any of the texts
        hits = {(r.id, r.owner_key, r.pet_key) for q in qs for r in _patients(reports, q)}
        return {(n, o, p, max(i for i, *key in hits if key == [o, p])) for _, o, p in hits}

    for n, qs in ((0, ["rex"]), (39, ["rex"]), (100, ["Milo", "Customer#00000002"]), (101, ["ex"]), (200, ["0301 00", "milo"]), (201, ["030 119"])):
        found = {(r[0], r[1], r[6], r[12]) for r in got if r[0] == n}
        assert found == want(n, *qs) and (found or n in (200, 201))
    text = plan(patient_searches(reports, asked.filter("query_no <> 100")))
    assert re.search(r"Join \[question", text.split("Exchange")[0])


def _patients(reports, q):
    digits = re.sub("[^0-9]", "", q)
    phone = digits if len(digits) >= 7 else None
    rows = reports.filter(like_any(phone or q, [F.col(c) for c in ("owner_phone", "patient_name", "pet_name")]))
    if phone:
        rows = rows.filter(F.contains(digits_only(F.col("owner_phone")), F.lit(phone)))
    return rows.select("id", owner_key(F.col("owner_phone"), F.col("patient_name")).alias("owner_key"), pet_key(F.col("pet_name"), F.col("id")).alias("pet_key")).collect()
