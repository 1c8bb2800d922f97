"""Forms of any JSON: every leaf against a plain walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from assaybook.operators.forms import form_leaves, form_values

SCHEMA = "id long, report_id long, form_code string, form_json string"


def made(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind == 5:
        return [made(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 6:
        return {rng.choice(["a", "b", "key c", "d.e", "ä", ""]): made(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, True, rng.randrange(-(10**6), 10**6), rng.randrange(1000) + 0.25, f"t{rng.randrange(9)} \"x\" é\n"][kind]


def leaves(value, path=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
        yield path, kind, json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def test_leaves_of_random_forms(spark):
    rng = random.Random(6)
    values = [made(rng, 4) for _ in range(150)] + [[[[[[7]]]]], {}, []]
    df = spark.createDataFrame([(i, i, "F", json.dumps(v)) for i, v in enumerate(values)], SCHEMA)
    got = sorted(tuple(r) for r in form_leaves(form_values(df)).select("report_id", "path", "kind", "value").collect())
    want = sorted((i, *leaf) for i, v in enumerate(values) for leaf in leaves(v))
    assert got == want


@pytest.mark.parametrize("text", ["{bad", "", None, "{}"])
def test_unreadable_forms_are_empty_objects(spark, text):
    df = spark.createDataFrame([(1, 5, "F", text), (0, 5, "F", "[1]")], SCHEMA)
    assert [tuple(r) for r in form_leaves(form_values(df)).collect()] == [(5, "F", "", "object", "{}")]


def test_values_by_path(spark):
    df = spark.createDataFrame([(1, 1, "F", '{"a":[{"n":3},{"n":"x"}]}'), (2, 2, "F", "[4,5]")], SCHEMA)
    got = {r.report_id: (r.n, r.s) for r in form_values(df).select("report_id", F.try_variant_get("form", "$.a[0].n", "int").alias("n"), F.try_variant_get("form", "$[1]", "int").alias("s")).collect()}
    assert got == {1: (3, None), 2: (None, 5)}
    assert form_leaves(form_values(df.limit(0))).count() == 0
