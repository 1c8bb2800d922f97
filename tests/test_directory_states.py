"""Stored directory states: batches and deletes equal a rebuild, and touch only their own keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from assaybook.operators import directory_states
from assaybook.operators.directory import owner_directory, pet_directory
from assaybook.operators.directory_states import ReportDirectory
from assaybook.schemas import conform

FIELDS = "id BIGINT, patient_name STRING, owner_phone STRING, pet_name STRING, referring_vet STRING, species STRING, age STRING"


def made(spark, rng, ids):
    pick = lambda *x: rng.choice(x)
    rows = [(i, pick("Ann", "Bo", "", None), pick("0301 1", "0301-2", "", None, None), pick("Rex", " rex", "", None), pick("V1", "V2", ""), pick("Dog", "Cat", None), str(i)) for i in ids]
    return conform(spark.createDataFrame(rows, FIELDS), "lab_reports")


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def same(directory, reports):
    assert rows(directory.owners()) == rows(owner_directory(reports))
    assert rows(directory.pets()) == rows(pet_directory(reports))


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for kind in ("owners", "pets") for d, _, names in os.walk(f"{path}/{kind}") for f in names if f.endswith(".parquet")}


@pytest.mark.parametrize("bits", [2, 20])
def test_batches_and_deletes_equal_a_rebuild(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(directory_states, "SPAN_BITS", bits)
    rng = random.Random(bits)
    reports = made(spark, rng, range(1, 61))
    place = f"{tmp_path}/d"
    reports.write.parquet(f"{tmp_path}/reports")
    reports = spark.read.parquet(f"{tmp_path}/reports")
    directory = ReportDirectory(spark, place, buckets=4)
    for name, (a, z) in {"a": (1, 25), "b": (26, 26), "c": (27, 60)}.items():
        directory.add(reports.filter(F.col("id").between(a, z)), name)
        same(directory, reports.filter(F.col("id") <= z))
    directory.add(reports.filter("id between 27 and 60"), "c")  # again, after a failure
    same(directory, reports)
    gone = F.col("id").isin(60, 59, 13, 14, 1)
    directory.remove(reports.filter(gone), reports.filter(~gone), "drop")
    same(directory, reports.filter(~gone))
    directory.remove(reports.filter(gone), reports.filter(~gone), "drop")
    same(directory, reports.filter(~gone))
    directory.remove(reports.filter("id < 0"), reports.filter(~gone), "none")
    directory.remove(reports.filter(~gone), reports.filter("id < 0"), "all")
    same(directory, reports.filter("id < 0"))


def test_other_partitions_stay(spark, tmp_path):
    place = f"{tmp_path}/d"
    directory = ReportDirectory(spark, place, buckets=8)
    many = conform(spark.createDataFrame([(i, f"Owner {i}", None, "Rex", "V", "Dog", "1") for i in range(1, 200)], FIELDS), "lab_reports")
    directory.add(many, "many")
    before = files(place)
    one = conform(spark.createDataFrame([(500, "Owner 7", None, "Rex", "V", "Dog", "1")], FIELDS), "lab_reports")
    directory.add(one, "one")
    touched = {f.split("/")[1] for f in before - files(place)}
    assert len(touched) == 1
    same(directory, many.unionByName(one))


def test_reports_are_read_once(spark, tmp_path):
    directory = ReportDirectory(spark, f"{tmp_path}/d", buckets=4)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    reports = made(spark, random.Random(1), range(1, 41))
    directory.add(reports.mapInArrow(counted, reports.schema), "a")
    assert seen.value == 40
    same(directory, reports)
