"""Tables in hash partitions: equal to whole rewrites, untouched files stay, scans are cut."""

import os

import pytest
from pyspark.sql import functions as F

from assaybook.operators.intake import apply_updates, delete_reports
from assaybook.sources import partitioned
from assaybook.sources.partitioned import KEYS, bucket, change_partitions, delete_partitioned, load_partitioned, read_partitions, save_partitioned, touched, update_partitioned
from workload.labviews import AS_OF, Lab


@pytest.fixture
def lab(spark, sf):
    return Lab(spark, sf)


def rows(df):
    return sorted(map(str, df.collect()))


def files(path, name):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(f"{path}/{name}") for f in names if f.endswith(".parquet")}


def of(found, numbers):
    return {f for f in found if any(f"bucket={b}/" in f for b in numbers)}


def test_update_equals_whole_rewrite(spark, lab, tmp_path):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=48)
    bodies = lab.payloads.filter("seq between 300 and 308")
    before = {n: files(path, n) for n in KEYS}
    rejects = update_partitioned(spark, path, bodies, AS_OF)
    want, want_rejects = apply_updates(lab.tables, bodies, AS_OF)
    got = load_partitioned(spark, path)
    for name in KEYS:
        assert rows(got[name]) == rows(want[name]), name
    assert rows(rejects) == rows(want_rejects)
    hit = touched(bodies.select((F.col("seq") + 1).alias("id")), "id", 48)
    for name in KEYS:
        if name != "lab_report_images":
            kept = before[name] - of(before[name], hit)
            assert kept and kept <= files(path, name) and len(hit) < 24
    # a second run of the same bodies goes on from the ids that the first one used
    update_partitioned(spark, path, bodies, AS_OF)
    ids = lambda df: {r.id for r in df.select("id").collect()}
    again = load_partitioned(spark, path)["lab_report_results"]
    new = ids(again) - ids(lab.results)
    assert new and not new & ids(want["lab_report_results"])


def test_deletes_leave_no_old_rows(spark, lab, tmp_path):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=60)
    gone = lab.reports.filter(bucket(F.col("id"), 60) == 7).select(F.col("id").alias("report_id"))
    assert gone.count() > 0
    delete_partitioned(spark, path, gone)
    want, got = delete_reports(lab.tables, gone), load_partitioned(spark, path)
    for name in KEYS:
        assert rows(got[name]) == rows(want[name])
    assert read_partitions(spark, path, "lab_reports", [7]).count() == 0


def test_scan_reads_touched_partitions_only(spark, lab, tmp_path):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=16)
    plan = read_partitions(spark, path, "lab_report_results", [3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "(3,5)" in plan.replace(" ", "")


def test_rows_outside_are_refused(spark, lab, tmp_path):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=16)
    before = files(path, "lab_reports")
    with pytest.raises(ValueError, match="not to touch"):
        change_partitions(spark, path, {n: [1] if n == "lab_reports" else [] for n in KEYS}, lambda t: {"lab_reports": lab.reports})
    assert files(path, "lab_reports") == before


def test_a_change_that_died_is_finished_by_repeating_the_move(spark, lab, tmp_path, monkeypatch):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=16)
    gone = lab.reports.filter("id = 5").select(F.col("id").alias("report_id"))
    stages = []
    with monkeypatch.context() as m:
        m.setattr(partitioned, "replace_partitions", lambda spark, path, stage, buckets: stages.append((stage, buckets)))
        delete_partitioned(spark, path, gone)
    assert load_partitioned(spark, path)["lab_reports"].filter("id = 5").count() == 1
    for _ in range(2):
        partitioned.replace_partitions(spark, path, *stages[0])
        assert rows(load_partitioned(spark, path)["lab_reports"]) == rows(delete_reports(lab.tables, gone)["lab_reports"])


def test_nothing_to_change(spark, lab, tmp_path):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=8)
    before = {n: files(path, n) for n in KEYS}
    update_partitioned(spark, path, lab.payloads.filter("seq < 0"), AS_OF)
    delete_partitioned(spark, path, spark.createDataFrame([], "report_id BIGINT"))
    assert {n: files(path, n) for n in KEYS} == before


def test_deletes_work_their_ids_out_once(spark, lab, tmp_path):
    path = f"{tmp_path}/lab"
    save_partitioned(lab.tables, path, buckets=4)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    gone = lab.reports.filter("id % 50 = 3").select(F.col("id").alias("report_id"))
    delete_partitioned(spark, path, gone.mapInArrow(counted, "report_id BIGINT"))
    assert seen.value == gone.count() > 0


def test_files_of_few_buckets_move_without_a_shuffle(spark, tmp_path):
    rows_ = spark.range(4000).withColumn("bucket", bucket(F.col("id"), 40))
    rows_.repartition(40, "bucket").write.parquet(f"{tmp_path}/apart")
    rows_.repartition(40).write.parquet(f"{tmp_path}/mixed")
    for name, want in (("apart", True), ("mixed", False)):
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        assert partitioned._lie_together(stage, range(40)) is want
        partitioned.overwrite_buckets(stage, f"{tmp_path}/out-{name}", range(40))
        out = spark.read.parquet(f"{tmp_path}/out-{name}").filter("id is not null")
        assert rows(out.select("id", "bucket")) == rows(rows_)
