"""Plans of the registered queries: no Python, no products, no hidden single tasks."""

import re

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

import workload
from assaybook.operators import numbering
from assaybook.streaming.rates import last_allowed

QUERIES = workload.all_queries()
# a whole frame in one task, under a window: what it orders must be short, as spans of numbers are
SINGLE = re.compile(r"Window \[([^\n]*)\n(?:[^\n]*(?:Sort|Project|InputAdapter|WholeStage|Input)[^\n]*\n)*[^\n]*Exchange SinglePartition")


def single_task_windows(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in SINGLE.findall(plan) if "_span" not in w]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, sf, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert not single_task_windows(df)


def test_single_task_windows_are_seen(spark):
    df = spark.range(10).withColumn("place", F.row_number().over(Window.orderBy("id")))
    assert single_task_windows(df)


def test_windows_of_sparse_numbers_stay_short(spark):
    n = 3000
    sparse = spark.range(n).select((F.col("id") * 6_148_914_691_236 * 500).alias("seq"))
    totals = sparse.select(F.shiftright("seq", numbering.BUCKET_BITS).alias("b"))
    spans = totals.select(F.shiftright("b", numbering.SPAN_BITS).alias("s"))
    assert totals.distinct().count() == n  # one range per row
    assert spans.distinct().count() == n > spans.filter("s >= 0 and s < 4194304").groupBy("s").count().agg(F.max("count")).first()[0]
    got = numbering.running_totals(sparse, ["seq"], {"rank": F.lit(1)})
    assert [r.rank for r in got.orderBy("seq").collect()] == list(range(n))
    few = sparse.select("seq", (F.col("seq") % 3).alias("first"))
    got = numbering.ranked(few, "first", "seq", "place").orderBy("first", "seq").collect()
    assert [r.place for r in got] == list(range(1, n + 1))


@pytest.mark.parametrize("name", ["last_allowed", "report_list_batch"])
def test_ranks_are_cut_before_the_shuffle(spark, sf, name):
    # the audit stores its last allowed calls, so their plan is looked at by itself
    calls = spark.createDataFrame([], "client long, at timestamp_ntz, id long, window_start timestamp_ntz")
    frame = last_allowed(calls, 3) if name == "last_allowed" else QUERIES[name](spark, sf)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_result_lines_share_one_shuffle_on_the_report(spark):
    from assaybook.plans.print import report_lines
    from assaybook.schemas import TABLES, conform
    from assaybook.session import tune

    source = tune(spark).range(50).selectExpr(
        "id", "id AS report_id", "id AS panel_id", "id AS parameter_id", "'c' AS code",
        "string(id) AS value", "string(id) AS reference_range", "string(id) AS species",
    )
    tables = {n: conform(source, n) for n in TABLES}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = report_lines(tables)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # results meet their selected panels on (report, panel), spread by the report alone
    assert re.search(r"SortMergeJoin \[report_id#\d+L, panel_id#\d+L\]", text)
    assert not re.search(r"hashpartitioning\(report_id#\d+L, panel_id#\d+L", text)
    assert len(re.findall(r"Exchange hashpartitioning\(report_id#\d+L, \d+\)", text)) <= 3


def test_equal_filters_reach_the_parquet_reader(spark, tmp_path):
    from assaybook.operators import lists
    from assaybook.schemas import conform

    path = str(tmp_path / "r")
    conform(spark.range(5), "lab_reports").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = lists.reports_by_no(stored, ["PZ-2026-0001"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*report_no", plan)
    new = stored.select(stored.id.alias("seq"))
    plan = numbering.assign_report_no(new, stored, 2026)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(report_no,PZ-2026-)" in plan


def test_task_sizes_are_bounded(spark, sf):
    """Splits of files and merged shuffle partitions are set to what a task holds; smaller settings stay."""
    from assaybook.session import TASK_BYTES, tune

    saved = {key: spark.conf.get(key) for key in TASK_BYTES}
    try:
        for size, want in (("128MB", list(TASK_BYTES.values())), ("1g", list(TASK_BYTES.values())), ("8m", ["8m"] * 2), ("65536b", ["65536b"] * 2)):
            for key in TASK_BYTES:
                spark.conf.set(key, size)
            QUERIES["page_plan"](spark, sf)
            assert [spark.conf.get(key) for key in TASK_BYTES] == [str(v) for v in want]
    finally:
        for key, size in saved.items():
            spark.conf.set(key, size)
