"""Streams: refused calls over several batches with late ones, bodies sent twice."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from assaybook.schemas import conform
from assaybook.streaming.rates import rate_limit_audit, refusal_stream, refused_calls, settle_batch
from assaybook.streaming.reports import stream_reports, streamed_tables

START = dt.datetime(2024, 1, 1)
CALLS = "client long, at timestamp_ntz, id long"


def test_refusals_equal_the_audit_of_calls_in_time(spark, tmp_path):
    rng = random.Random(1)
    out, kept, mark, n = f"{tmp_path}/out", [], None, 0
    late_ids = set()
    for batch in range(6):
        rows = []
        for _ in range(60):
            n += 1
            at = START + dt.timedelta(seconds=batch * 90 + rng.randrange(-200, 90))
            rows.append((rng.randrange(3), at, n))
        for client, at, i in rows:
            end = at.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
            if mark is not None and end <= mark:
                late_ids.add(i)
            else:
                kept.append((client, at, i))
        settle_batch(spark.createDataFrame([*rows, (None, START, -1)], CALLS), batch, 2, out, "60 seconds", "60 seconds")
        newest = max(r[1] for r in rows) - dt.timedelta(seconds=60)
        mark = newest if mark is None else max(mark, newest)
        if batch == 3:  # a batch that is run again replaces what it wrote
            settle_batch(spark.createDataFrame([*rows, (None, START, -1)], CALLS), batch, 2, out, "60 seconds", "60 seconds")
    want = rate_limit_audit(spark.createDataFrame(kept, CALLS), 2)
    got = refused_calls(spark, out, 2, settle=True)
    assert sorted(map(tuple, got.select("client", "at", "id", "window_start").collect())) == sorted(map(tuple, want.collect()))
    assert {r.id for r in spark.read.parquet(f"{out}/late").collect()} == late_ids and len(late_ids) > 5
    settled = refused_calls(spark, out, 2)
    assert settled.filter(F.col("window_start") > mark).count() == 0 and 0 < settled.count() < want.count()


def test_refusal_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = [(1, START + dt.timedelta(seconds=7 * i), i) for i in range(100)]
    for part in (rows[:50], rows[50:], []):
        spark.createDataFrame(part, CALLS).coalesce(1).write.mode("append").parquet(source)
        refusal_stream(spark.readStream.schema(CALLS).parquet(source), 3, out).awaitTermination()
    want = rate_limit_audit(spark.createDataFrame(rows, CALLS), 3)
    assert sorted(r.id for r in refused_calls(spark, out, 3, settle=True).collect()) == sorted(r.id for r in want.collect())


def test_bodies_sent_twice_are_saved_once(spark, tmp_path):
    catalog = {
        "lab_test_panels": conform(spark.createDataFrame([(1, "A")], "id BIGINT, code STRING"), "lab_test_panels"),
        "lab_test_parameters": conform(spark.createDataFrame([(10, 1, "P")], "id BIGINT, panel_id BIGINT, code STRING"), "lab_test_parameters"),
    }
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    body = lambda i: json.dumps({"patient_name": f"Owner {i}", "pet_name": "Rex", "species": "dog", "panel_ids": [1]})
    args = {"catalog": catalog, "user_id": 7, "clock": lambda: "2026-03-05 10:00:00", "max_files": 1, "once_within": "1 hour"}
    for name, numbers in {"a": [1, 2, 1], "b": [2, 3], "c": [3, 1, 4]}.items():
        (source / f"{name}.json").write_text("\n".join(map(body, numbers)))
        stream_reports(spark, str(source), str(out), **args).awaitTermination()
    saved = streamed_tables(spark, str(out))["lab_reports"].collect()
    assert sorted(r.patient_name for r in saved) == ["Owner 1", "Owner 2", "Owner 3", "Owner 4"]
    assert sorted(r.id for r in saved) == [1, 2, 3, 4] and len({r.report_no for r in saved}) == 4


def test_hashes_of_bodies_are_kept_on_disk(spark, tmp_path):
    """A new stream keeps its hashes on disk, one that began with Spark's default goes on with it; the session stays as it was."""
    catalog = {
        "lab_test_panels": conform(spark.createDataFrame([(1, "A")], "id BIGINT, code STRING"), "lab_test_panels"),
        "lab_test_parameters": conform(spark.createDataFrame([(10, 1, "P")], "id BIGINT, panel_id BIGINT, code STRING"), "lab_test_parameters"),
    }
    body = lambda i: json.dumps({"patient_name": f"Owner {i}", "pet_name": "Rex", "species": "dog", "panel_ids": [1]})
    provider = "spark.sql.streaming.stateStore.providerClass"
    for first in ("RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"):
        source, out = tmp_path / first / "in", tmp_path / first / "out"
        source.mkdir(parents=True)
        for name, numbers in {"a": [1, 2, 1], "b": [2, 3]}.items():
            (source / f"{name}.json").write_text("\n".join(map(body, numbers)))
            if name == "a" and first.startswith("HDFS"):
                spark.conf.set(provider, f"org.apache.spark.sql.execution.streaming.state.{first}")
            query = stream_reports(spark, str(source), str(out), catalog, 7, clock=lambda: "2026-03-05 10:00:00", once_within="1 hour")
            query.awaitTermination()
            spark.conf.unset(provider)
            assert query.exception() is None
        offsets = [f.read_text() for f in (out / "_checkpoint" / "offsets").iterdir() if f.name.isdigit()]
        assert len(offsets) > 1 and all(first in o for o in offsets)
        assert sorted(r.patient_name for r in streamed_tables(spark, str(out))["lab_reports"].collect()) == ["Owner 1", "Owner 2", "Owner 3"]
        assert spark.conf.get(provider, None) is None
