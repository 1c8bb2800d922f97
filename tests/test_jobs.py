"""Files in, files out: payload reading, the stream, the snapshot writer, request limits."""

import datetime as dt
import json

from pyspark.sql import functions as F

import compare  # noqa: F401  (path check)
from assaybook.operators import intake
from assaybook.schemas import MAX_BODY_BYTES, TABLES, conform, empty_table
from assaybook.sources.payloads import parse_payloads, read_drafts, read_payloads, split_rejects
from assaybook.sources.writer import load_snapshot, save_snapshot
from assaybook.streaming.rates import rate_limit_audit, rate_limit_stream
from assaybook.streaming.reports import save_batch, stream_reports, streamed_tables

DAY = "2026-03-05 10:00:00"


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def body(i, **over):
    base = {
        "patient_name": f"Owner {i}", "pet_name": "Rex", "species": "dog", "panel_ids": [1, "2"],
        "results": [{"parameter_id": 10, "value": 5.5, "flag": None}], "image_ids": [i],
        "forms": {"ULTRASOUND": {"findings": f"n{i}"}}, "extra": 1,
    }
    return json.dumps({**base, **over})


def catalog(spark):
    return {
        "lab_test_panels": conform(spark.createDataFrame([(1, "A"), (2, "B")], "id BIGINT, code STRING"), "lab_test_panels"),
        "lab_test_parameters": conform(spark.createDataFrame([(10, 1, "P")], "id BIGINT, panel_id BIGINT, code STRING"), "lab_test_parameters"),
    }


def test_read_payloads(spark, tmp_path):
    lines = [body(1), "{bad", body(2, clinical_notes="x" * (MAX_BODY_BYTES + 1)), body(3, forms=None), "[]"]
    (tmp_path / "in.json").write_text("\n".join(lines))
    ok, bad = split_rejects(read_payloads(spark, str(tmp_path), max_bytes=MAX_BODY_BYTES))
    assert rows(bad, "raw_body") == sorted([(lines[1],), (lines[2],), (lines[4],)], key=repr)
    assert split_rejects(read_payloads(spark, str(tmp_path)))[0].count() == 3
    assert rows(ok, "patient_name") == [("Owner 1",), ("Owner 3",)]
    first = ok.orderBy("patient_name").first()
    assert first.panel_ids == ["1", "2"] and first.results[0].value == "5.5"
    assert first.forms == {"ULTRASOUND": '{"findings":"n1"}'}
    reasons = rows(bad, "reject_reason")
    assert ("body_too_large",) in reasons and ("bad_json",) in reasons


def test_read_drafts(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({
        "editId": 5, "panel_ids": [1], "included_parameter_ids": None, "results": {"10": "4"},
        "images": [{"id": 3, "stored_name": "a"}],
    }))
    d = read_drafts(spark, str(tmp_path)).first()
    assert d.included_parameter_ids is None and d.results == {"10": "4"} and d.images[0].id == "3"


def test_stream_equals_batch(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.json").write_text("\n".join([body(1), body(2, species="fish"), body(3)]))
    existing = {"lab_reports": conform(spark.createDataFrame(
        [(40, "PZ-2026-0099")], "id BIGINT, report_no STRING"), "lab_reports")}
    images = conform(spark.createDataFrame([(1,), (3,), (4,)], "id BIGINT"), "lab_report_images")
    args = dict(catalog=catalog(spark), user_id=7, existing=existing, clock=lambda: DAY)
    stream_reports(spark, str(src), str(out), **args).awaitTermination()
    (src / "b.json").write_text("\n".join([body(4), "{bad", body(5, image_ids=[1])]))
    stream_reports(spark, str(src), str(out), **args).awaitTermination()
    got = streamed_tables(spark, str(out), images)
    headers = rows(got["lab_reports"], "id", "report_no", "patient_name")
    assert headers == [
        (41, "PZ-2026-0100", "Owner 1"), (42, "PZ-2026-0101", "Owner 3"),
        (43, "PZ-2026-0102", "Owner 4"), (44, "PZ-2026-0103", "Owner 5"),
    ]
    assert rows(got["lab_report_panels"], "id", "report_id") == [(i + 1, 41 + i // 2) for i in range(8)]
    assert rows(got["lab_report_images"], "id", "report_id") == [(1, 41), (3, 42), (4, 43)]
    assert rows(spark.read.parquet(f"{out}/rejects"), "batch", "reject_reason") == [(0, "species_required"), (1, "bad_json")]
    # the same bodies as one batch
    (tmp_path / "all.json").write_text("\n".join([body(1), body(3), body(4), body(5, image_ids=[1])]))
    bodies = read_payloads(spark, str(tmp_path / "all.json")).withColumn("seq", F.monotonically_increasing_id())
    empty = {n: conform(spark.createDataFrame([], TABLES[n]), n) for n in TABLES}
    tables = {**empty, **catalog(spark), **existing, "lab_report_images": images}
    batch, _ = intake.apply_creates(tables, bodies, DAY, 7)
    assert rows(batch["lab_reports"].filter("id > 40"), "id", "report_no", "patient_name") == headers
    assert rows(batch["lab_report_forms"], "id", "report_id", "form_json") == rows(got["lab_report_forms"], "id", "report_id", "form_json")
    # a batch that is run again replaces only itself
    save_batch(spark.read.text(str(src / "b.json")), 1, str(out), catalog(spark), 7, DAY, existing)
    assert rows(streamed_tables(spark, str(out))["lab_reports"], "id", "report_no", "patient_name") == headers


def test_a_batch_checks_its_bodies_once(spark, tmp_path, monkeypatch):
    """Refused and accepted bodies are told apart on stored bodies, whose child lists are worked out."""
    from assaybook.streaming import reports

    src, out, read = tmp_path / "in.json", tmp_path / "out", []
    src.write_text("\n".join([body(1), body(2, species="fish"), body(3, panel_ids=[9]), "{bad", body(4)]))

    def accept(*args, **options):
        accepted, refused = intake.accept_creates(*args, **options)
        read.extend("".join(df.inputFiles()) for df in (accepted, refused))
        return accepted, refused

    monkeypatch.setattr(reports, "accept_creates", accept)
    save_batch(spark.read.text(str(src)), 0, str(out), catalog(spark), 7, DAY)
    assert len(read) == 2 and all("/_read/batch=0" in files and "/_bodies/" not in files for files in read)
    assert rows(spark.read.parquet(f"{out}/rejects"), "reject_reason") == [("bad_json",), ("species_required",), ("unknown_panel",)]
    assert rows(streamed_tables(spark, str(out))["lab_reports"], "id", "patient_name") == [(1, "Owner 1"), (2, "Owner 4")]


def test_half_written_batch_is_not_seen(spark, tmp_path):
    src, out = tmp_path / "in.json", tmp_path / "out"
    src.write_text(body(1))
    save_batch(spark.read.text(str(src)), 0, str(out), catalog(spark), 7, DAY)
    before = rows(streamed_tables(spark, str(out))["lab_reports"], "id")
    save_batch(spark.read.text(str(src)), 1, str(out), catalog(spark), 7, DAY)
    (out / "_counters" / "batch=1").rename(tmp_path / "lost")
    images = conform(spark.createDataFrame([(1,), (2,)], "id BIGINT"), "lab_report_images")
    seen = streamed_tables(spark, str(out), images)
    assert rows(seen["lab_reports"], "id") == before and len(before) == 1
    assert seen["lab_report_results"].filter("report_id > 1").count() == 0
    assert {r[0] for r in rows(seen["lab_report_images"], "report_id")} <= {None, before[0][0]}


def test_large_bodies_are_stored_whole(spark):
    panels, results, images = range(1, 61), range(1, 701), range(1, 61)
    empty = {n: empty_table(spark, n) for n in TABLES}
    tables = {
        **empty,
        "lab_test_panels": conform(spark.range(1, 61).selectExpr("id", "string(id) AS code"), "lab_test_panels"),
        "lab_test_parameters": conform(spark.range(1, 701).selectExpr("id", "id % 60 + 1 AS panel_id", "string(id) AS code"), "lab_test_parameters"),
        "lab_report_images": conform(spark.range(1, 61).toDF("id"), "lab_report_images"),
    }
    big = dict(
        panel_ids=[str(i) for i in panels], image_ids=[str(i) for i in images],
        results=[{"parameter_id": str(i), "value": str(i)} for i in results], forms={"A" * 40: "{}", "B": "{}"},
    )

    def bodies(*lines):
        parsed = parse_payloads(spark.createDataFrame([(x,) for x in lines], "value STRING"), "report_id STRING")
        return split_rejects(parsed)[0].withColumn("seq", F.monotonically_increasing_id())

    made, refused = intake.apply_creates(tables, bodies(body(1, **big), body(2, **big | {"forms": {"C" * 41: "{}", "C" * 40: "{}"}})), DAY, 7)
    assert rows(refused, "reject_reason") == [("form_code_too_long",)]
    want = {"lab_report_panels": 60, "lab_report_results": 700, "lab_report_images": 60, "lab_report_forms": 2}
    (report,) = [r.id for r in made["lab_reports"].collect()]
    count = lambda t: {n: t[n].filter(F.col("report_id") == report).count() for n in want}
    assert count(made) == want
    saved, refused = intake.apply_updates({**tables, **made}, bodies(body(1, report_id=str(report), **big)), DAY)
    assert refused.count() == 0 and count(saved) == want
    _, refused = intake.apply_updates({**tables, **made}, bodies(body(1, report_id=str(report), **big | {"forms": {"C" * 41: "{}"}})), DAY)
    assert rows(refused, "reject_reason") == [("form_code_too_long",)]


def test_snapshots(spark, tmp_path):
    n = 40
    tables = {
        "lab_users": empty_table(spark, "lab_users"),
        "lab_reports": conform(spark.range(1, n + 1).withColumn("patient_name", F.lit("a")), "lab_reports"),
        "lab_report_panels": conform(spark.range(1, n + 1).withColumn("report_id", F.col("id")).withColumn("panel_id", F.lit(1)), "lab_report_panels"),
        "lab_report_results": empty_table(spark, "lab_report_results"),
        "lab_report_forms": empty_table(spark, "lab_report_forms"),
        "lab_report_images": conform(spark.range(1, n + 1).withColumn("stored_name", F.lit("x")), "lab_report_images"),
    }
    out = str(tmp_path / "lab")
    save_snapshot(tables, out, "1")
    live = load_snapshot(spark, out, "1")
    gone = live["lab_reports"].filter("id % 3 = 0").select(F.col("id").alias("report_id"))
    after = intake.delete_reports(live, gone)
    for _ in range(2):  # running the job again changes nothing
        save_snapshot({t: after[t] for t in tables}, out, "2")
        new = load_snapshot(spark, out, "2")
        assert new["lab_reports"].count() == 27 == new["lab_report_panels"].count()
        assert new["lab_report_images"].count() == n and load_snapshot(spark, out, "1")["lab_reports"].count() == n


def calls(spark):
    start = dt.datetime(2026, 1, 1)
    data = [(1, start + dt.timedelta(seconds=i), i) for i in range(90)] + [(2, start, 1000), (2, start, 1001)]
    return spark.createDataFrame(data, "client BIGINT, at TIMESTAMP_NTZ, id BIGINT")


def test_rate_limit_batch(spark):
    refused = rate_limit_audit(calls(spark).repartition(7), limit=20)
    assert rows(refused, "client", "id") == [(1, i) for i in [*range(20, 60), *range(80, 90)]]
    assert rows(rate_limit_audit(calls(spark), 1).filter("client = 2"), "id") == [(1001,)]


def test_rate_limit_stream(spark, tmp_path):
    calls(spark).select("client", F.col("at").cast("timestamp").alias("at"), "id").write.parquet(f"{tmp_path}/a")
    late = spark.createDataFrame([(9, dt.datetime(2026, 1, 2), 1)], "client BIGINT, at TIMESTAMP, id BIGINT")
    late.write.mode("append").parquet(f"{tmp_path}/a")
    source = spark.readStream.schema("client BIGINT, at TIMESTAMP, id BIGINT").parquet(f"{tmp_path}/a")
    q = (rate_limit_stream(source, 20).writeStream.outputMode("append").format("memory")
         .queryName("limits").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start())
    q.awaitTermination()
    assert rows(spark.table("limits"), "client", "calls", "refused") == [(1, 30, 10), (1, 60, 40)]
