"""A third of all rows under one key: the answers stay whole and equal a plain computation."""

from pyspark.sql import functions as F

from assaybook.operators import bundles, directory, intake
from assaybook.schemas import TABLES, conform, empty_table


def test_hot_owner_and_pet(spark):
    n = 3000
    hot = F.col("id") % 3 == 0
    reports = conform(spark.range(1, n + 1).select(
        "id", F.when(hot, "").otherwise(F.concat(F.lit("N"), F.col("id") % 50)).alias("patient_name"),
        F.when(hot & (F.col("id") % 2 == 0), "").otherwise("Rex").alias("pet_name"),
    ), "lab_reports")
    owners = {r.owner_key: r for r in directory.owner_directory(reports).collect()}
    assert owners["name:"].reports == n // 3 and owners["name:"].last_report_id == 3000
    pets = {r.owner_key: r.pets for r in directory.owner_pet_counts(reports).collect()}
    assert pets["name:"] == n // 6 + 1
    assert directory.pet_directory(reports).filter("owner_key = 'name:'").count() == n // 6 + 1


def test_hot_report_stays_whole(spark):
    images = conform(spark.range(1, 3001).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("report_id"),
        F.lit("a.png").alias("stored_name"),
    ), "lab_report_images")
    tables = {t: empty_table(spark, t) for t in TABLES} | {"lab_report_images": images}
    got = bundles.report_bundles(tables)["images"]
    places = sorted(r.position for r in got.filter("report_id = 7").collect())
    assert places == list(range(1000)) and got.count() == 3000


def test_one_report_takes_a_third_of_all_images(spark):
    images = conform(spark.range(1, 301).withColumn("stored_name", F.lit("a")), "lab_report_images")
    ask = spark.range(100).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") + 1).cast("bigint").alias("report_id"),
        F.array(F.col("id") * 3 + 1, F.col("id") * 3 + 2).alias("image_ids"),
    )
    got = {r.id: r.report_id for r in intake.attach_images(images, ask, "update").collect()}
    want = dict.fromkeys(range(1, 301))
    for i in range(100):  # one body after the other
        rid = 1 if i % 3 == 0 else i + 1
        want = {k: None if v == rid else v for k, v in want.items()}
        want.update({i * 3 + 1: rid, i * 3 + 2: rid})
    assert got == want


def test_deleting_a_hot_user_keeps_other_rows(spark):
    reports = conform(spark.range(1, 301).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, 2).cast("bigint").alias("created_by")
    ), "lab_reports")
    tables = {"lab_users": conform(spark.range(1, 3), "lab_users"), "lab_reports": reports,
              "lab_report_images": conform(spark.range(0), "lab_report_images")}
    out = intake.null_deleted_users(tables, spark.createDataFrame([(1,)], "user_id BIGINT"))
    left = {r.created_by: r["count"] for r in out["lab_reports"].groupBy("created_by").count().collect()}
    assert left == {2: 100, None: 200} and TABLES
