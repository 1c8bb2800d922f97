"""Fact tables in hash partitions: a change reads and rewrites only the partitions that it touches.

Reports and their panels, results and forms are laid out by a hash of the report's id, images by a hash of
their own. A change names the partitions it can touch; they alone are read (a partition filter of the scan), and
its result replaces them by Spark's dynamic partition overwrite. All other files stay as they are. Catalog tables are
small and stay whole.

A result is first stored beside the tables and then moved in from there, so that nothing is read while it is
replaced, and a job that died between the two is finished by repeating `replace_partitions` on what it stored.
Partitions may be large: rows are rebalanced before they are written, so a hot one is cut into several files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import to_id
from ..operators.intake import accept_updates, attachments, delete_reports, updated_tables
from ..schemas import TABLES, columns_of, conform
from .tables import Tables

#: The column that a fact table is laid out by.
KEYS = {
    "lab_reports": "id", "lab_report_panels": "report_id", "lab_report_results": "report_id",
    "lab_report_forms": "report_id", "lab_report_images": "id",
}
OF_REPORTS = tuple(n for n in KEYS if n != "lab_report_images")
BUCKETS = 64
LAYOUT = "buckets INT, table_name STRING, id BIGINT"


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(buckets)).cast("int")


def _rebalanced(rows: DataFrame) -> DataFrame:
    """About even files of each bucket, cut or merged by their measured size."""
    return rows.hint("rebalance", F.col("bucket"))


def save_partitioned(tables: Mapping[str, DataFrame], path: str, buckets: int = BUCKETS) -> None:
    """Writes all tables under path, facts in hash partitions; what stands there is replaced."""
    for name, df in tables.items():
        rows = conform(df, name)
        if name in KEYS:
            rows = _rebalanced(rows.withColumn("bucket", bucket(F.col(KEYS[name]), buckets)))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            rows.write.mode("overwrite").parquet(f"{path}/{name}")
    saved = _facts(next(iter(tables.values())).sparkSession, path, tables)
    _last_ids(saved, buckets).write.mode("overwrite").parquet(f"{path}/_layout")


def _last_ids(tables: Mapping[str, DataFrame], buckets: int) -> DataFrame:
    """The largest id of each fact table, and the number of buckets: one row per table."""
    out = None
    for name in KEYS:
        if name in tables:
            row = tables[name].agg(F.max("id").alias("id")).select(
                F.lit(buckets).alias("buckets"), F.lit(name).alias("table_name"), "id"
            )
            out = row if out is None else out.unionByName(row)
    return out


def _facts(spark: SparkSession, path: str, names: Iterable[str]) -> Tables:
    return Tables({n: (lambda n=n: read_partitions(spark, path, n)) for n in names if n in KEYS})


def read_partitions(
    spark: SparkSession, path: str, name: str, buckets: Iterable[int] | None = None
) -> DataFrame:
    """A fact table, or only some of its partitions."""
    rows = spark.read.schema(f"{TABLES[name]}, bucket INT").parquet(f"{path}/{name}")
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(list(buckets)))
    # a partition that lost all its rows holds one without an id (see replace_partitions)
    return rows.filter(F.col("id").isNotNull()).select(*[c for c, _ in columns_of(TABLES[name])])


def load_partitioned(
    spark: SparkSession, path: str, buckets: Mapping[str, Iterable[int]] | None = None
) -> Tables:
    """All tables, or of the facts only the partitions named for each."""
    def load(name: str) -> DataFrame:
        if name in KEYS:
            return read_partitions(spark, path, name, None if buckets is None else buckets[name])
        return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")

    return Tables({n: (lambda n=n: load(n)) for n in TABLES})


def layout(spark: SparkSession, path: str) -> tuple[int, Tables]:
    """(number of buckets, the largest id so far of each fact table as a frame of one row)."""
    rows = spark.read.schema(LAYOUT).parquet(f"{path}/_layout")
    last = rows.groupBy("table_name").agg(F.max("id").alias("id"))
    buckets = rows.agg(F.max("buckets").alias("n")).first()["n"]
    return buckets, Tables({
        n: (lambda n=n: last.filter(F.col("table_name") == n).select("id")) for n in KEYS
    })


def touched(ids: DataFrame, column: str, buckets: int) -> list[int]:
    """Buckets of the ids: as many numbers as there are buckets, at most."""
    found = ids.filter(F.col(column).isNotNull()).select(bucket(F.col(column), buckets).alias("b"))
    return sorted(r["b"] for r in found.distinct().collect())


def replace_partitions(spark: SparkSession, path: str, stage: str, buckets: Mapping[str, Iterable[int]]) -> None:
    """Moves stored results (stage/<table>) over the partitions named for each table. Can be repeated."""
    for name, numbers in buckets.items():
        rows = spark.read.schema(f"{TABLES[name]}, bucket INT").parquet(f"{stage}/{name}") if numbers else None
        overwrite_buckets(rows, f"{path}/{name}", numbers)


def _lie_together(rows: DataFrame, numbers: Iterable[int]) -> bool:
    """Do stored files hold few buckets each, so that moving them as they lie writes hardly more files than there are?"""
    pairs = rows.select(F.input_file_name().alias("f"), "bucket").distinct()
    found = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("f").alias("files")).first()
    return found["pairs"] <= 2 * found["files"] + len(list(numbers))


def overwrite_buckets(rows: DataFrame | None, target: str, numbers: Iterable[int]) -> None:
    """Replaces the numbered partitions of a table by rows, which have a column bucket. A partition that gets none keeps one row
    of nulls, which readers drop: overwriting leaves a partition alone that gets no row."""
    if not numbers:
        return
    blank = rows.sparkSession.createDataFrame([(b,) for b in numbers], "bucket INT")
    whole = rows.unionByName(blank, allowMissingColumns=True)
    (whole if _lie_together(rows, numbers) else _rebalanced(whole)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("bucket").parquet(target)


def change_partitions(
    spark: SparkSession, path: str, buckets: Mapping[str, list[int]], change: Callable[[Tables], Mapping[str, DataFrame]],
) -> str:
    """Applies `change` to the named partitions and replaces them; gives the folder of the stored result.

    change gets all tables, facts cut to their named partitions, and must keep rows in them.
    """
    count, _ = layout(spark, path)
    changed = change(load_partitioned(spark, path, buckets))
    stage = f"{path}/_changes/{uuid.uuid4().hex}"
    names = {n: sorted(numbers) for n, numbers in buckets.items() if numbers}
    for name, numbers in names.items():
        rows = conform(changed[name], name).withColumn("bucket", bucket(F.col(KEYS[name]), count))
        rows.write.parquet(f"{stage}/{name}")
        stored = spark.read.schema(f"{TABLES[name]}, bucket INT").parquet(f"{stage}/{name}")
        if not stored.filter(~F.col("bucket").isin(numbers)).isEmpty():
            raise ValueError(f"the change puts rows of {name} into partitions that it was not to touch")
    if names:
        staged = Tables({n: (lambda n=n: spark.read.schema(TABLES[n]).parquet(f"{stage}/{n}")) for n in names})
        # before the move: a job that dies after it never gives an id twice
        _last_ids(staged, count).write.mode("append").parquet(f"{path}/_layout")
    replace_partitions(spark, path, stage, names)
    return stage


def update_partitioned(spark: SparkSession, path: str, payloads: DataFrame, as_of: str) -> DataFrame:
    """apply_updates on tables saved by save_partitioned: the bodies are read and accepted once; gives the
    refused (seq, reject_reason)."""
    count, last_ids = layout(spark, path)
    work = f"{path}/_changes/{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    bodies = stored(payloads, "bodies")
    asked = touched(bodies.select(to_id(F.col("report_id").cast("string")).alias("id")), "id", count)
    known = load_partitioned(spark, path, dict.fromkeys(KEYS, asked))
    good, rejects = accept_updates(known, bodies, as_of, stored)
    good, rejects = stored(good, "accepted"), stored(rejects, "rejects")
    hit = touched(good, "report_id", count)
    buckets = dict.fromkeys(OF_REPORTS, hit)
    buckets["lab_report_images"] = _image_buckets(spark, path, attachments(good), count)
    change_partitions(spark, path, buckets, lambda tables: updated_tables(tables, good, as_of, last_ids))
    return rejects


def _image_buckets(spark: SparkSession, path: str, requests: DataFrame, count: int) -> list[int]:
    """Buckets of the images that requests name, or that the reports of requests have: images are laid out by their own
    id, so the second kind is found by a scan of two columns."""
    images = read_partitions(spark, path, "lab_report_images").select("id", "report_id")
    listed = requests.select(F.explode("image_ids").alias("id"))
    owned = images.join(requests.select("report_id").distinct(), "report_id", "left_semi").select("id")
    return touched(owned.unionByName(images.select("id").join(listed.distinct(), "id", "left_semi")), "id", count)


def delete_partitioned(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """delete_reports on tables saved by save_partitioned: ids(report_id). They are stored first: every table meets the same
    few numbers, whatever they are worked out from."""
    count, _ = layout(spark, path)
    place = f"{path}/_changes/{uuid.uuid4().hex}/ids"
    ids.select(F.col("report_id").cast("bigint").alias("report_id")).distinct().write.parquet(place)
    ids = spark.read.schema("report_id BIGINT").parquet(place)
    hit = touched(ids, "report_id", count)
    images = read_partitions(spark, path, "lab_report_images").select("id", "report_id")
    owned = images.join(ids, "report_id", "left_semi")
    buckets = dict.fromkeys(OF_REPORTS, hit) | {"lab_report_images": touched(owned, "id", count)}
    change_partitions(spark, path, buckets, lambda tables: delete_reports(tables, ids))
