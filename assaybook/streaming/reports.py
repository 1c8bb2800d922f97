"""Report bodies that arrive over time.

Each micro-batch is stored before it is worked on, and every output of a batch goes to its own
batch=<id> directory, written with overwrite: a batch that is run again after a failure replaces
its own output and nothing else. Numbers continue from a short counters table, so the cost of a
batch does not grow with the history behind it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.intake import accept_creates, attach_images, attachments, created_rows
from ..schemas import TABLES, columns_of
from ..sources.payloads import parse_payloads
from ..sources.tables import Tables

COUNTERS = "table_name STRING, year INT, id BIGINT, report_no STRING"
NUMBERED = ("lab_reports", "lab_report_panels", "lab_report_results", "lab_report_forms")


#: Where hashes of earlier bodies are kept: on disk, with bounded memory for all partitions of an executor. Spark's default
#: holds every one of them, twice, in the executors' heap. A stream goes on with the kind of store that it began with.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """STATE for streams that start here, unless the session names a store of its own."""
    provider = next(iter(STATE))
    ours = STATE if spark.conf.get(provider, None) is None else {}
    ours = {key: value for key, value in ours.items() if spark.conf.get(key, None) is None}
    try:
        for key, value in ours.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key in ours:
            spark.conf.unset(key)


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")


def stream_reports(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    catalog: Mapping[str, DataFrame],
    user_id: int,
    existing: Mapping[str, DataFrame] | None = None,
    clock: Callable[[], str] = _now,
    max_files: int = 1000,
    checkpoint: str | None = None,
    once_within: str | None = None,
) -> StreamingQuery:
    """Validates and saves JSON bodies from files under in_path until all present are done.

    once_within, for example '1 hour': a body that is sent again, letter for letter, in a file no more than that later
    (by the files' times) is dropped. Spark keeps a hash of each body for that time, on disk (STATE).

    Progress is kept in `checkpoint`, by default beside the output, which all executors share.
    catalog holds lab_test_panels and lab_test_parameters; existing the tables that were there
    before the stream began, from which ids and report numbers go on.
    """
    # progress belongs to the output: the two are kept, moved and removed together
    place = checkpoint or f"{out_path}/_checkpoint"

    def save(batch: DataFrame, batch_id: int) -> None:
        save_batch(batch, batch_id, out_path, catalog, user_id, clock(), existing)

    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(in_path)
    if once_within is not None:
        timed = lines.select("value", F.col("_metadata.file_modification_time").alias("sent"), F.sha2("value", 256).alias("hash"))
        lines = timed.withWatermark("sent", once_within).dropDuplicatesWithinWatermark(["hash"]).select("value")
    with _state_settings(spark):
        return (
            lines.writeStream.foreachBatch(save)
            .option("checkpointLocation", place)
            .trigger(availableNow=True)
            .start()
        )


def save_batch(
    lines: DataFrame,
    batch_id: int,
    out_path: str,
    catalog: Mapping[str, DataFrame],
    user_id: int,
    as_of: str,
    existing: Mapping[str, DataFrame] | None = None,
) -> None:
    spark = lines.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = f"{out_path}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    # arrival number: file order, then line order; fixed once stored
    bodies = stored(
        parse_payloads(lines).withColumn("seq", F.monotonically_increasing_id()), "_bodies"
    )
    unread = bodies.filter(F.col("reject_reason").isNotNull()).select("seq", "reject_reason")
    counters = _counters(spark, out_path, batch_id, existing)
    tables = Tables({
        "lab_test_panels": lambda: catalog["lab_test_panels"],
        "lab_test_parameters": lambda: catalog["lab_test_parameters"],
        **{
            n: (lambda n=n: counters.filter(F.col("table_name") == n).select("id", "report_no"))
            for n in NUMBERED
        },
    })
    readable = bodies.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw_body")
    # both outputs go on from bodies that are read and checked once
    accepted, refused = accept_creates(tables, readable, as_of, store=lambda df, name: stored(df, f"_{name}"))
    stored(unread.unionByName(refused), "rejects")
    accepted = stored(accepted, "_accepted")
    rows = created_rows(accepted, as_of, user_id)
    for name in rows:
        stored(rows[name], name)
    stored(attachments(accepted), "_attachments")
    stored(_next_counters(counters, accepted, int(as_of[:4])), "_counters")


def _counters(
    spark: SparkSession, out_path: str, batch_id: int, existing: Mapping[str, DataFrame] | None
) -> DataFrame:
    """Last id per table, and per year the last report number, before this batch."""
    for earlier in range(batch_id - 1, -1, -1):
        try:
            return spark.read.schema(COUNTERS).parquet(f"{out_path}/_counters/batch={earlier}")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
    out = spark.createDataFrame([], COUNTERS)
    for name in NUMBERED:
        if existing is None or name not in existing:
            continue
        header = name == "lab_reports"
        year = F.regexp_extract("report_no", r"^[^-]*-([0-9]{4})-", 1).try_cast("int")
        rows = existing[name].select(
            (year if header else F.lit(None).cast("int")).alias("year"), "id",
            (F.col("report_no") if header else F.lit(None).cast("string")).alias("report_no"),
        )
        out = out.unionByName(rows.groupBy("year").agg(
            F.max("id").alias("id"), F.max_by("report_no", "id").alias("report_no")
        ).withColumn("table_name", F.lit(name)))
    return out


def _next_counters(counters: DataFrame, accepted: DataFrame, year: int) -> DataFrame:
    none = F.lit(None).cast("string")
    last = {
        "lab_reports": (F.col("report_id"), F.col("report_no"), F.lit(year)),
        "lab_report_panels": (F.col("_n_panels") + F.size("_panels") - 1, none, none),
        "lab_report_results": (F.col("_n_results") + F.size("_results") - 1, none, none),
        "lab_report_forms": (F.col("_n_forms") + F.size("_forms") - 1, none, none),
    }
    entries = F.inline(F.array(*[
        F.struct(
            F.lit(n).alias("table_name"), y.cast("int").alias("year"), i.cast("bigint").alias("id"),
            no.alias("report_no"),
        )
        for n, (i, no, y) in last.items()
    ]))
    return (
        accepted.select(entries).filter(F.col("id").isNotNull()).unionByName(counters)
        .groupBy("table_name", "year")
        .agg(F.max("id").alias("id"), F.max_by("report_no", "id").alias("report_no"))
    )


def streamed_tables(
    spark: SparkSession, out_path: str, images: DataFrame | None = None
) -> Tables:
    """The rows saved by the stream so far, and `images` with the attachments of all batches. Only
    batches whose counters are stored count: they are written last, so a batch that is still being
    written, or that died half-way, is not seen."""
    done = spark.read.schema(f"{COUNTERS}, batch BIGINT").parquet(f"{out_path}/_counters")
    done = done.select("batch").distinct()

    def saved(name: str, ddl: str) -> DataFrame:
        rows = spark.read.schema(f"{ddl}, batch BIGINT").parquet(f"{out_path}/{name}")
        return rows.join(done, "batch", "left_semi")

    def rows(name: str) -> DataFrame:
        columns = [c for c, _ in columns_of(TABLES[name])]
        return saved(name, TABLES[name]).select(*columns, "batch")

    def attached() -> DataFrame:
        asked = saved("_attachments", "seq BIGINT, report_id BIGINT, image_ids ARRAY<BIGINT>")
        # ids rise with arrival across batches
        return attach_images(images, asked.withColumn("seq", F.col("report_id")), "create")

    makers = {n: (lambda n=n: rows(n)) for n in NUMBERED}
    if images is not None:
        makers["lab_report_images"] = attached
    return Tables(makers)
