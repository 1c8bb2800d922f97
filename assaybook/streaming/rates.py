"""Who asks too often: calls beyond a limit per client and window of a minute.

Windows start with the clock, or with the first call after the last window's end, as request limiters count them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import stored as _stored

# Calls per client and 60 seconds.
LOGIN_LIMIT, UPLOAD_LIMIT = 20, 30


def first_call_windows(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Adds window_start to calls(client, at, ...): a client's first call opens a window of so many seconds, the first
    call after its end the next one.

    Which calls open windows hangs on all earlier ones of the client, so it is found by pointer doubling: every call
    knows the first call a window later, then the one 2, 4, 8 windows later. A call after a pause of a whole
    window opens one whatever came before, so pointers end there, and the number of rounds is the logarithm of the
    longest unbroken run of windows.

    Time is cut into slots as long as a window. A slot holds one opening at most, so the work of a busy client is
    split by slots: pointers lead from a slot into the next or over a pause of slots, and a call belongs to the
    opening of its own slot or of the one before. Per client only slots are ordered, which are as many as its time has
    minutes. Rows with a null client or time are dropped.
    """
    length = seconds * 1_000_000
    named = calls.filter(F.col("client").isNotNull() & F.col("at").isNotNull())
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    times = _stored(
        named.select("client", micros.alias("t")).distinct().withColumn("slot", _slot(F.col("t"), length)), "call-times"
    )
    by_slot = Window.partitionBy("client").orderBy("slot")
    slots = _stored(times.groupBy("client", "slot").agg(F.min("t").alias("first"), F.max("t").alias("last")).select(
        "client", "slot", "first",
        (F.col("first") - F.lag("last").over(by_slot) < length).alias("_close"), F.lead("first").over(by_slot).alias("_next"),
    ), "call-slots")
    # the first call of a slot opens a window for sure when a pause is before it
    sure = slots.filter(~F.coalesce("_close", F.lit(False))).select("client", F.col("first").alias("t"))
    edges = _stored(_pointers(times, slots, length).join(sure.withColumnRenamed("t", "to"), ["client", "to"], "left_anti"), "call-pointers")
    opened = _stored(sure, "openings")
    while True:
        new = _stored(
            opened.join(edges, ["client", "t"]).select("client", F.col("to").alias("t")).join(opened, ["client", "t"], "left_anti").distinct(),
            "openings",
        )
        if new.isEmpty():
            break
        opened = opened.unionByName(new)
        twice = edges.select("client", F.col("t").alias("from"), F.col("to").alias("t")).join(edges, ["client", "t"])
        edges = _stored(twice.select("client", F.col("from").alias("t"), "to"), "call-pointers")
    openings = opened.select("client", _slot(F.col("t"), length).alias("_slot"), F.col("t").alias("_open"))
    return _placed(named, openings, micros, length)


def _slot(t: Column, length: int) -> Column:
    return F.floor(t / F.lit(length)).cast("bigint")


def _pointers(times: DataFrame, slots: DataFrame, length: int) -> DataFrame:
    """(client, t, to): the first call at least a window after t."""
    # calls and the ends of windows in one line per slot: walking back, the last call seen is the next after an end
    probes = times.select("client", (F.col("slot") + 1).alias("slot"), (F.col("t") + length).alias("x"), "t")
    points = times.select("client", "slot", F.col("t").alias("x"), F.lit(None).cast("bigint").alias("t"))
    back = Window.partitionBy("client", "slot").orderBy(F.desc("x"), F.desc_nulls_first("t")).rowsBetween(Window.unboundedPreceding, 0)
    call = F.when(F.col("t").isNull(), F.col("x"))
    walked = probes.unionByName(points).withColumn("to", F.last(call, ignorenulls=True).over(back)).filter(F.col("t").isNotNull())
    here = walked.filter(F.col("to").isNotNull()).select("client", "t", "to")
    # nothing left in the slot where the window ends: the next slot that has a call, if the client has one
    own = (F.col("slot") - 1).alias("own")
    later = walked.filter(F.col("to").isNull()).select("client", "t", own, "slot")
    after_own = slots.select("client", F.col("slot").alias("own"), F.col("_next").alias("n1"))
    after_end = slots.select("client", "slot", F.col("_next").alias("n2"))
    over = later.join(after_own, ["client", "own"]).join(after_end, ["client", "slot"], "left")
    # the slot after the call's own is the one that was walked, unless it is empty
    to = F.when(_slot(F.col("n1"), length) == F.col("slot"), F.col("n2")).otherwise(F.col("n1"))
    return here.unionByName(over.select("client", "t", to.alias("to")).filter(F.col("to").isNotNull()))


def _placed(calls: DataFrame, openings: DataFrame, micros: Column, length: int) -> DataFrame:
    """window_start of every call: the opening of its own slot if that is no later, else of the slot before."""
    rows = calls.withColumn("_t", micros).withColumn("_slot", _slot(F.col("_t"), length))
    before = openings.select("client", (F.col("_slot") + 1).alias("_slot"), F.col("_open").alias("_before"))
    both = openings.join(before, ["client", "_slot"], "full")
    both = _stored(both, "openings")
    start = F.when(F.col("_open") <= F.col("_t"), F.col("_open")).otherwise(F.col("_before"))
    return rows.join(both, ["client", "_slot"]).withColumn(
        "window_start", F.timestamp_micros(start).cast("timestamp_ntz")
    ).select(*calls.columns, "window_start")


def clock_windows(calls: DataFrame, window: str = "60 seconds") -> DataFrame:
    """Adds window_start: the clock's own windows."""
    return calls.withColumn("window_start", F.window(F.col("at"), window)["start"].cast("timestamp_ntz"))


KEY = ["client", "window_start"]


def last_allowed(rows: DataFrame, limit: int) -> DataFrame:
    """client, window_start and _edge, the (at, id) of the last call that is allowed, where there are so many calls."""
    first = Window.partitionBy(*KEY).orderBy("at", "id")
    edge = rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit)
    return edge.filter(F.col("_n") == limit).select(*KEY, F.struct("at", "id").alias("_edge"))


def rate_limit_audit(
    calls: DataFrame, limit: int, window: str = "60 seconds", windows: str = "clock"
) -> DataFrame:
    """calls(client, at, id) -> the calls that are refused: all after the first `limit` of their client and window, by
    time then id. Adds window_start. windows: 'clock', or 'first_call' for windows that a client's call opens (their
    length is then whole seconds).

    The last allowed call per client and window comes from a rank cut at `limit`, which Spark
    applies in each task before the shuffle, so a client that makes most of all calls ships only
    `limit` rows per task. It is stored, so that the join that compares all calls with it may broadcast it or split a
    busy client and window by the sizes measured at run time.
    """
    if windows == "clock":
        rows = clock_windows(calls, window)
    elif windows == "first_call":
        rows = _stored(first_call_windows(calls, _seconds(window)), "windowed-calls")
    else:
        raise ValueError(f"unknown windows {windows!r}")
    edge = _stored(last_allowed(rows, limit), "last-allowed")
    return rows.join(edge, KEY).filter(
        F.struct("at", "id") > F.col("_edge")
    ).select("client", "at", "id", "window_start")


def _seconds(window: str) -> int:
    number, unit = window.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def refusal_stream(
    calls: DataFrame, limit: int, out_path: str, window: str = "60 seconds", late: str = "60 seconds",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """The refused calls themselves, of a stream of calls(client, at, id), windows by the clock; runs until all that is
    there is done.

    A window is settled when the watermark (the latest time seen, less `late`) has passed its end; then its
    calls are audited as a batch, so a busy client and window is spread as there. Until then its calls are kept in the
    output folder. A call that comes when its window is settled changes nothing and is noted under late/.
    Each micro-batch writes folders of its own, with overwrite, and reads only those of the batch before it: one that
    is run again replaces what it wrote. refused_calls reads the result.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        settle_batch(batch, batch_id, limit, out_path, window, late)

    return (
        calls.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint or f"{out_path}/_checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def settle_batch(batch: DataFrame, batch_id: int, limit: int, out_path: str, window: str, late: str) -> None:
    """One micro-batch of refusal_stream."""
    spark = batch.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        place = f"{out_path}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    named = batch.filter(F.col("client").isNotNull() & F.col("at").isNotNull()).select("client", F.col("at").cast("timestamp_ntz").alias("at"), "id")
    new = stored(clock_windows(named, window), "calls")
    before = _mark(spark, out_path, batch_id - 1)
    seen = new.agg(F.max("at").alias("at")).first()["at"]
    mark = before if seen is None else max(filter(None, (before, seen - dt.timedelta(seconds=_seconds(late)))))
    length = F.make_dt_interval(secs=F.lit(_seconds(window)).cast("decimal(18,6)"))
    end = F.col("window_start") + length
    settled = F.lit(False) if before is None else end <= F.lit(before)
    stored(new.filter(settled), "late")
    waiting = new.filter(~settled)
    if before is not None:
        waiting = waiting.unionByName(spark.read.schema(new.schema).parquet(f"{out_path}/open/batch={batch_id - 1}"))
    waiting = stored(waiting, "waiting")
    closing = F.lit(False) if mark is None else end <= F.lit(mark)
    stored(rate_limit_audit(waiting.filter(closing).drop("window_start"), limit, window), "refused")
    stored(waiting.filter(~closing), "open")
    stored(spark.createDataFrame([(mark,)], "mark TIMESTAMP_NTZ"), "marks")


def _mark(spark: SparkSession, out_path: str, batch_id: int) -> dt.datetime | None:
    """The watermark after a batch."""
    if batch_id < 0:
        return None
    return spark.read.schema("mark TIMESTAMP_NTZ").parquet(f"{out_path}/marks/batch={batch_id}").first()["mark"]


def refused_calls(spark: SparkSession, out_path: str, limit: int, window: str = "60 seconds", settle: bool = False) -> DataFrame:
    """Refused calls of settled windows; with settle, the open windows are judged too, as if no call came any more."""
    done = spark.read.parquet(f"{out_path}/marks")
    last = done.agg(F.max("batch").alias("batch")).first()["batch"]
    refused = spark.read.parquet(f"{out_path}/refused").filter(F.col("batch") <= last).drop("batch")
    if not settle:
        return refused
    rest = spark.read.parquet(f"{out_path}/open/batch={last}")
    return refused.unionByName(rate_limit_audit(rest.drop("window_start"), limit, window))


def rate_limit_stream(
    calls: DataFrame, limit: int, window: str = "60 seconds", late: str = "60 seconds"
) -> DataFrame:
    """Streaming form: one row per client and window with more than `limit` calls, given out
    when the watermark passes the window."""
    return (
        calls.withWatermark("at", late)
        .groupBy("client", F.window("at", window).alias("window"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .filter(F.col("calls") > limit)
        .select(
            "client", F.col("window.start").alias("window_start"), "calls",
            (F.col("calls") - limit).alias("refused"),
        )
    )
