"""Session settings the operators are designed for; all are runtime settings."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # re-plan with real shuffle sizes: broadcast only what was measured to be small,
    # split a partition that one hot key made large, merge tiny ones
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot key even where a later aggregation then needs another shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # two joins on report_id share one shuffle even when one of them has a second key
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}

#: Most bytes of a file split and of a merged shuffle partition. Ids and codes compress well: a byte read becomes 10 to 20 in
#: the hash table or sort of a task, so Spark's 128 and 64 MB would hold 1 GB and more there. Smaller settings are left as they are.
TASK_BYTES = {
    "spark.sql.files.maxPartitionBytes": 32 << 20,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
}


# Only possible when the session is created.
STATIC_SETTINGS = {
    # no call-site bookkeeping for every column expression built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str, partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session on one machine, for tests and measurements."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", memory)
        # small local data: keep all cores busy after a shuffle
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
    )
    for key, value in {**STATIC_SETTINGS, **SETTINGS}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _bytes(size: str) -> int:
    """A size as Spark writes it: 64MB, 8m, 67108864b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([kmgtp]?)i?b?\s*", size.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, most in TASK_BYTES.items():
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def shared_place(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's own checkpoint folder. A session in
    one process (local mode) may do without: it gets a temporary one."""
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not place and context.master.split("[")[0] == "local":
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        place = context.getCheckpointDir()
    if not place:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return place.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one."""
    return f"{shared_place(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back, for frames that several outputs derive from."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
