"""Owner and pet directories that follow arriving and deleted reports: stored partial states.

A state holds, for a key and a span of 2^SPAN_BITS report ids, what the directory needs of these reports: the newest known
texts with their ids, the newest report, the number of reports. States of one key merge into one, so new reports only
add states, and a delete works out again the states of its own keys and spans from the reports that are left.

States lie in hash partitions of the owner's key. A change reads and replaces only the partitions of its keys (see
sources.partitioned). It is named: its result is stored under its name before it is moved in, so a change that is
repeated after a failure moves the same result in once more and counts nothing twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import or_null
from ..sources.partitioned import overwrite_buckets
from .directory import PET_FIELDS, _keyed

SPAN_BITS = 20
BUCKETS = 64
OWNER_TEXTS = ("patient_name", "owner_phone", "referring_vet")
OWNERS = "owner_key STRING, span BIGINT, " + ", ".join(f"{c} STRUCT<id: BIGINT, text: STRING>" for c in OWNER_TEXTS) + ", last_report_id BIGINT, reports BIGINT"
PETS = "owner_key STRING, pet_key STRING, span BIGINT, newest STRUCT<id: BIGINT, " + ", ".join(f"{c}: STRING" for c in PET_FIELDS) + ", report_date: DATE>"


def _span() -> Column:
    return F.shiftright("id", SPAN_BITS).alias("span")


def owner_states(keyed: DataFrame) -> DataFrame:
    """One state per owner and span of ids, of reports with their keys."""
    def newest(c: str) -> Column:
        text = or_null(F.col(c))
        return F.max(F.when(text.isNotNull(), F.struct("id", text.alias("text")))).alias(c)

    return keyed.groupBy("owner_key", _span()).agg(
        *[newest(c) for c in OWNER_TEXTS], F.max("id").alias("last_report_id"), F.count(F.lit(1)).alias("reports")
    )


def pet_states(keyed: DataFrame) -> DataFrame:
    """One state per owner, pet and span of ids, of reports with their keys."""
    return keyed.groupBy("owner_key", "pet_key", _span()).agg(F.max(F.struct("id", *PET_FIELDS, "report_date")).alias("newest"))


def _merged_owners(states: DataFrame, *key: str) -> DataFrame:
    return states.groupBy(*key).agg(
        *[F.max(c).alias(c) for c in OWNER_TEXTS], F.max("last_report_id").alias("last_report_id"), F.sum("reports").alias("reports")
    )


def _merged_pets(states: DataFrame, *key: str) -> DataFrame:
    return states.groupBy(*key).agg(F.max("newest").alias("newest"))


KINDS = {
    "owners": (OWNERS, owner_states, _merged_owners, ("owner_key", "span")),
    "pets": (PETS, pet_states, _merged_pets, ("owner_key", "pet_key", "span")),
}


class ReportDirectory:
    """The directories of one folder of stored states."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("owner_key"), F.lit(self.buckets)).cast("int")

    def _states(self, kind: str, numbers: list[int] | None = None) -> DataFrame:
        ddl = KINDS[kind][0]
        try:
            rows = self.spark.read.schema(f"{ddl}, bucket INT").parquet(f"{self.path}/{kind}")
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{ddl}, bucket INT")
        if numbers is not None:
            rows = rows.filter(F.col("bucket").isin(numbers))
        return rows.filter(F.col("owner_key").isNotNull()).drop("bucket")

    def _stored(self, df: DataFrame, place: str) -> DataFrame:
        df.write.mode("overwrite").parquet(place)
        return self.spark.read.schema(df.schema).parquet(place)

    def _replace(self, name: str, keys: DataFrame, change) -> None:
        """Stores what `change(kind, states of the partitions of keys)` makes of them, then moves it in."""
        stage = f"{self.path}/_changes/{name}"
        done = f"{stage}/done"
        try:  # written last: a change that is repeated has its result already
            numbers = [r["bucket"] for r in self.spark.read.schema("bucket INT").parquet(done).collect()]
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            numbers = sorted(r["b"] for r in keys.select(self._bucket().alias("b")).distinct().collect())  # at most one for each bucket
            for kind in KINDS:
                rows = change(kind, self._states(kind, numbers)).withColumn("bucket", self._bucket())
                rows.write.mode("overwrite").parquet(f"{stage}/{kind}")
            self.spark.createDataFrame([(b,) for b in numbers], "bucket INT").write.mode("overwrite").parquet(done)
        for kind, (ddl, *_) in KINDS.items():
            overwrite_buckets(self.spark.read.schema(f"{ddl}, bucket INT").parquet(f"{stage}/{kind}"), f"{self.path}/{kind}", numbers)

    def add(self, reports: DataFrame, name: str) -> None:
        """Merges the states of new reports in. name: of this change, never used for another one. The reports are read once:
        both kinds of states and the partitions come from a stored copy with their keys."""
        arrived = self._stored(_keyed(reports), f"{self.path}/_changes/{name}/reports")

        def change(kind: str, old: DataFrame) -> DataFrame:
            _, states, merged, key = KINDS[kind]
            return merged(old.unionByName(states(arrived)), *key)

        self._replace(name, arrived.select("owner_key"), change)

    def remove(self, removed: DataFrame, left: DataFrame, name: str) -> None:
        """Takes reports out: removed holds them, left all reports that stay. Of these, only those of the same owners and
        spans of ids are worked on."""
        gone = self._stored(_keyed(removed).select("owner_key", "pet_key", _span()).distinct(), f"{self.path}/_changes/{name}/keys")
        pairs = gone.select("owner_key", "span").distinct()
        ends = gone.agg(F.min("span").alias("a"), F.max("span").alias("z")).first()
        if ends["a"] is None:
            return
        # whole spans, so that the bounds reach the scan
        near = left.filter((F.col("id") >= ends["a"] << SPAN_BITS) & (F.col("id") < (ends["z"] + 1) << SPAN_BITS))
        again = self._stored(
            _keyed(near).withColumn("span", _span()).join(pairs, ["owner_key", "span"], "left_semi").drop("span"),
            f"{self.path}/_changes/{name}/reports",
        )

        def change(kind: str, old: DataFrame) -> DataFrame:
            kept = old.join(pairs, ["owner_key", "span"], "left_anti")
            return kept.select(*old.columns).unionByName(KINDS[kind][1](again))

        self._replace(name, gone, change)

    def owners(self) -> DataFrame:
        """What owner_directory gives for all reports together."""
        return _merged_owners(self._states("owners"), "owner_key").select(
            "owner_key", *[F.coalesce(F.col(f"{c}.text"), F.lit("")).alias(c) for c in OWNER_TEXTS], "last_report_id", "reports"
        )

    def pets(self) -> DataFrame:
        """What pet_directory gives for all reports together."""
        return _merged_pets(self._states("pets"), "owner_key", "pet_key").select(
            "owner_key", "pet_key", *[F.coalesce(F.col(f"newest.{c}"), F.lit("")).alias(c) for c in PET_FIELDS],
            F.col("newest.id").alias("last_report_id"), F.col("newest.report_date").alias("last_report_date"),
        )
