"""Lab-shaped views over the given TPC-H-like tables (see FIXTURES.md section 3)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.schemas import conform
from assaybook.sources.tables import Tables

AS_OF = "2026-03-05 14:07:09"


# The columns of the given tables that the views use.
RAW = {
    "supplier": "s_suppkey BIGINT, s_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
    "documents": "doc_id BIGINT, lang STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT",
}


def text(c: Column) -> Column:
    return c.cast("string")


def pick(n: Column, options: dict[int, Column | str | None], other: Column | str | None) -> Column:
    """Value by the remainder n."""
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    out = None
    for k, v in options.items():
        out = F.when(n == k, lit(v)) if out is None else out.when(n == k, lit(v))
    return out.otherwise(lit(other))


class Lab:
    """Lazy views; nothing is read before a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        # declared columns: no schema inference job
        return self.spark.read.schema(RAW[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("s_suppkey")
        return conform(self.raw("supplier").select(
            (k + 1).alias("id"), F.col("s_name").alias("name"),
            F.concat(F.lit(" U"), text(k), F.lit("@Lab.Example ")).alias("email"),
            F.when(k % 10 == 0, "admin").otherwise("staff").alias("role"),
            F.when(k % 7 == 0, 0).otherwise(1).alias("is_active"),
        ), "lab_users")

    @cached_property
    def panels(self) -> DataFrame:
        n = F.col("n")
        codes = {1: "CBC", 2: "LFT", 3: "ULTRASOUND", 4: "SKIN_SCRAPING", 5: "SURGICAL_CONSENT"}
        return conform(
            self.raw("part")
            .select(F.substring("p_brand", 7, 10).cast("bigint").alias("n")).distinct()
            .select(
                n.alias("id"), pick(n, codes, F.concat(F.lit("PANEL_"), text(n))).alias("code"),
                F.concat(F.lit("Panel "), text(n)).alias("name"),
                ((n * 7) % 5).cast("int").alias("display_order"),
                F.when(n % 6 == 0, 0).otherwise(1).alias("is_active"),
            ),
            "lab_test_panels",
        )

    @cached_property
    def params(self) -> DataFrame:
        k, size = F.col("p_partkey"), F.col("p_size")
        s, s20, s10, s15 = text(size), text(size + 20), text(size + 10), text(size + 15)
        dog = pick(k % 6, {
            0: F.concat(s, F.lit(" - "), s20), 1: F.concat(s20, F.lit("–"), s),
            2: F.concat(s, F.lit(" to "), s10), 3: "Not detected", 4: "",
        }, None)
        cat = pick(k % 4, {
            0: "", 1: F.concat(s, F.lit(".5 - "), s15, F.lit(".0")), 2: None,
        }, "0 - 10")
        return conform(self.raw("part").select(
            (k + 1).alias("id"), F.substring("p_brand", 7, 10).cast("bigint").alias("panel_id"),
            F.concat(F.lit("P"), text(k)).alias("code"), F.col("p_name").alias("name"),
            F.when(size % 5 == 0, "").otherwise(F.col("p_type")).alias("unit"),
            dog.alias("reference_range_dog"), cat.alias("reference_range_cat"),
            F.when(k % 3 == 0, "1 - 30").alias("reference_range"),
            (size % 7).alias("display_order"),
            F.when(k % 11 == 0, 0).otherwise(1).alias("is_active"),
        ), "lab_test_parameters")

    @cached_property
    def reports(self) -> DataFrame:
        return conform(self._orders.select(*self._report_columns), "lab_reports")

    @cached_property
    def _orders(self) -> DataFrame:
        return self.raw("orders").join(
            self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")
        )

    @cached_property
    def _report_columns(self) -> list[Column]:
        o, c = F.col("o_orderkey"), F.col("c_custkey")
        phone = pick(c % 5, {
            0: F.concat(F.lit("92300"), text(c + 1000000)),
            1: F.concat(F.lit("+92 300-"), text(c + 999999)),
            2: F.concat(F.lit("0301 "), text(c + 1000000)), 3: None,
        }, "")
        species = (
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Dog")
            .when(F.col("c_mktsegment") == "BUILDING", "canine")
            .when(F.col("c_mktsegment") == "FURNITURE", " CAT ")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "feline").otherwise("Rabbit")
        )
        day = F.col("o_orderdate").cast("date")
        return [
            (o + 1).alias("id"),
            F.concat(F.lit("PZ-"), text(F.year(day)), F.lit("-"), text(o + 1)).alias("report_no"),
            F.when(c % 9 == 0, "").otherwise(F.col("c_name")).alias("patient_name"),
            phone.alias("owner_phone"),
            pick(o % 4, {0: "Rex", 1: " rex ", 2: "MILO"}, "").alias("pet_name"),
            species.alias("species"),
            F.when(c % 4 != 0, F.concat(F.lit("Breed "), text(F.col("c_nationkey")))).alias("breed"),
            F.concat(text(o % 15), F.lit(" years")).alias("age"),
            pick(o % 3, {0: "Male", 1: "Female"}, None).alias("sex"),
            F.when(o % 3 != 0, F.col("o_orderpriority")).alias("referring_vet"),
            F.when(o % 5 != 0, day).alias("sample_date"),
            day.alias("report_date"),
            pick(o % 6, {0: None, 1: ""}, F.concat(F.lit("note "), F.col("o_orderpriority"))).alias("clinical_notes"),
            pick(o % 4, {1: "", 2: None}, F.col("o_orderpriority")).alias("remarks"),
            F.when(F.col("o_orderstatus") == "P", "draft").otherwise("final").alias("status"),
            (F.col("c_nationkey") + 1).cast("bigint").alias("created_by"),
            F.when(o % 7 != 0, F.col("o_orderdate") + F.make_dt_interval(
                secs=(o % 86400).cast("decimal(18,6)")
            )).alias("created_at"),
        ]

    @cached_property
    def results(self) -> DataFrame:
        m, q = F.col("m"), text(F.col("q"))
        return conform(
            self.raw("lineitem").groupBy("l_orderkey", "l_partkey").agg(
                F.min("l_linenumber").alias("m"), F.min(F.col("l_quantity").cast("int")).alias("q")
            ).select(
                (m + F.col("l_orderkey") * 10).alias("id"),
                (F.col("l_orderkey") + 1).alias("report_id"),
                (F.col("l_partkey") + 1).alias("parameter_id"),
                pick(m % 6, {
                    0: None, 1: q, 2: F.concat(q, F.lit(".5 H")), 3: "N/A",
                    4: F.concat(F.lit("<"), q),
                }, "—").alias("value"),
            ),
            "lab_report_results",
        )

    @cached_property
    def report_panels(self) -> DataFrame:
        pairs = (
            self.raw("lineitem").join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                (F.col("l_orderkey") + 1).alias("report_id"),
                F.substring("p_brand", 7, 10).cast("bigint").alias("panel_id"),
            ).distinct()
        )
        r, p = F.col("report_id"), F.col("panel_id")
        return conform(
            pairs.filter((r + p) % 5 != 0).withColumn("id", r * 100 + p), "lab_report_panels"
        )

    @cached_property
    def images(self) -> DataFrame:
        d = F.col("doc_id")
        return conform(self.raw("documents").select(
            (d + 1).alias("id"), F.when(d % 4 != 0, F.floor(d / 2) + 1).alias("report_id"),
            F.concat(F.lit("us-"), text(d), F.lit(".jpg")).alias("stored_name"),
            F.when(d % 3 != 0, F.concat(F.lit("scan "), text(d))).alias("original_name"),
            (d % 20 + 1).alias("created_by"), (F.col("n_chars") % 3).cast("int").alias("display_order"),
        ), "lab_report_images")

    @cached_property
    def form_writes(self) -> DataFrame:
        e, u = F.col("event_id"), text(F.col("user_id"))
        skin = F.concat(
            F.lit('{"lesion_types":["alopecia","'), F.when(e % 2 == 0, "other").otherwise("crusts"),
            F.lit('"],"lesion_other":"L'), u, F.lit('","mites":["demodex","bogus"],"result":"'),
            F.when(e % 5 == 0, "positive").otherwise("negative"), F.lit('","positive_for":"P'), u,
            F.lit('","sample_site":"site '), u, F.lit('"}'),
        )
        us = F.concat(
            F.lit('{"us_types":["urinary","other","bogus"],"us_type_other":" U'), u,
            F.lit(' ","findings":" F'), u, F.lit(' ","impression":""}'),
        )
        blood = F.concat(
            F.lit('{"parasites":["other","babesia"],"parasite_other":" X'), u,
            F.lit(' ","result":["suspected"],"stain":"giemsa"'),
            F.when(e % 2 == 0, ',"examined_by":""').otherwise(""),
            F.lit(',"comments":" C'), u, F.lit(' "}'),
        )
        return self.raw("events").select(
            e.alias("seq"), (F.floor(e / 14) + 1).alias("report_id"),
            pick(e % 3, {0: "SKIN_SCRAPING", 1: "ULTRASOUND"}, "BLOOD_PARASITE").alias("form_code"),
            F.when(e % 13 == 0, "{bad").otherwise(pick(e % 3, {0: skin, 1: us}, blood)).alias("form_json"),
            F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type",
        )

    @cached_property
    def forms(self) -> DataFrame:
        ordinal = (
            F.when(F.col("form_code") == "SKIN_SCRAPING", 0)
            .when(F.col("form_code") == "ULTRASOUND", 1).otherwise(2)
        )
        return conform(
            self.form_writes.groupBy("report_id", "form_code").agg(
                F.max_by("form_json", "seq").alias("form_json"), F.max("ts").alias("updated_at")
            ).withColumn("id", F.col("report_id") * 10 + ordinal),
            "lab_report_forms",
        )

    @cached_property
    def tables(self) -> Tables:
        return Tables({
            "lab_users": lambda: self.users, "lab_test_panels": lambda: self.panels,
            "lab_test_parameters": lambda: self.params, "lab_reports": lambda: self.reports,
            "lab_report_panels": lambda: self.report_panels,
            "lab_report_results": lambda: self.results,
            "lab_report_images": lambda: self.images, "lab_report_forms": lambda: self.forms,
        })

    # -- bodies --------------------------------------------------------------------------------

    @cached_property
    def payloads(self) -> DataFrame:
        """One body per order, some faulty: the create bodies, and with report_id the updates."""
        o, c = F.col("o_orderkey"), F.col("o_custkey")
        no_children, clear = o % 20 == 0, o % 20 == 1
        panel_ids = F.when(no_children, None).when(clear, F.array().cast("array<string>")).otherwise(
            F.array(text(o % 25 + 1), text(o * 7 % 25 + 1), F.lit("x"), F.lit("0"))
        )
        nothing = F.lit(None).cast("string")
        result = lambda pid, value: F.struct(
            pid.alias("parameter_id"), value.alias("value"), nothing.alias("flag"),
            F.when(o % 37 == 0, F.lit("r")).alias("remarks"),
        )
        results = F.when(no_children, None).when(
            clear, F.array().cast("array<struct<parameter_id:string,value:string,flag:string,remarks:string>>")
        ).otherwise(F.array(
            result(text(c % 100 + 1), text(o % 60)),
            result(F.when(o % 29 == 0, "999999999999").otherwise(text(c % 100 + o % 30 + 1)), nothing),
            result(F.lit(""), F.lit("skipped")),
        ))
        image_ids = F.when((o % 4 == 0) & ~no_children, F.array(
            text(F.floor(o / 15) + 1), text(F.floor(o / 20) + 1), F.lit("x")
        ))
        forms = F.when(no_children, None).when(
            clear, F.create_map().cast("map<string,string>")
        ).otherwise(F.create_map(
            F.lit("ULTRASOUND"), F.concat(F.lit('{"findings":"n'), text(o), F.lit('"}')),
            F.lit(""), F.lit("{}"),
        ))
        head = self._orders.select(
            o.alias("seq"), *self._report_columns,
            F.when(o % 50 == 2, "x").when(o % 50 == 3, text(o + 1000000000000))
            .otherwise(text(F.when(o % 10 == 4, o).otherwise(o + 1))).alias("report_id"),
            panel_ids.alias("panel_ids"), results.alias("results"),
            image_ids.alias("image_ids"), forms.alias("forms"),
        ).drop("id", "report_no", "created_by", "created_at")
        return head.withColumns({
            "sample_date": F.when(F.col("seq") % 41 == 0, "soon").otherwise(text(F.col("sample_date"))),
            "report_date": F.when(F.col("seq") % 8 != 0, text(F.col("report_date"))),
        })
