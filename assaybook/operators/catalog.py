"""The test catalog: reads, seeding, admin changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import is_finite_number, to_active, to_order
from ..functions.text import ci, clean_code, or_null, trim
from ..functions.forms import panel_kind as _panel_kind
from ..schemas import PANEL_TEXT_LIMITS, PARAMETER_TEXT_LIMITS, TABLES, columns_of, conform
from .checks import code_conflicts
from .details import catalog_ranges
from .numbering import with_new_ids, ranked

PANEL_COLUMNS = ("id", "code", "name", "description", "display_order", "is_active")


# -- reads ---------------------------------------------------------------------------------


def full_catalog(panels: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(panels, parameters) with the dog and cat ranges resolved."""
    return panels.select(*PANEL_COLUMNS), catalog_ranges(params)


def active_catalog(panels: DataFrame, params: DataFrame) -> tuple[DataFrame, DataFrame]:
    on = F.col("is_active") == 1
    return full_catalog(panels.filter(on), params.filter(on))


def panels_with_parameters(
    panels: DataFrame, params: DataFrame, active_only: bool = False
) -> DataFrame:
    """Flat catalog: every panel with its parameters, one row with nulls for an empty panel.
    Order: panel id, then parameter display_order and id."""
    ps, qs = (active_catalog if active_only else full_catalog)(panels, params)
    qs = qs.select(
        "panel_id",
        *[
            F.col(c).alias(f"parameter_{c}")
            for c, _ in columns_of(TABLES["lab_test_parameters"]) if c != "panel_id"
        ],
    )
    return ps.withColumnRenamed("id", "panel_id").join(qs, "panel_id", "left")


def panel_parameter_counts(
    panels: DataFrame, params: DataFrame, active_only: bool = False
) -> DataFrame:
    ps, qs = (active_catalog if active_only else full_catalog)(panels, params)
    counts = qs.groupBy("panel_id").agg(F.count(F.lit(1)).alias("_n"))
    return ps.withColumnRenamed("id", "panel_id").join(counts, "panel_id", "left").select(
        "panel_id", "code", "name", "is_active",
        F.coalesce(F.col("_n"), F.lit(0)).alias("parameters"),
    )


def catalog_order(panels: DataFrame) -> DataFrame:
    """id, code and place of every panel by display order, then id."""
    rows = panels.select("id", "code", F.coalesce("display_order", F.lit(0)).alias("_order"))
    return ranked(rows, "_order", "id", "place").drop("_order")


def panel_kind(panels: DataFrame) -> DataFrame:
    return panels.select("id", "code", _panel_kind(F.col("code")).alias("kind"))


# -- seeding -------------------------------------------------------------------------------


def _same_code(code: str) -> Column:
    return ci(F.col("code")) == ci(F.lit(code))


def seed_if_empty(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The existing rows, or `rows` when there are none."""
    held = existing.select(F.lit(1).alias("n")).limit(1).agg(F.count("n").alias("n")).scalar()
    new = rows.filter(held == 0)
    return existing.unionByName(new, allowMissingColumns=True)


def seed_parameters(params: DataFrame, panels: DataFrame, literals: DataFrame) -> DataFrame:
    """Adds the literals (panel_code, code, ...) whose panel exists and that the panel lacks.
    The general range is the dog range."""
    found = literals.withColumn("_k", ci(F.col("panel_code"))).join(
        panels.select(F.col("id").alias("panel_id"), ci(F.col("code")).alias("_k")), "_k"
    ).drop("_k")
    lacking = found.withColumn("_k", ci(F.col("code"))).join(
        params.select("panel_id", ci(F.col("code")).alias("_k")), ["panel_id", "_k"], "left_anti"
    ).drop("_k")
    new = with_new_ids(lacking, params, ["panel_id", "display_order", "code"]).withColumns(
        {"reference_range": F.col("reference_range_dog"), "is_active": F.lit(1)}
    )
    return params.unionByName(conform(new, "lab_test_parameters"))


def retire_parameters(params: DataFrame, panels: DataFrame, code: str) -> DataFrame:
    """All parameters of the panel with that code become inactive."""
    hit = panels.filter(_same_code(code)).select(
        F.col("id").alias("panel_id"), F.lit(True).alias("_hit")
    )
    return params.join(hit, "panel_id", "left").withColumn(
        "is_active", F.when(F.col("_hit"), F.lit(0)).otherwise(F.col("is_active"))
    ).select(*params.columns)


def upsert_panels(
    panels: DataFrame, rows: DataFrame, columns: Sequence[str], activate: bool = False
) -> DataFrame:
    """Rows (code, name, description, display_order) update `columns` of the panel with the same
    code (and switch it on with `activate`), or become new active panels. Codes are unique in
    `rows`."""
    new = rows.withColumn("_k", ci(F.col("code")))
    old = panels.withColumn("_k", ci(F.col("code")))
    updates = new.select("_k", F.struct(*columns).alias("_u"))
    joined = old.join(updates, "_k", "left")
    hit = F.col("_u").isNotNull()
    kept = joined.withColumns({
        **{c: F.when(hit, F.col(f"_u.{c}")).otherwise(F.col(c)) for c in columns},
        **(
            {"is_active": F.when(hit, F.lit(1)).otherwise(F.col("is_active"))} if activate else {}
        ),
    }).select(*panels.columns)
    fresh = new.join(old.select("_k"), "_k", "left_anti").drop("_k")
    fresh = with_new_ids(fresh, panels, ["display_order", "code"]).withColumn(
        "is_active", F.lit(1)
    )
    return kept.unionByName(conform(fresh, "lab_test_panels").select(*panels.columns))


def evolve_schema(params: DataFrame) -> DataFrame:
    """Adds the dog and cat range columns when missing."""
    return conform(params, "lab_test_parameters")


def backfill_ranges(params: DataFrame, panels: DataFrame, changes: DataFrame) -> DataFrame:
    """In order: a blank dog range takes the general one; (panel_code, code, dog, cat) changes
    set both ranges; where a dog range is set the general one follows it."""
    p = evolve_schema(params)
    p = p.withColumn("reference_range_dog", F.when(
        or_null(F.col("reference_range_dog")).isNull() & F.col("reference_range").isNotNull(),
        F.col("reference_range"),
    ).otherwise(F.col("reference_range_dog")))
    table = changes.withColumn("_pk", ci(F.col("panel_code"))).join(
        panels.select(F.col("id").alias("panel_id"), ci(F.col("code")).alias("_pk")), "_pk"
    ).select("panel_id", ci(F.col("code")).alias("_k"), "dog", "cat")
    p = p.withColumn("_k", ci(F.col("code"))).join(table, ["panel_id", "_k"], "left")
    dog = F.coalesce(F.col("dog"), F.col("reference_range_dog"))
    return p.withColumns({
        "reference_range_dog": dog,
        "reference_range_cat": F.coalesce(F.col("cat"), F.col("reference_range_cat")),
        "reference_range": F.coalesce(dog, F.col("reference_range")),
    }).select(*[c for c, _ in columns_of(TABLES["lab_test_parameters"])])


# -- admin changes -------------------------------------------------------------------------


def _too_long(limits: Mapping[str, int]) -> Column:
    out = F.lit(None).cast("string")
    for name, n in limits.items():
        out = F.when(F.length(name) > n, F.lit(f"too_long:{name}")).otherwise(out)
    return out


def _text(name: str) -> Column:
    return trim(F.coalesce(F.col(name), F.lit("")))


def _create(
    rows: DataFrame, current: DataFrame, keys: Sequence[str], table: str, limits: Mapping[str, int]
) -> tuple[DataFrame, DataFrame]:
    reason = F.coalesce(
        F.col("_reason"),
        F.when((F.col("code") == "") | (F.col("name") == ""), F.lit("code_and_name_required")),
        F.when(F.col("display_order").isNull(), F.lit("order_out_of_range")),
        _too_long(limits),
    )
    checked = rows.withColumn("reject_reason", reason).drop("_reason")
    bad = checked.filter(F.col("reject_reason").isNotNull())
    good = checked.filter(F.col("reject_reason").isNull())
    accepted, taken = code_conflicts(good, current, keys)
    new = with_new_ids(accepted, current, ["seq"]).withColumn("is_active", F.lit(1))
    rejects = bad.unionByName(taken.withColumn("reject_reason", F.lit("code_exists")))
    return (
        current.unionByName(conform(new, table).select(*current.columns)),
        rejects.select("seq", "code", "name", "reject_reason"),
    )


def create_panels(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """changes(seq, code, name, description, display_order as text) -> (next panels, rejects)."""
    rows = changes.select(
        "seq", clean_code(F.col("code")).alias("code"), _text("name").alias("name"),
        or_null(_text("description")).alias("description"),
        to_order(F.col("display_order"), 0).alias("display_order"),
        F.lit(None).cast("string").alias("_reason"),
    )
    return _create(rows, current, ["code"], "lab_test_panels", PANEL_TEXT_LIMITS)


def create_parameters(
    current: DataFrame, panels: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """changes(seq, panel_id, code, name, unit, reference_range_dog, reference_range_cat,
    display_order as text) -> (next parameters, rejects). The general range is the dog range."""
    known = panels.select(F.col("id").alias("panel_id"), F.lit(True).alias("_known"))
    dog = or_null(_text("reference_range_dog"))
    rows = changes.join(known, "panel_id", "left").select(
        "seq", "panel_id", clean_code(F.col("code")).alias("code"), _text("name").alias("name"),
        or_null(_text("unit")).alias("unit"),
        dog.alias("reference_range_dog"),
        or_null(_text("reference_range_cat")).alias("reference_range_cat"),
        dog.alias("reference_range"),
        to_order(F.col("display_order"), 0).alias("display_order"),
        F.when(F.col("_known").isNull(), F.lit("panel_not_found")).alias("_reason"),
    )
    return _create(
        rows, current, ["panel_id", "code"], "lab_test_parameters", PARAMETER_TEXT_LIMITS
    )


def _patch(
    current: DataFrame, changes: DataFrame, texts: Sequence[str], limits: Mapping[str, int]
) -> tuple[DataFrame, DataFrame]:
    """changes(seq, id, fields map<string,string>); a field is supplied when its key is present.

    Whole patches with a blank name are refused. What is left is independent per field: the last
    patch that supplies a usable value wins, so one aggregation composes any number of patches.
    """
    f = F.col("fields")

    def given(name: str) -> Column:
        return F.map_contains_key(f, name)

    def value(name: str) -> Column:
        return F.try_element_at(f, F.lit(name))

    name = trim(F.coalesce(value("name"), F.lit("")))
    order, active = to_order(value("display_order"), 0), value("is_active")
    long = F.lit(None).cast("string")
    for field, n in limits.items():
        if field != "code":
            long = F.when(
                given(field) & (F.length(trim(value(field))) > n), F.lit(f"too_long:{field}")
            ).otherwise(long)
    reason = F.coalesce(
        F.when(given("name") & (name == ""), F.lit("name_required")),
        F.when(given("display_order") & order.isNull(), F.lit("order_out_of_range")),
        long,
    )
    ids = current.select("id", F.col("name").alias("_old_name"))
    checked = changes.join(ids, "id", "left").withColumn("reject_reason", F.coalesce(
        F.when(F.col("_old_name").isNull(), F.lit("not_found")),
        reason,
        F.when(~given("name") & (F.col("_old_name") == ""), F.lit("name_required")),
    ))
    good = checked.filter(F.col("reject_reason").isNull())

    def last(col: Column, when: Column) -> Column:
        return F.max_by(F.struct(col.alias("v")), F.when(when, F.col("seq")))

    picks = {"name": last(name, given("name"))}
    for t in texts:
        picks[t] = last(or_null(trim(F.coalesce(value(t), F.lit("")))), given(t))
    picks["display_order"] = last(
        order, given("display_order") & is_finite_number(value("display_order"))
    )
    picks["is_active"] = last(
        to_active(active, 0), given("is_active") & or_null(active).isNotNull()
    )
    patch = good.groupBy("id").agg(*[c.alias(f"_p_{n}") for n, c in picks.items()])
    patched = current.join(patch.withColumn("_hit", F.lit(True)), "id", "left").withColumns({
        n: F.when(F.col(f"_p_{n}").isNotNull(), F.col(f"_p_{n}.v")).otherwise(F.col(n))
        for n in picks
    })
    return patched, checked.filter(F.col("reject_reason").isNotNull()).select(
        "seq", "id", "reject_reason"
    )


def patch_panels(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    patched, rejects = _patch(current, changes, ["description"], PANEL_TEXT_LIMITS)
    return patched.select(*current.columns), rejects


def patch_parameters(current: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As patch_panels; every accepted patch also sets the general range to the dog range."""
    patched, rejects = _patch(
        current, changes, ["unit", "reference_range_dog", "reference_range_cat"],
        PARAMETER_TEXT_LIMITS,
    )
    return patched.withColumn("reference_range", F.when(
        F.col("_hit"), F.col("reference_range_dog")
    ).otherwise(F.col("reference_range"))).select(*current.columns), rejects


def set_active(current: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(seq, id, is_active): switches rows on or off, last change per id wins."""
    last = changes.groupBy("id").agg(F.max_by("is_active", "seq").alias("_on"))
    return current.join(last, "id", "left").withColumn(
        "is_active", F.coalesce((F.col("_on") != 0).cast("int"), F.col("is_active"))
    ).select(*current.columns)
