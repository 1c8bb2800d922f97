"""Species, reference ranges, measured values and the out-of-range flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, first_text, or_null, trim

BLANK = " - "
_NUM = r"-?[0-9]+(?:\.[0-9]+)?"
_RANGE = rf"({_NUM}){SPACE_CLASS}*-{SPACE_CLASS}*({_NUM})"


def normalize_species(c: Column) -> Column:
    k = F.lower(trim(c))
    return (
        F.when(k.isin("cat", "feline"), F.lit("Cat"))
        .when(k.isin("dog", "canine"), F.lit("Dog"))
        .otherwise(F.coalesce(c, F.lit("")))
    )


def is_cat(species: Column) -> Column:
    return F.coalesce(F.lower(trim(species)).isin("cat", "feline"), F.lit(False))


def dog_range(dog: Column, legacy: Column) -> Column:
    return first_text(dog, legacy, default="")


def cat_range(cat: Column, legacy: Column) -> Column:
    return first_text(cat, legacy, default="")


def reference_for(species: Column, dog: Column, cat: Column, legacy: Column) -> Column:
    return F.when(is_cat(species), cat_range(cat, legacy)).otherwise(dog_range(dog, legacy))


def parse_range(c: Column) -> Column:
    """struct<min,max> of the first 'number - number', or null."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), "[–—]", "-")
    s = F.regexp_replace(s, f"(?i){SPACE_CLASS}+to{SPACE_CLASS}+", "-")
    a = or_null(F.regexp_extract(s, _RANGE, 1)).try_cast("double")
    b = or_null(F.regexp_extract(s, _RANGE, 2)).try_cast("double")
    return F.when(
        a.isNotNull() & b.isNotNull(),
        F.struct(F.least(a, b).alias("min"), F.greatest(a, b).alias("max")),
    )


def parse_result(c: Column) -> Column:
    """First number in the text, or null ('N/A' and dashes hold no digits)."""
    return F.regexp_substr(c, F.lit(_NUM)).try_cast("double")


def outside(n: Column, bounds: Column) -> Column:
    return F.coalesce((n < bounds["min"]) | (n > bounds["max"]), F.lit(False))


def is_out_of_range(value: Column, reference: Column) -> Column:
    return outside(parse_result(value), parse_range(reference))


def display_value(c: Column) -> Column:
    return F.coalesce(or_null(trim(c)), F.lit(BLANK))
