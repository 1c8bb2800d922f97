"""Number rules: ids, display order, active flag, list limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CLASS, or_null, trim

_DECIMAL = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
DECIMAL = rf"^{_DECIMAL}\z"


def js_number(c: Column) -> Column:
    """Text to double: blank and null are 0, anything that is not a number is null."""
    t = trim(F.coalesce(c, F.lit("")))

    def based(prefix: str, digits: str, base: int) -> tuple[Column, Column]:
        return (
            t.rlike(rf"^0[{prefix}][{digits}]+\z"),
            F.conv(F.substr(t, F.lit(3)), base, 10).cast("double"),
        )

    out = F.when(t == "", F.lit(0.0)).when(t.rlike(DECIMAL), t.try_cast("double"))
    for test, value in (based("xX", "0-9a-fA-F", 16), based("oO", "0-7", 8), based("bB", "01", 2)):
        out = out.when(test, value)
    return out.when(
        t.rlike(r"^[+-]?Infinity\z"),
        F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )


def is_finite_number(c: Column) -> Column:
    return F.coalesce(F.abs(js_number(c)) < F.lit(float("inf")), F.lit(False))


def to_order(c: Column, fallback: Column | int = 0) -> Column:
    """Whole number, truncated toward zero; not finite -> fallback; outside INT -> null."""
    n = js_number(c)
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    whole = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
    return F.when(
        is_finite_number(c), F.when(F.abs(n) < 2147483648.0, whole).try_cast("int")
    ).otherwise(fb.cast("int"))


def to_active(c: Column, fallback: Column | int = 1) -> Column:
    """Missing or '' -> fallback, nonzero number (or JSON true) -> 1, otherwise 0."""
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    on = (F.coalesce(js_number(c), F.lit(0.0)) != 0) | (c == "true")
    return F.when(or_null(c).isNull(), fb.cast("int")).otherwise(on.cast("int"))


_ZERO = rf"[+-]?[0.]+(?:[eE][+-]?[0-9]+)?{SPACE_CLASS}*\z"
_ID = rf"^{SPACE_CLASS}*(?!{_ZERO}){_DECIMAL}{SPACE_CLASS}*\z"


def to_id(c: Column) -> Column:
    """Id text to whole number; 0, blank and non-numbers are null. Decimal notation only.
    Tested before it is cast: a failing cast costs far more than the test."""
    return F.when(c.rlike(_ID), F.rint(trim(c).try_cast("double")).try_cast("bigint"))


def clean_ids(ids: Column) -> Column:
    return F.filter(F.transform(ids, to_id), lambda x: x.isNotNull())


def is_numeric_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9]+\z"), F.lit(False))


def list_limit(value: str | int | None) -> int | None:
    """A limit as it was asked for: none or blank is no limit, anything but a whole number of 0 or more raises."""
    text = str(value if value is not None else "").strip()
    if not text:
        return None
    if not text.isascii() or not text.isdigit():
        raise ValueError(f"not a limit: {value!r}")
    return int(text)
