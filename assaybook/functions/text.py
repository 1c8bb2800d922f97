"""Text rules: browser-style trimming, blank handling, keys, escaping, LIKE."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that browser trim() and \s count as white space.
SPACES = (
    "\t\n\x0b\f\r \u00a0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
SPACE_CLASS = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# Case-, accent- and trailing-space-blind comparison, as the source tables' collation does.
CODE_COLLATION = "UNICODE_CI_AI_RTRIM"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def or_null(c: Column) -> Column:
    """'' counts as missing."""
    return F.nullif(c, F.lit(""))


def first_text(*cols: Column, default: str | None = None) -> Column:
    """First column that is neither null nor ''."""
    found = [or_null(c) for c in cols]
    return F.coalesce(*found, F.lit(default)) if default is not None else F.coalesce(*found)


def digits_only(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def is_phone_query(c: Column) -> Column:
    return F.length(digits_only(c)) >= 7


def owner_key(phone: Column, name: Column) -> Column:
    return F.coalesce(
        or_null(digits_only(phone)),
        F.concat(F.lit("name:"), F.lower(F.coalesce(name, F.lit("")))),
    )


def pet_key(pet_name: Column, report_id: Column) -> Column:
    return F.coalesce(
        or_null(F.lower(trim(pet_name))), F.concat(F.lit("id-"), report_id.cast("string"))
    )


def clean_code(c: Column) -> Column:
    letters = F.regexp_replace(F.upper(trim(F.coalesce(c, F.lit("")))), "[^A-Z0-9_]", "_")
    return F.regexp_replace(F.regexp_replace(letters, "_+", "_"), "^_|_$", "")


def ci(c: Column) -> Column:
    """Comparison key for codes, report numbers and form codes."""
    return F.collate(c, CODE_COLLATION)


def like_pattern(q: str) -> str:
    """'%q%' where a backslash before %, _ or another backslash escapes it and any other
    backslash is dropped, as the source database reads patterns."""
    pattern, out, i = f"%{q.lower()}%", [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append("\\" + nxt if nxt in "%_\\" else nxt)
            i += 2
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def like_any(q: str, cols: Iterable[Column], accent_blind: bool = False) -> Column:
    """Case-blind substring match on any column; % and _ in q stay wildcards.
    accent_blind also ignores accents but takes % and _ literally."""
    if accent_blind:
        hits = [
            F.contains(F.collate(c, "UNICODE_CI_AI"), F.collate(F.lit(q), "UNICODE_CI_AI"))
            for c in cols
        ]
    else:
        hits = [F.lower(c).like(like_pattern(q)) for c in cols]
    return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])


def escape_html(c: Column) -> Column:
    # The five escapes, ampersand first.
    for raw, safe in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"),
    ):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.coalesce(c, F.lit(""))


def image_url(name: Column) -> Column:
    url = F.url_encode(name)
    # Where form encoding and URI-component encoding differ.
    for form, uri in (
        ("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"),
    ):
        url = F.replace(url, F.lit(form), F.lit(uri))
    return F.concat(F.lit("/api/uploads/file/"), url)


def safe_ext(name: Column) -> Column:
    """Lower-cased image extension of the base name, '.jpg' for anything else."""
    ext = F.regexp_extract(
        F.lower(F.coalesce(name, F.lit(""))), r"[^/](\.(?:jpg|jpeg|png|gif|webp))/*\z", 1
    )
    return first_text(ext, default=".jpg")


def pet_label(name: Column, species: Column, breed: Column) -> Column:
    return F.concat(
        first_text(name, default="Unnamed"),
        F.lit(" ("),
        first_text(species, default="N/A"),
        F.lit(")"),
        F.coalesce(F.concat(F.lit("  -  "), or_null(breed)), F.lit("")),
    )


def fill_text(c: Column) -> Column:
    """Trimmed text; null stands for a blank line to fill in by hand."""
    return or_null(trim(c))


def rebook_key(phone: Column, pet: Column, owner: Column) -> Column:
    return first_text(phone, pet, owner, default="")
