"""Secret scan: known shapes, and the entropy of sliding windows over random-looking strings.

Known shapes (kinds assign, access, hex; leftmost and non-overlapping within a kind):
a value assigned to a telling name, an access key id, a long run of hex digits.

Entropy: a candidate is a run of at least WINDOW characters A-Z a-z 0-9 + / _ = - that mixes character
classes. A window slides over it; counts of its characters and the entropy sum are updated by the one that
enters and the one that leaves. Each window is judged by its own class (all hex digits, or mixed letters and
digits) against that class's threshold; windows above it make up the span. Windows of digits alone, of
letters of one case, and candidates on the allow-list (UUIDs, dates, paths and links, words joined by
hyphens and the like) are never secrets. Spans that lie inside a known shape add nothing.

Offsets are code points, ends exclusive. Defined cases: a null text is empty; ties at a start are ordered
assign, access, hex, entropy; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import text_bytes
from .shared import batches

KINDS = ("assign", "access", "hex", "entropy")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
WINDOW = 20
#: Bits a character; at most log2(20) = 4.32 for a window
THRESHOLDS = {"hex": 3.0, "mixed": 3.7}
ALLOWED = (
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"\d{4}-\d\d-\d\d.*",
    r"[A-Za-z]*(?:[-_/=+][A-Za-z]*)+\d{0,4}",
    r".*(?:EXAMPLE|example|xxxx|XXXX|1234567890|abcdefghij).*",
)

_NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_DIGIT, _LOWER, _UPPER = _table(b"0123456789"), _table(bytes(range(97, 123))), _table(bytes(range(65, 91)))
_HEX, _KEY = _table(b"0123456789abcdef"), _DIGIT | _UPPER
_CANDIDATE = _DIGIT | _LOWER | _UPPER | _table(b"+/_=-")
_DELIMITER, _BEFORE = _table(b":="), _table(b" \"'dDtTnNyY")


def _runs(data: np.ndarray, borders: np.ndarray, kind: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a class within a row, of at least that many bytes."""
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = borders[:-1][np.diff(borders) > 0]
    begins[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = borders[1:][np.diff(borders) > 0] - 1
    ends[last] = inside[last]
    a, z = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = z - a >= least
    return a[keep], z[keep]


def _assigned(data: np.ndarray, borders: np.ndarray):
    """Spans of assignments: each begins at a telling name just before a delimiter."""
    at = np.flatnonzero(_DELIMITER[data])
    at = at[at > 0]
    at = at[_BEFORE[data[at - 1]]]
    rows = np.searchsorted(borders, at, side="right") - 1
    row, text, done = -1, b"", 0
    for p, r in zip(at.tolist(), rows.tolist(), strict=True):
        if r != row:
            row, done = r, 0
            base = int(borders[r])
            text = data[base : borders[r + 1]].tobytes()
        e = p - base
        while e and text[e - 1] == 32:
            e -= 1
        if text[e - 1 : e] in (b'"', b"'"):
            e -= 1
        tail = text[max(0, e - 8) : e].lower()
        for name in _NAMES:
            if tail.endswith(name):
                a = e - len(name)
                if a >= done and (m := _ASSIGN.match(text, a)):
                    done = m.end()
                    if len(m[2]) >= MIN_VALUE:
                        yield r, base + a, base + done
                break


def _access(data: np.ndarray, borders: np.ndarray):
    at = np.flatnonzero(data[: max(0, len(data) - 3)] == 65)
    for j, c in enumerate(b"KIA", 1):
        at = at[data[at + j] == c]
    done = 0
    for a in at.tolist():
        r = int(np.searchsorted(borders, a, side="right")) - 1
        end = int(borders[r + 1])
        if a < done or a + 4 > end:
            continue
        z = a + 4
        while z < end and _KEY[data[z]]:
            z += 1
        if z > a + 4:
            done = z
            if z - a >= MIN_ACCESS:
                yield r, a, z


def window_entropies(text: bytes, size: int = WINDOW):
    """(start, entropy in bits, digits, lower, upper, hex digits) of every window; one character in, one out."""
    counts = [0] * 256
    total = 0.0  # sum of c * log2(c)
    kinds = [0, 0, 0, 0]
    log = [0.0] + [c * math.log2(c) for c in range(1, size + 1)]
    member = _KINDS_OF
    for i, c in enumerate(text):
        n = counts[c]
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        for k in member[c]:
            kinds[k] += 1
        if i >= size:
            c = text[i - size]
            n = counts[c]
            total += log[n - 1] - log[n]
            counts[c] = n - 1
            for k in member[c]:
                kinds[k] -= 1
        if i >= size - 1:
            yield i - size + 1, math.log2(size) - total / size, *kinds


_KINDS_OF = [[k for k, t in enumerate((_DIGIT, _LOWER, _UPPER, _HEX | _table(b"ABCDEF"))) if t[c]] for c in range(256)]


def _random(text: bytes, thresholds: dict[str, float], size: int):
    """Spans of windows above the threshold of their class."""
    a = z = -1
    for i, bits, digits, lower, upper, hexes in window_entropies(text, size):
        if hexes == size:
            high = 0 < digits < size and bits >= thresholds["hex"]
        else:
            high = digits > 1 and lower + upper > 1 and bits >= thresholds["mixed"]
        if high:
            if i > z:
                if a >= 0:
                    yield a, z
                a = i
            z = i + size
    if a >= 0:
        yield a, z


def _entropic(data: np.ndarray, borders: np.ndarray, thresholds, allowed: re.Pattern, size: int):
    a, z = _runs(data, borders, _CANDIDATE, size)
    if not len(a):
        return
    edges = np.stack([a, z], axis=1).ravel()
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])[edges]
    mixed = np.flatnonzero((digits[1::2] - digits[::2] > 1) & (digits[1::2] - digits[::2] < z - a))
    rows = np.searchsorted(borders, a, side="right") - 1
    for i in mixed.tolist():
        r, s = int(rows[i]), int(a[i])
        text = data[s : z[i]].tobytes()
        before = data[max(int(borders[r]), s - 3) : s].tobytes()
        if before.endswith((b"://", b":/", b"@")) or allowed.fullmatch(text.decode()):
            continue
        for x, y in _random(text, thresholds, size):
            yield r, s + x, s + y


def _reach(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts of spans in order, and the farthest end of all spans up to each."""
    ordered = sorted((a, z) for a, _, z in spans)
    return [a for a, _ in ordered], list(itertools.accumulate((z for _, z in ordered), max))


def _covered(starts: list[int], ends: list[int], a: int, z: int) -> bool:
    """Does one of the spans hold all of a to z?"""
    i = bisect.bisect_right(starts, a)
    return i > 0 and ends[i - 1] >= z


def find_spans(column: pa.Array, thresholds=THRESHOLDS, allowed=ALLOWED, size: int = WINDOW) -> list[list[tuple[int, str, int]]]:
    """Per row (start, kind, end) in code points, sorted by start, then kind."""
    data, borders = text_bytes(column)
    found = defaultdict(list)
    if len(data):
        hexes = _runs(data, borders, _HEX, MIN_HEX)
        hex_rows = np.searchsorted(borders, hexes[0], side="right") - 1
        for kind, spans in ((0, _assigned(data, borders)), (1, _access(data, borders)), (2, zip(hex_rows.tolist(), hexes[0].tolist(), hexes[1].tolist(), strict=True))):
            for r, a, z in spans:
                found[r].append((a, kind, z))
        pattern = re.compile("|".join(allowed) or r"(?!)")
        known = {r: _reach(spans) for r, spans in found.items()}
        for r, a, z in _entropic(data, borders, thresholds, pattern, size):
            if r not in known or not _covered(*known[r], a, z):
                found[r].append((a, 3, z))
    out: list[list[tuple[int, str, int]]] = [[] for _ in range(len(borders) - 1)]
    for r, spans in found.items():
        if spans:
            text = data[borders[r] : borders[r + 1]]
            points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
            base = int(borders[r])
            out[r] = [(int(points[a - base]), KINDS[k], int(points[z - base])) for a, k, z in sorted(spans)]
    return out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS, allowed=ALLOWED, size: int = WINDOW) -> DataFrame:
    """One row per row of df: doc_id and its spans, an array of (start, kind, end)."""

    def work(batches_):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for b in batches_:
            spans = find_spans(b.column("text"), thresholds, allowed, size)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "spans": pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in spans], kind)})

    id_type = df.select(id_col).dtypes[0][1]
    return batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, f"doc_id {id_type}, spans array<struct<start: long, kind: string, end: long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the known kinds and the spans as text: kind:start:end, comma-joined."""
    told = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))
    base = F.filter("spans", lambda s: s.kind != "entropy")
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
