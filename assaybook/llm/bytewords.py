"""Vectorised cutting and hashing of whole texts, on the UTF-8 bytes that Arrow hands over.

A batch of texts is one byte array with document borders. Words are maximal runs of bytes of a class;
every word gets a 64-bit hash (a polynomial over random byte values, mixed), so later steps work on
integer arrays. UTF-8 bytes of non-ASCII characters are all 0x80 or above, so a class that holds all
of them or none cuts between characters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lowering: digits, a-z and all of non-ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def hash_runs(data: np.ndarray, first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each run of data; runs follow one another without gaps, none is empty."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(first, lens)
    terms = _BYTE[data]
    terms *= _powers(int(lens.max()))[place]
    return mix(np.add.reduceat(terms, first) + lens.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the n + 1 borders of its rows; null reads as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_[borders[0] : borders[-1]], borders - borders[0]


@dataclass
class Words:
    hashes: np.ndarray  # uint64 of every word
    starts: np.ndarray  # byte offset of every word in data
    lens: np.ndarray
    first: np.ndarray  # first word of each row, and the number of words: n + 1 entries
    data: np.ndarray  # lowered bytes
    quarters: np.ndarray  # what every word counts, in quarters of a word
    stops: np.ndarray  # byte offsets of non-ASCII sentence ends (with `apart` only)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: What a character of two or more bytes is: nothing special, punctuation, a sentence's end, or a word of its own
#: (of a script without spaces) that counts as a half or a quarter of a word.
_PLAIN, _MARK, _END, _HALF, _QUARTER = range(5)
_SIGNS = np.zeros(0x10000, dtype=np.uint8)
for _a, _z in ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1A20, 0x1AAF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)):
    _SIGNS[_a : _z + 1] = _QUARTER
for _a, _z in ((0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035), (0x3038, 0x303C), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA48F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F)):
    _SIGNS[_a : _z + 1] = _HALF
for _a, _z in ((0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x3037), (0x303D, 0x303F), (0x30FB, 0x30FB), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)):
    _SIGNS[_a : _z + 1] = _MARK
_SIGNS[[0x3002, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61, 0x061F, 0x06D4, 0x0964, 0x0965, 0x0E5A, 0x0E5B, 0x0F0D, 0x0F0E, 0x104A, 0x104B, 0x1362, 0x1367, 0x17D4, 0x17D5, 0x203C, 0x2047, 0x2048, 0x2049]] = _END


def _signs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, bytes and kind of the characters of two or more bytes that are something special."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at]
    size = 2 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
    code = lead.astype(np.int64) & (0xFF >> (size + 1))
    for j in (1, 2, 3):
        more = size > j
        code[more] = code[more] << 6 | (data[at[more] + j].astype(np.int64) & 63)
    kind = np.where(code < 0x10000, _SIGNS[np.minimum(code, 0xFFFF)], np.where((code >= 0x20000) & (code < 0x40000), _HALF, _PLAIN))
    some = kind > 0
    return at[some], size[some], kind[some]


def words(column: pa.Array, kind: np.ndarray, apart: bool = False) -> Words:
    """Words of every row: maximal runs of bytes of the class `kind`, A-Z lowered before.

    With `apart` (for ALNUM), characters of scripts without spaces are words of their own, and the punctuation of these scripts and
    non-ASCII sentence ends separate words.
    """
    raw, borders = text_bytes(column)
    data = LOWER[raw]
    inside = kind[data]
    at, size, sign = _signs(data) if apart else (np.zeros(0, dtype=np.int64),) * 3
    mark, lone = (sign == _MARK) | (sign == _END), sign >= _HALF
    for j in range(4):
        inside[at[mark & (size > j)] + j] = False
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[at[lone]] = True
    after = (at + size)[lone]
    after = after[after < len(data)]
    begins[after] = inside[after]
    rows = borders[:-1][np.diff(borders) > 0]
    begins[rows] = inside[rows]
    starts = np.flatnonzero(begins)
    kept = data[inside]
    before = np.cumsum(inside) - inside  # word bytes before a place
    first_byte = before[starts]
    lens = np.diff(np.append(first_byte, len(kept)))
    first = np.searchsorted(starts, borders)
    quarters = np.full(len(starts), 4, dtype=np.int64)
    quarters[np.searchsorted(starts, at[lone])] = np.where(sign[lone] == _HALF, 2, 1)
    return Words(hash_runs(kept, first_byte, lens), starts, lens, first, data, quarters, at[sign == _END])


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row, row after row, and n + 1 borders.

    A row of fewer words than `width`, but not none, has its whole sequence as its one shingle.
    """
    n = len(w.hashes)
    counts = np.diff(w.first)
    if n >= width:
        acc = w.hashes[: n - width + 1].copy()
        for j in range(1, width):
            acc = mix(acc) + w.hashes[j : n - width + 1 + j]
        acc = mix(acc)
    else:
        acc = np.zeros(0, dtype=np.uint64)
    out = []
    for a, c in zip(w.first[:-1].tolist(), counts.tolist(), strict=True):
        if c >= width:
            out.append(np.unique(acc[a : a + c - width + 1]))
        elif c:
            h = np.array([c], dtype=np.uint64)
            for j in range(a, a + c):
                h = mix(h) + w.hashes[j : j + 1]
            out.append(mix(h))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    sizes = np.array([len(x) for x in out], dtype=np.int64)
    flat = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
    return flat, np.concatenate([[0], np.cumsum(sizes)])


def prefix_hashes(w: Words, sizes: tuple[int, ...]):
    """(places of the words longer than size bytes, hash of their first size bytes), for each size in rising order."""
    acc = np.zeros(len(w.starts), dtype=np.uint64)
    alive = np.arange(len(w.starts))
    powers = _powers(max(sizes))
    for j in range(max(sizes)):
        alive = alive[w.lens[alive] > j + 1]
        acc[alive] += _BYTE[w.data[w.starts[alive] + j]] * powers[j]
        if j + 1 in sizes:
            yield alive, mix(acc[alive] + np.uint64(j + 1 << 32))
