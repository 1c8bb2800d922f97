"""Bloom bitmaps of a fixed most size: which hashes may occur twice, which may occur in another frame.

A bitmap has 16 bits a row, to a fixed most of MAX_BITS (32 MiB, the proven bound of what is broadcast).
Each hash sets two bits. Tasks send only bit positions (a few bytes a row), merged per block of the bitmap.
Beyond the bound the bitmap fills up and answers "possibly" more often; callers decide exactly afterwards,
so that costs traffic and never changes a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BITS = 1 << 28
_BLOCK = 1 << 16  # bits of a block, so that a place in it takes two bytes


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash: its low and its high half."""
    h = h.view(np.uint64)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _split(places: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Sorted bit positions as one row for each block that has any."""
    block = places // _BLOCK
    at = np.flatnonzero(np.diff(block, prepend=-1))
    low = (places % _BLOCK).astype("<u2")
    return block[at].tolist(), [x.tobytes() for x in np.split(low, at[1:])] if len(at) else []


def _bitmap(hashes: DataFrame, bits: int, repeated: bool) -> np.ndarray:
    """Packed bits that rows set, or that more than one row sets; hashes has one long column."""

    def local(batches_):
        got = [c for b in batches_ if b.num_rows for c in _places(b.column(0).to_numpy(zero_copy_only=False), bits)]
        if not got:
            return
        place, count = np.unique(np.concatenate(got), return_counts=True)
        for again, x in ((False, place), (True, place[count > 1])):
            blocks, data = _split(x)
            if blocks:
                yield pa.record_batch({"block": pa.array(blocks, pa.int32()), "again": pa.array([again] * len(blocks)), "data": pa.array(data, pa.binary())})

    def merge(key, parts):
        seen, twice = np.zeros(_BLOCK, dtype=bool), np.zeros(_BLOCK, dtype=bool)
        for again, data in zip(parts.column("again").to_pylist(), parts.column("data").to_pylist(), strict=True):
            x = np.frombuffer(data, dtype="<u2")
            if again:
                twice[x] = True
            else:
                twice[x[seen[x]]] = True
                seen[x] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([np.packbits(twice if repeated else seen, bitorder="little").tobytes()], pa.binary())})

    # at most MAX_BITS / _BLOCK = 4,096 rows of 8 KiB, whatever the input
    merged = hashes.mapInArrow(local, "block int, again boolean, data binary").groupBy("block").applyInArrow(merge, "block int, data binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.toLocalIterator():
        x = np.frombuffer(row.data, dtype=np.uint8)[: len(out)]
        out[row.block * _BLOCK // 8 : row.block * _BLOCK // 8 + len(x)] = x
    return out


def bits_for(rows: int) -> int:
    return min(MAX_BITS, max(1 << 10, 1 << int(max(1, rows) * 16 - 1).bit_length()))


def _tester(spark, bitmap: np.ndarray, bits: int):
    shared = spark.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(h):
        import pandas as pd

        low, high = _places(h.to_numpy(dtype=np.int64, na_value=0), bits)
        b = shared.value
        return pd.Series(((b[low >> 3] >> (low & 7)) & (b[high >> 3] >> (high & 7)) & 1).astype(bool))

    return hit


def possibly_repeated(df: DataFrame, hash_col: str) -> Column:
    """A column for frames that hold the hashes of df: could another row have the same hash?"""
    bits = bits_for(df.count())
    return _tester(df.sparkSession, _bitmap(df.select(hash_col), bits, True), bits)(F.col(hash_col))


def possibly_in(keys: DataFrame, hash_col: str):
    """A function of a long column: could its value be among the hashes of keys? No false negatives."""
    bits = bits_for(keys.count())
    return _tester(keys.sparkSession, _bitmap(keys.select(hash_col), bits, False), bits)
