"""Fill-in-the-middle: documents cut at two places and put together again with the middle last.

The places where a text may be cut are a set of byte offsets, held as in a Roaring bitmap: offsets fall into
containers of 2^16, and each container is an array of offsets, a bitmap, or a list of runs, whichever is smallest.
(Cuts between characters are one run as long as a text is ASCII, and a bitmap where it isn't; cuts between words or
lines are arrays.) Cumulative cardinalities over the containers lead a rank to its container by binary search, and a
select inside it gives the offset, so both cuts of a document come from one lookup of two ranks.

Every row is worked on where it is read: no shuffle. Ranks come from hashes of the id alone, so a repeated attempt
repeats its result, whatever the partitions.

Defined cases: a null text is empty; an empty text and one that holds a marker stay plain; a null id hashes as one
without digits; rows that share an id share their random numbers, each for its own text; other columns are ignored,
whatever their names; an empty table gives an empty result. A long text takes one byte a byte of text for the test of
its boundaries, and at most 8 KiB a 64 KiB after that. An output beyond Arrow's 2 GiB a value is Spark's error.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import text_bytes
from .shared import batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_CHUNK = 1 << 16
_ARRAY_MOST = 4096  # values up to which an array is no larger than a bitmap
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").sum(axis=1)


class ArrayContainer:
    """Few values: their low 16 bits, sorted."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    @property
    def nbytes(self) -> int:
        return self.low.nbytes

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Many values: a bit each, with the number of bits before every 512."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_CHUNK, dtype=bool)
        bits[low] = True
        self.bytes = np.packbits(bits, bitorder="little")
        per = _BITS[self.bytes].reshape(-1, 64).sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(per)[:-1]]).astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.bytes.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        block = int(np.searchsorted(self.before, k, side="right")) - 1
        part = self.bytes[64 * block : 64 * block + 64]
        return 512 * block + int(np.flatnonzero(np.unpackbits(part, bitorder="little"))[k - self.before[block]])


class RunContainer:
    """Values in a row: first value of every run, with the number of values before it."""

    def __init__(self, low: np.ndarray, starts: np.ndarray):
        self.first = low[starts].astype(np.uint16)
        self.before = starts.astype(np.int32)

    @property
    def nbytes(self) -> int:
        return self.first.nbytes + self.before.nbytes

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.first[run]) + k - int(self.before[run])


class BoundarySet:
    """A sorted set of offsets: containers by their high bits, with cumulative cardinalities."""

    def __init__(self):
        self.high: list[int] = []
        self.containers: list = []
        self.before = [0]  # cumulative cardinalities, one more than containers

    def add_chunk(self, high: int, low: np.ndarray) -> None:
        """The values of container `high` (sorted low bits, not empty); containers come in rising order."""
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        if 6 * len(starts) <= min(2 * len(low), _CHUNK // 8):
            made = RunContainer(low, starts)
        elif len(low) <= _ARRAY_MOST:
            made = ArrayContainer(low)
        else:
            made = BitmapContainer(low)
        self.high.append(high)
        self.containers.append(made)
        self.before.append(self.before[-1] + len(low))

    def __len__(self) -> int:
        return self.before[-1]

    def select(self, *ranks: int) -> list[int]:
        """The values of these ranks, from 0."""
        out = []
        for k in ranks:
            if not 0 <= k < len(self):
                raise IndexError(k)
            c = int(np.searchsorted(self.before, k, side="right")) - 1
            out.append(self.high[c] * _CHUNK + self.containers[c].select(k - self.before[c]))
        return out


def boundaries(data: np.ndarray, unit: str = "char") -> BoundarySet:
    """Byte offsets in a UTF-8 text where a unit begins, and its end: 'char' (code points), 'word' or 'line'.

    A word begins at the white space before it, a line after its newline; offset 0 is a boundary always.
    """
    out, n = BoundarySet(), len(data)
    for a in range(0, n + 1, _CHUNK):
        part = data[a : a + _CHUNK]
        if unit == "char":
            here = (part & 0xC0) != 0x80
        else:
            before = data[a - 1 : a + len(part) - 1] if a else np.append(np.uint8(10), part)[: len(part)]
            here = before == 10 if unit == "line" else _blank(part) & ~_blank(before)
        if a == 0 and len(part):
            here[0] = True
        low = np.flatnonzero(here)
        if a + len(part) == n and len(part) < _CHUNK:
            low = np.append(low, len(part))  # the end of the text
        if len(low):
            out.add_chunk(a >> 16, low)
    return out


def _blank(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def draws(doc_id, seed: int = 1) -> list[int]:
    """Four unsigned 32-bit numbers from an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(text: bytes, numbers: list[int], plain: int = 10, spm: int = 20, unit: str = "char") -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, units of the prefix, units of the middle, output) of one text.

    plain: per cent that stay as they are; spm: per cent of the others that lead with the suffix.
    """
    h1, h2, h3, h4 = numbers
    cuts = boundaries(np.frombuffer(text, dtype=np.uint8), unit)
    n = len(cuts) - 1
    if not text or h3 % 100 >= 100 - plain or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, z = cuts.select(first, second)
    if h4 % 100 < spm:
        return n, "spm", first, second - first, b"".join((SUFFIX, text[z:], PREFIX, text[:a], MIDDLE, text[a:z]))
    return n, "psm", first, second - first, b"".join((PREFIX, text[:a], SUFFIX, text[z:], MIDDLE, text[a:z]))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made of."""
    if form == "plain":
        return output
    front, mark = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output[len(front) :].partition(mark)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20, unit: str = "char",
) -> DataFrame:
    """One row per row of df: doc_id, n, form, prefix_units, middle_units, output (see transform)."""
    kind = df.select(id_col).dtypes[0][1]

    def work(batches_):
        for b in batches_:
            data, borders = text_bytes(b.column("text"))
            rows = [
                transform(data[a:z].tobytes(), draws(i, seed), plain, spm, unit)
                for i, a, z in zip(b.column("key").to_pylist(), borders[:-1].tolist(), borders[1:].tolist(), strict=True)
            ]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_units": pa.array(prefix, pa.int64()),
                "middle_units": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string()),
            })

    src = df.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return batches(src, work, f"doc_id {kind}, n long, form string, prefix_units long, middle_units long, output string")


def restore_texts(infilled: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from `output` and `form`, with DataFrame functions only."""
    output, form = F.col("output"), F.col("form")
    front, mark = (F.when(form == "psm", F.lit(x)).otherwise(F.lit(y)) for x, y in (("<P>", "<S>"), ("<S>", "<P>")))
    inner = F.substring(output, F.length(front) + 1, F.length(output))
    at = F.instr(inner, mark)
    one = F.substring(inner, F.lit(1), at - 1)
    rest = F.substring(inner, at + 3, F.length(inner))
    cut = F.instr(rest, F.lit("<M>"))
    two, middle = F.substring(rest, F.lit(1), cut - 1), F.substring(rest, cut + 3, F.length(rest))
    return infilled.withColumn("restored", F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one)))


def infill_digests(infilled: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return restore_texts(infilled).select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )
