"""Packing into training sequences: vector bin packing by the dot-product heuristic.

Every piece asks for tokens, one segment and loss-bearing tokens, and a sequence has a limit on each. A
sequence is filled by taking, of the waiting pieces that still fit, the one whose demand has the largest
dot product with what the sequence has left (both as shares of the limits): pieces that ask for what is
plentiful go first. Where cutting is allowed, the gap that no piece fits is filled with the head of the
largest one, and the tail of a task is cut into sequences of powers of two, which need no padding.

Every task packs its own rows as they stream by, holding at most WAITING pieces, so no row is shuffled and
memory is bounded; sequence ids are unique over all tasks. A repeated attempt at a task repeats its result.

Defined cases: a null text is an empty document, of its end token alone; repeated rows and null ids are packed
like any others; a document longer than a sequence is cut; an example that exceeds a limit and may not be
cut gets a sequence of its own and is marked; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import batches
from .tokens import process_tokens

WAITING = 2048


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Packer:
    """Places pieces (key, start, tokens, loss) and yields (key, start, tokens, sequence, offset).

    With cut, every token of a piece bears loss or none does, so that any head of it can be taken.
    """

    def __init__(self, limits: Limits, cut: bool, first: int = 0):
        self.limits, self.cut, self.sequence = limits, cut, first
        self.cap = np.array([limits.tokens, limits.segments, limits.loss], dtype=np.float64)
        self.demand = np.zeros((WAITING + 1, 3))
        self.keys: list[tuple] = [()] * (WAITING + 1)
        self.n = 0

    def _remove(self, i: int) -> None:
        self.n -= 1
        self.demand[i], self.keys[i] = self.demand[self.n], self.keys[self.n]

    def add(self, key, tokens: int, loss: int):
        """Takes one more piece; yields what becomes final."""
        start = 0
        size = min(self.limits.tokens, self.limits.loss if loss else self.limits.tokens)
        while self.cut and tokens - start >= size:
            yield key, start, size, self.sequence, 0
            self.sequence += 1
            start += size
        if not self.cut and (tokens > self.limits.tokens or loss > self.limits.loss):
            yield key, 0, tokens, self.sequence, 0
            self.sequence += 1
        elif tokens > start or not self.cut:
            self.demand[self.n] = tokens - start, 1, (tokens - start if loss else 0) if self.cut else loss
            self.keys[self.n] = (key, start)
            self.n += 1
        while self.n >= WAITING:
            yield from self._fill(self.limits.tokens)

    def finish(self):
        while self.n:
            left = int(self.demand[: self.n, 0].sum())
            size = self.limits.tokens
            while self.cut and size > left:
                size = 1 << (left.bit_length() - 1)
            yield from self._fill(size)

    def _fill(self, size: int):
        """One sequence of at most `size` tokens."""
        left, offset = np.array([size, self.limits.segments, min(self.limits.loss, size) if self.cut else self.limits.loss], dtype=np.float64), 0
        while self.n and left[1] > 0 and (left[0] > 0 or not self.cut):
            d = self.demand[: self.n]
            fits = (d <= left).all(axis=1)
            if fits.any():
                i = int(np.argmax(np.where(fits, d @ (left / self.cap**2), -1)))
            elif self.cut and left[2] > 0:
                i = int(np.argmax(d[:, 0]))
            else:
                break
            key, start = self.keys[i]
            take = d[i].copy()
            if not fits[i]:
                take[0] = min(left[0], left[2]) if d[i, 2] else left[0]
                take[2] = take[0] if d[i, 2] else 0
            n = int(take[0])
            yield key, start, n, self.sequence, offset
            offset += n
            left -= take
            if fits[i]:
                self._remove(i)
            else:
                self.demand[i, 0] -= take[0]
                self.demand[i, 2] -= take[2]
                self.keys[i] = (key, start + n)
        self.sequence += 1


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 33


def pack_documents(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(segments=2048), end_id: int = 1, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    The limit on segments is by default that on tokens, so that it never leaves a gap behind short documents. A document is its text's ids and end_id; all of them bear loss. tokenizer: path of the vocabulary file.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = df.select(id_col).dtypes[0][1]

    def rows(pieces, id_type):
        out: dict[str, list] = {n: [] for n in names}
        ids_out = []
        for (doc, ids), start, length, sequence, offset in pieces:
            part = ids[start : start + length]
            for n, v in zip(names, (doc, start, length, zlib.crc32(part), len(ids), sequence, offset), strict=True):
                out[n].append(v)
            if keep_ids:
                ids_out.append(part)
            if len(out["doc_id"]) >= 1024:
                yield batch(out, ids_out, id_type)
                out, ids_out = {n: [] for n in names}, []
        if out["doc_id"]:
            yield batch(out, ids_out, id_type)

    def batch(out, ids_out, id_type):
        columns = {n: pa.array(v, id_type if n == "doc_id" else pa.int64()) for n, v in out.items()}
        if keep_ids:
            borders = np.concatenate([[0], np.cumsum([len(x) for x in ids_out])])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(np.concatenate(ids_out).astype(np.int32)))
        return pa.record_batch(columns)

    def work(batches_):
        coder, packer, id_type = process_tokens(tokenizer), Packer(limits, cut=True, first=_first_sequence()), None
        for b in batches_:
            id_type = b.column("doc_id").type
            ids, borders = coder.encode(b.column("text"))

            def placed(b=b, ids=ids, borders=borders):
                for i, doc in enumerate(b.column("doc_id").to_pylist()):
                    own = np.append(ids[borders[i] : borders[i + 1]], np.uint32(end_id)).astype("<u4")
                    yield from packer.add((doc, own), len(own), len(own))

            yield from rows(placed(), id_type)
        if id_type is not None:
            yield from rows(packer.finish(), id_type)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, schema)


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """Whole examples, as instruction data needs them: id, tokens, loss, sequence_id, offset, fits.

    A null or negative count reads as 0; an example without tokens takes a segment of no length.
    """
    kind = df.select(id_col).dtypes[0][1]

    def work(batches_):
        packer, id_type = Packer(limits, cut=False, first=_first_sequence()), None

        def out(placed):
            got = list(placed)
            if got:
                ids, tokens, loss = zip(*[key for key, *_ in got], strict=True)
                yield pa.record_batch({
                    "id": pa.array(ids, id_type), "tokens": pa.array(tokens, pa.int64()), "loss": pa.array(loss, pa.int64()),
                    "sequence_id": pa.array([x[3] for x in got], pa.int64()), "offset": pa.array([x[4] for x in got], pa.int64()),
                    "fits": pa.array([t <= limits.tokens and l <= limits.loss for t, l in zip(tokens, loss, strict=True)]),
                })

        for b in batches_:
            id_type = b.column("id").type
            rows = zip(b.column("id").to_pylist(), b.column("tokens").to_pylist(), b.column("loss").to_pylist(), strict=True)
            yield from out(x for i, t, l in rows for x in packer.add((i, t, l), t, l))
        if id_type is not None:
            yield from out(packer.finish())

    count = lambda c: F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0))
    src = df.select(F.col(id_col).alias("id"), count(tokens_col).alias("tokens"), count(loss_col).alias("loss"))
    return batches(src, work, f"id {kind}, tokens long, loss long, sequence_id long, offset long, fits boolean")
