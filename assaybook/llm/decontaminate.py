"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton takes every item's words in turn. A document's words are streamed through it: after each word
the state tells the longest match that ends there. Where that length reaches a window (10 words), the
window is a match, the words it covers are hit, and the items that hold it are read off its state. An item of
fewer words than a window, but not none, is a window of its own. Spans of hit words are removed; a
document whose hit words exceed a share of all its words (max_coverage) goes as a whole.

Before the automaton walks a document, a vectorised test finds the stretches whose neighbouring word pairs
all occur in some item and that are long enough for a window; no match can lie outside of them, and
all else is passed over.

The items are hashed where they are read and dealt into shards of about SHARD_WORDS words, each with an automaton of its
own, which lie as files in the shared folder; the driver sees their number only. A task reads a shard when it comes to it and
keeps HELD shards at most. With more shards than that it takes HOLD_BYTES of documents through them, one shard after
the other, so an automaton is built once for so many bytes, and only where a document has a stretch for it; hits of all shards are merged.

Defined cases: null texts have no words and are never contaminated; items without words match nothing; items
with equal texts are all reported; a null item_id counts for hits and not for the lists of items. An empty
benchmark leaves all documents as they are, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .bytewords import ALNUM, Words, mix, words
from .shared import batches, fresh, new_folder, stored, wider

WINDOW = 10
#: Words of the items that one automaton holds: about 1 kB each while it is built, and 100 MB at most.
SHARD_WORDS = 100_000
HELD, HOLD_BYTES = 4, 32 << 20


class Automaton:
    """Generalised suffix automaton; state 0 is the root. Items are told apart at the states of windows."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        for _, item in items:
            last = 0
            for c in item:
                last = self._extend(last, c)
        # the windows: the state that holds the last `window` words at each place of each item
        self.owners: dict[tuple[int, int], set[str]] = defaultdict(set)
        self.short: set[int] = set()  # lengths of items below a window
        for name, item in items:
            n = min(window, len(item))
            if 0 < n < window:
                self.short.add(n)
            for state, length in self.walk(item, window):
                if length >= n > 0:
                    owner = self.owners[self.shrink(state, n), n]
                    if name is not None:
                        owner.add(name)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.len.append(length)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state reached from p by c, of length len(p) + 1 exactly; q is cloned where it holds longer strings."""
        if self.len[q] == self.len[p] + 1:
            return q
        clone = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # this prefix occurs in an earlier item
            return self._split(last, c, self.next[last][c])
        new, p = self._new(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def shrink(self, state: int, n: int) -> int:
        """The state of the last n words of a match that ends in `state`."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def walk(self, tokens, most: int | None = None):
        """(state, length of the longest match that ends here) after each word.

        With `most`, lengths beyond it count as it and the state is that of the last `most` words. A step makes
        the chain of links longer by one at most, so cutting back takes no more steps in all than there are words.
        """
        state, length = 0, 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
                if most is not None and length >= most:
                    state, length = self.shrink(state, most), most
            yield state, length

    def matches(self, tokens):
        """(first word, word after the last, items) of every window that occurs in tokens."""
        sizes = sorted({self.window, *self.short})
        for i, (state, length) in enumerate(self.walk(tokens, self.window)):
            for n in sizes:
                if n > length:
                    break
                owners = self.owners.get((self.shrink(state, n), n))
                if owners is not None:
                    yield i + 1 - n, i + 1, owners


class _Shard:
    """An automaton, its word ids, and the pairs of neighbouring words that its items hold."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int):
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, dtype=np.uint64)
        pairs = [mix(h[:-1]) + h[1:] for _, h in items if len(h) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.uint64)
        self.least = min([min(window, len(h)) for _, h in items if len(h)], default=0)
        self.items, self.window = items, window

    @functools.cached_property
    def automaton(self) -> Automaton:
        return Automaton([(name, np.searchsorted(self.vocabulary, h).tolist()) for name, h in self.items], self.window)

    def stretches(self, w: Words) -> list[tuple[int, int]]:
        """Runs of words, each within a row, that are long enough and made of known pairs (known words, if one is enough)."""
        if not self.least or not len(w.hashes):
            return []
        if self.least == 1:
            good = _member(self.vocabulary, w.hashes)
            joined = good[:-1] & good[1:]
        else:
            joined = _member(self.pairs, mix(w.hashes[:-1]) + w.hashes[1:])
        row = w.row_of()
        joined = joined & (row[:-1] == row[1:])
        edge = np.diff(np.concatenate([[0], joined.view(np.int8), [0]]))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.least == 1:
            lone = good.copy()
            lone[1:] &= ~joined
            lone[:-1] &= ~joined
            at = np.flatnonzero(lone)
            a, z = np.concatenate([a, at]), np.concatenate([z, at + 1])
        keep = z - a >= self.least
        return list(zip(a[keep].tolist(), z[keep].tolist(), strict=True))

    def hits(self, w: Words, hit: np.ndarray, found: dict[int, set[str]]) -> None:
        """Marks hit words and notes the items of each row."""
        for a, z in self.stretches(w):
            part = w.hashes[a:z]
            ids = np.searchsorted(self.vocabulary, part)
            ids = np.where(self.vocabulary[np.minimum(ids, len(self.vocabulary) - 1)] == part, ids, -1).tolist()
            row = int(np.searchsorted(w.first, a, side="right")) - 1
            for x, y, owners in self.automaton.matches(ids):
                hit[a + x : a + y] = True
                found[row] |= owners


def _member(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(table, x)
    return table[np.minimum(at, len(table) - 1)] == x


def _shards(benchmark: DataFrame, id_col: str, text_col: str, window: int, shard_words: int) -> list[str]:
    """Places of the item shards, each of about shard_words words (more only where one item has more)."""
    def hashed(batches_):
        for b in batches_:
            w = words(b.column("text"), ALNUM)
            parts = [w.hashes[x:y].tobytes() for x, y in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.record_batch({"id": b.column("id"), "n": pa.array(np.diff(w.first), pa.int64()), "hashes": pa.array(parts, pa.binary())})

    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    items = stored(batches(rows, hashed, "id string, n long, hashes binary").withColumn("row", F.monotonically_increasing_id()), "items").filter("n > 0")
    total = items.agg(F.sum("n").alias("n")).first()["n"] or 0
    count = -(-total // shard_words)
    if not count:
        return []
    folder = new_folder(benchmark.sparkSession, "item-shards")
    dealt = items.select("id", "hashes", F.pmod("row", F.lit(count)).alias("shard"))
    dealt.repartition(count, "shard").write.partitionBy("shard").parquet(folder)
    return [f"{folder}/shard={k}" for k in range(count)]


@functools.lru_cache(maxsize=HELD)
def _load(place: str, window: int) -> _Shard:
    fs, base = FileSystem.from_uri(place)
    if fs.get_file_info(base).type == FileType.NotFound:
        return _Shard([], window)
    table = pq.read_table(base, columns=["id", "hashes"], filesystem=fs, partitioning=None)
    return _Shard([(i, np.frombuffer(h, dtype=np.uint64)) for i, h in zip(table.column("id").to_pylist(), table.column("hashes").to_pylist(), strict=True)], window)


def _scanned(batches_, column: str, shards: list[str], window: int):
    """(batch, words, hit flags, items by row) of every batch, after all shards."""
    held, size = [], 0

    def met():
        for place in shards:
            shard = _load(place, window)
            for _, w, hit, found in held:
                shard.hits(w, hit, found)
        return held

    for b in batches_:
        w = words(b.column(column), ALNUM)
        held.append((b, w, np.zeros(len(w.hashes), dtype=bool), defaultdict(set)))
        size += b.nbytes
        if len(shards) <= HELD or size >= HOLD_BYTES:
            yield from met()
            held, size = [], 0
    yield from met()


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, joined ids), contaminated."""
    shards = _shards(benchmark, "item_id", "text", window, shard_words)

    def work(batches_):
        for b, w, hit, found in _scanned(batches_, "text", shards, window):
            n_hit = _sums(hit, w.first)
            items = [sorted(found[i]) if i in found else [] for i in range(b.num_rows)]
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "n_words": pa.array(np.diff(w.first), pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), "contaminated": pa.array(n_hit > 0),
            })

    kind = docs.select(id_col).dtypes[0][1]
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with hit spans cut out of their texts and without documents hit in more than max_coverage of their words.

    Untouched texts stay byte for byte, null included. A removed span is replaced by one space.
    """
    shards = _shards(benchmark, "item_id", "text", window, shard_words)
    cleaned, coverage = fresh(docs.columns, "cleaned", "coverage")

    def work(batches_):
        for b, w, hit, _ in _scanned(batches_, text_col, shards, window):
            column = b.column(text_col)
            n_hit, n = _sums(hit, w.first), np.diff(w.first)
            texts = [None] * b.num_rows
            for i in np.flatnonzero(n_hit).tolist():
                a, z = int(w.first[i]), int(w.first[i + 1])
                raw = column[i].as_py().encode()
                base = int(w.starts[a]) - _first_word(raw)  # where the text begins in the batch
                edge = np.diff(np.concatenate([[0], hit[a:z].view(np.int8), [0]]))
                out, at = [], 0
                for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    out.append(raw[at : int(w.starts[a + x]) - base])
                    at = int(w.starts[a + y - 1] + w.lens[a + y - 1]) - base
                texts[i] = b" ".join([*out, raw[at:]]).decode()
            share = n_hit / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string()), pa.array(share)], names=[*b.schema.names, cleaned, coverage])

    schema = wider(docs, **{cleaned: StringType(), coverage: DoubleType()})
    told = batches(docs, work, schema)
    kept = told.filter(F.col(coverage) <= max_coverage)
    return kept.withColumn(text_col, F.coalesce(cleaned, text_col)).select(*docs.columns)


def _first_word(raw: bytes) -> int:
    return int(np.flatnonzero(ALNUM[np.frombuffer(raw.lower(), dtype=np.uint8)])[0])
