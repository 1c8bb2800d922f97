"""Token ids in flat binary files: one row of unsigned integers, 64-bit document offsets, memory-mapped reading.

Writing: rows are range-partitioned and sorted by id, so that partition p holds the p-th stretch of the whole order.
Every task encodes its texts as they stream by and appends to three files of its own in the shared folder:

    <name>.bin   ids as little-endian unsigned integers, of 2 bytes if the vocabulary allows, else 4
    <name>.off   documents + 1 little-endian unsigned 64-bit offsets into .bin, counted in ids, from 0
    <name>.ids   the documents' own ids, an Arrow file

and reports (shard, name, documents, ids). Only reported files count, so what a lost or repeated attempt leaves is
never read. The place of a shard in the whole is the prefix sum of the shards before it: as many rows as there are
partitions, whatever the number of documents. `base + offset` is a document's place in the whole row of ids.

Reading: a task maps the files of its shards and slices them; `TokenFiles` gives single documents, or any stretch of
the whole row of ids, by binary search over bases and offsets.

Order: ascending id, null ids first; rows that share an id are ordered by a hash of their text. (Rows equal in both
give the same ids, so it doesn't matter which comes first; a running row number lets one id's rows fall into several
partitions.) A null text is empty: its end id alone. Other columns are ignored, whatever their names. An empty table
gives no files, and no rows when read. A long text is encoded in parts, cut at white space. A document of more than
2^29 ids can't be one row when read (its bytes exceed Arrow's limit) and raises an error there.
"""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import LOWER, hash_runs, text_bytes
from .shared import batches, new_folder, partitions, stored

MANIFEST = "shard int, path string, width int, docs long, tokens long"
PART_BYTES = 1 << 20  # of text that is cut into pieces at a time
READ_TOKENS = 1 << 20  # ids of a batch when reading, unless one document has more

_SPACE, _LETTER, _DIGIT, _SIGN, _WIDE, _APOSTROPHE = range(6)
_KIND = np.full(256, _SIGN, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _WIDE
_KIND[39] = _APOSTROPHE
#: [kind before, kind here]: may a piece begin here? White space and the next kind of ASCII character always end one,
#: as does every digit; an apostrophe belongs to what follows, and nothing is cut beside characters beyond ASCII.
_CUTS = np.zeros((6, 6), dtype=bool)
_CUTS[_SPACE, 1:] = True
for _a, _z in ((_LETTER, _DIGIT), (_LETTER, _SIGN), (_LETTER, _APOSTROPHE), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _SIGN), (_DIGIT, _APOSTROPHE), (_SIGN, _LETTER), (_SIGN, _DIGIT)):
    _CUTS[_a, _z] = True


class WordCoder:
    """Ids of texts from a vocabulary that lowers case, drops white space and merges within words only.

    Texts are cut where the vocabulary's own rule always cuts; each distinct piece is encoded once by the tokenizer.
    Known pieces are found by their hash in a table of two places a hash; a piece that loses its place is encoded
    again when met again, so memory is bounded: 2^slots entries of 12 bytes, and the ids of max_pieces pieces.
    """

    def __init__(self, path: str, slots: int = 22, max_pieces: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.slots, self.max_pieces = slots, max_pieces
        self._clear()

    def _clear(self) -> None:
        self.keys, self.held = np.zeros(1 << self.slots, dtype=np.uint64), np.full(1 << self.slots, -1, dtype=np.int32)
        self.start, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int64)
        self.flat, self.count, self.used = np.zeros(1 << 14, dtype=np.uint32), 0, 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.slots) - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(64 - self.slots)) & mask).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of these hashes, -1 for unknown ones."""
        one, two = self._places(hashes)
        first = np.where(self.keys[one] == hashes, self.held[one], -1)
        return np.where(first >= 0, first, np.where(self.keys[two] == hashes, self.held[two], -1))

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        """Runs of a-z go straight to the merges: normalising and splitting leave them as they are."""
        merge = self.model.model.tokenize
        ids = [[t.id for t in merge(p)] if p.isascii() and p.isalpha() else None for p in pieces]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, got in zip(rest, self.model.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            ids[i] = got.ids
        return ids

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        ids = self._encode(pieces)
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        n, total = self.count, int(sizes.sum())
        while n + len(ids) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.start[n : n + len(ids)], self.size[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes, sizes
        self.flat[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), dtype=np.uint32, count=total)
        self.used, self.count = self.used + total, n + len(ids)
        numbers = np.arange(n, n + len(ids), dtype=np.int32)
        one, two = self._places(hashes)
        place = np.where(self.held[one] < 0, one, two)
        self.keys[place], self.held[place] = hashes, numbers
        return numbers

    def _part(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of data, and the number of ids before each of `rows` (places where no piece may go across)."""
        kind = _KIND[data]
        begins = np.empty(len(data), dtype=bool)
        begins[0] = kind[0] != _SPACE
        begins[1:] = _CUTS[kind[:-1], kind[1:]]
        inner = rows[rows < len(data)]
        begins[inner] = kind[inner] != _SPACE
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(rows), dtype=np.int64)
        inside = kind != _SPACE
        first = (np.cumsum(inside) - inside)[starts]
        kept, wide = data[inside], (kind == _WIDE)[inside]
        lens = np.diff(first, append=len(kept))
        # A-Z are lowered here, but not beside other characters: composition may come before lowering
        as_is = np.repeat(np.logical_or.reduceat(wide, first), lens)
        kept = np.where(as_is, kept, LOWER[kept])
        hashes = hash_runs(kept, first, lens)
        piece = self._find(hashes)
        miss = np.flatnonzero(piece < 0)
        if len(miss):
            new, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            if self.count + len(new) > self.max_pieces:
                self._clear()
                return self._part(data, rows)
            at = miss[at]
            piece[miss] = self._learn(new, [kept[a : a + n].tobytes().decode() for a, n in zip(first[at].tolist(), lens[at].tolist(), strict=True)])[back]
        sizes = self.size[piece]
        after = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[piece] - (after - sizes), sizes) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, rows)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a string column, and n + 1 borders; null reads as empty."""
        data, borders = text_bytes(column)
        out, counts, a, total = [np.zeros(0, dtype=np.uint32)], [np.zeros(1, dtype=np.int64)], 0, 0
        done = 1  # borders that have their count
        while a < len(data):
            z = self._cut(data, borders, min(a + PART_BYTES, len(data)))
            upto = int(np.searchsorted(borders, z, side="right"))
            ids, before = self._part(data[a:z], borders[done:upto] - a)
            out.append(ids)
            counts.append(before + total)
            a, total, done = z, total + len(ids), upto
        counts.append(np.full(len(borders) - done, total, dtype=np.int64))  # empty rows of an empty batch
        return np.concatenate(out), np.concatenate(counts)

    @staticmethod
    def _cut(data: np.ndarray, borders: np.ndarray, z: int) -> int:
        """The first place from z on where a row ends or white space stands."""
        end = int(borders[np.searchsorted(borders, z)])
        while z < end:
            blank = _KIND[data[z : min(end, z + 4096)]] == _SPACE
            if blank.any():
                return z + int(np.argmax(blank))
            z = min(end, z + 4096)
        return end


@functools.lru_cache(maxsize=1)
def process_coder(path: str) -> WordCoder:
    """The encoder that all tasks of a Python worker share."""
    return WordCoder(path)


def write_token_files(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, shards: int | None = None,
) -> DataFrame:
    """Writes the ids of all texts, each with end_id after it; returns the stored list of files.

    Its columns: shard, path (without ending), width, docs, tokens, and the sums over all shards before:
    base_docs, base_tokens. tokenizer: path of the vocabulary file. shards: number of ranges, by default
    spark.sql.shuffle.partitions.
    """
    spark = df.sparkSession
    folder = new_folder(spark, "token-files")

    def write(batches_):
        coder = process_coder(tokenizer)
        width = 2 if max(coder.model.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        fs, base = FileSystem.from_uri(folder)
        files, docs, tokens = [], 0, 0
        try:
            for batch in batches_:
                if not batch.num_rows:
                    continue
                if not files:
                    fs.create_dir(base, recursive=True)
                    files += [fs.open_output_stream(f"{base}/{name}.{end}", compression=None) for end in ("bin", "off", "ids")]
                    files.insert(0, pa.ipc.new_file(files[2], pa.schema([("id", batch.column("id").type)])))
                    files[2].write(np.zeros(1, dtype="<u8").tobytes())
                ids, borders = coder.encode(batch.column("text"))
                ids = np.insert(ids, borders[1:], end_id)
                ends = borders[1:] + np.arange(1, len(borders))
                files[0].write_batch(pa.record_batch({"id": batch.column("id")}))
                files[1].write(ids.astype(f"<u{width}").tobytes())
                files[2].write((ends + tokens).astype("<u8").tobytes())
                docs, tokens = docs + batch.num_rows, tokens + len(ids)
        finally:
            for f in files:
                f.close()
        if docs:
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": f"{folder}/{name}", "width": width, "docs": docs, "tokens": tokens}], schema)

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("text")).select("*", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    # a fixed number of ranges, so partition numbers follow the order and none is merged or split at run time
    ranged = rows.repartitionByRange(shards or partitions(spark), *order).sortWithinPartitions(*order)
    files = stored(batches(ranged.select("id", "text"), write, MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return stored(files.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("docs", "tokens")]), "token-bases")


class Shard:
    """The files of one shard, mapped into memory where they are on a file system of this machine."""

    def __init__(self, path: str, width: int, docs: int):
        fs, base = FileSystem.from_uri(path)
        local = isinstance(fs, LocalFileSystem)
        self.files = [pa.memory_map(f"{base}.{end}") if local else fs.open_input_file(f"{base}.{end}") for end in ("bin", "off", "ids")]
        self.kind, self.docs = np.dtype(f"<u{width}"), docs

    def _slice(self, file, kind: np.dtype, a: int, z: int) -> np.ndarray:
        file.seek(a * kind.itemsize)
        return np.frombuffer(file.read_buffer((z - a) * kind.itemsize), dtype=kind)

    def offsets(self, a: int, z: int) -> np.ndarray:
        return self._slice(self.files[1], np.dtype("<u8"), a, z).astype(np.int64)

    def tokens(self, a: int, z: int) -> np.ndarray:
        return self._slice(self.files[0], self.kind, a, z)

    def ids(self) -> pa.ChunkedArray:
        return pa.ipc.open_file(self.files[2]).read_all().column("id")

    def close(self) -> None:
        for f in self.files:
            f.close()


class TokenFiles:
    """Random access to written files: manifest is the collected list of shards (as many rows as shards)."""

    def __init__(self, manifest):
        rows = sorted(manifest, key=lambda r: r["shard"])
        self.rows = rows
        self.base_docs = np.array([r["base_docs"] for r in rows] + [sum(r["docs"] for r in rows)], dtype=np.int64)
        self.base_tokens = np.array([r["base_tokens"] for r in rows] + [sum(r["tokens"] for r in rows)], dtype=np.int64)
        self.open = functools.lru_cache(maxsize=64)(lambda k: Shard(rows[k]["path"], rows[k]["width"], rows[k]["docs"]))

    def __len__(self) -> int:
        return int(self.base_docs[-1])

    def document(self, n: int) -> np.ndarray:
        """Ids of the n-th document of the whole order."""
        if not 0 <= n < len(self):
            raise IndexError(n)
        k = int(np.searchsorted(self.base_docs, n, side="right")) - 1
        shard = self.open(k)
        a, z = shard.offsets(n - int(self.base_docs[k]), n - int(self.base_docs[k]) + 2).tolist()
        return shard.tokens(a, z)

    def stretch(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of the whole row of ids, across shards."""
        start, end, out = max(0, start), min(start + length, int(self.base_tokens[-1])), [np.zeros(0, dtype=np.uint32)]
        while start < end:
            k = int(np.searchsorted(self.base_tokens, start, side="right")) - 1
            base, upto = int(self.base_tokens[k]), min(end, int(self.base_tokens[k + 1]))
            out.append(self.open(k).tokens(start - base, upto - base).astype(np.uint32))
            start = upto
        return np.concatenate(out)


def read_token_files(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens, ids (binary: little-endian unsigned 32-bit)."""

    def read(batches_):
        for batch in batches_:
            for r in batch.to_pylist():
                shard = Shard(r["path"], r["width"], r["docs"])
                try:
                    offsets, names, a = shard.offsets(0, r["docs"] + 1), shard.ids(), 0
                    while a < r["docs"]:
                        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + READ_TOKENS, side="right")) - 1)
                        data = shard.tokens(int(offsets[a]), int(offsets[z])).astype("<u4")
                        cuts = (offsets[a : z + 1] - offsets[a]) * 4
                        if cuts[-1] >= 1 << 31:
                            raise ValueError(f"a document of {len(data)} ids is too long for one row")
                        ids = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
                        name = names.slice(a, z - a).combine_chunks()
                        yield pa.record_batch({"doc_id": name, "start": pa.array(offsets[a:z] + r["base_tokens"]), "n_tokens": pa.array(np.diff(offsets[a : z + 1])), "ids": ids})
                        a = z
                finally:
                    shard.close()

    return batches(manifest.repartition(partitions(spark), "shard"), read, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents that were read back."""
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
