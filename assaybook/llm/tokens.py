"""Token ids of whole texts, from a public byte-level BPE vocabulary, with a cache of word pieces.

The vocabulary's splitting rule never joins across the start of a word (an optional space and a run of
other characters) or of white space between words, so ids of a text are the ids of these pieces in a row.
Texts are cut into pieces by array operations; each distinct piece is encoded once by the tokenizer.
Texts with white space outside of ASCII, or with control characters that rules count differently, are
encoded whole.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from .bytewords import hash_runs, text_bytes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: How white space beyond ASCII begins in UTF-8; a few other characters that begin so do no harm
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_SEPARATOR = "\n"
_RECENT = 1 << 16


class Tokens:
    """Encoder of one process; holds at most max_pieces distinct pieces, about 40 bytes each.

    Known pieces are sorted arrays of hashes; those of the last batches are in a small dict until they
    are merged into the arrays.
    """

    def __init__(self, path: str, max_pieces: int = 1_500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.newline = self.model.encode(_SEPARATOR, add_special_tokens=False).ids
        self.max_pieces = max_pieces
        self._clear()

    def _clear(self) -> None:
        self.count, self.recent = 0, {}  # hash: number of the piece
        self.hashes, self.numbers = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.start, self.size = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 12, dtype=np.int32)
        self.flat, self.used = np.zeros(1 << 14, dtype=np.uint32), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        texts = [p.decode() for p in pieces]
        # white space of any kind, but for the blank before a word, would run together with the newlines between pieces
        alone = [t.split() != [t.removeprefix(" ")] for t in texts]
        plain = [i for i, x in enumerate(alone) if not x]
        ids: list[list[int]] = [[]] * len(texts)
        if plain:  # one call for all words: newlines between them come back as one id each
            row = np.array(self._ids([_SEPARATOR.join(texts[i] for i in plain)])[0], dtype=np.uint32)
            cuts = np.flatnonzero(row == self.newline[0])
            for i, a, z in zip(plain, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(row)], strict=True):
                ids[i] = row[a:z]
        rest = [i for i, x in enumerate(alone) if x]
        for i, got in zip(rest, self._ids([texts[i] for i in rest]), strict=True):
            ids[i] = np.array(got, dtype=np.uint32)
        n = self.count
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        while n + len(ids) > len(self.start):
            self.start, self.size = np.concatenate([self.start, self.start]), np.concatenate([self.size, self.size])
        while self.used + sizes.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.size[n : n + len(ids)] = sizes
        self.start[n : n + len(ids)] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + sizes.sum()] = np.concatenate(ids)
        self.used += int(sizes.sum())
        self.count += len(ids)
        self.recent.update(zip(hashes, range(n, n + len(ids)), strict=True))
        if len(self.recent) > _RECENT:
            h = np.concatenate([self.hashes, np.fromiter(self.recent.keys(), dtype=np.uint64, count=len(self.recent))])
            at = np.concatenate([self.numbers, np.fromiter(self.recent.values(), dtype=np.int32, count=len(self.recent))])
            order = np.argsort(h, kind="stable")
            self.hashes, self.numbers, self.recent = h[order], at[order], {}

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces of these hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            out[known] = self.numbers[at[known]]
        rest = np.flatnonzero(out < 0)
        out[rest] = [self.recent.get(k, -1) for k in hashes[rest].tolist()]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows of a string column, and n + 1 borders; null reads as empty."""
        data, borders = text_bytes(column)
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(borders), dtype=np.int64)
        space = _SPACE[data]
        before, after = np.ones(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        before[1:] = space[:-1]  # white space just before
        after[:-1] = ~space[1:]  # no white space just after
        ends = borders[1:][np.diff(borders) > 0] - 1
        after[ends] = False
        blank = np.zeros(len(data), dtype=bool)
        blank[1:] = data[:-1] == 32
        begins = np.where(space, ~before | after, before & ~blank)
        begins[borders[:-1][np.diff(borders) > 0]] = True
        starts = np.flatnonzero(begins)
        lens = np.diff(np.append(starts, len(data)))
        uniq, first, inverse = np.unique(hash_runs(data, starts, lens), return_index=True, return_inverse=True)
        if self.count + len(uniq) > self.max_pieces:
            self._clear()
        at = self._find(uniq)
        new = np.flatnonzero(at < 0)
        if len(new):
            n, where = self.count, first[new]
            self._learn(uniq[new].tolist(), [data[a : a + k].tobytes() for a, k in zip(starts[where].tolist(), lens[where].tolist(), strict=True)])
            at[new] = np.arange(n, n + len(new))
        piece = at[inverse]
        sizes = self.size[piece].astype(np.int64)
        after_piece = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.start[piece] - (after_piece - sizes), sizes) + np.arange(after_piece[-1])]
        out = np.concatenate([[0], after_piece])[np.searchsorted(starts, borders)]
        odd = self._odd_rows(data, borders)
        if not len(odd):
            return ids, out
        rows = [ids[a:z] for a, z in zip(out[:-1].tolist(), out[1:].tolist(), strict=True)]
        for i, got in zip(odd.tolist(), self._ids([data[borders[i] : borders[i + 1]].tobytes().decode() for i in odd.tolist()]), strict=True):
            rows[i] = np.array(got, dtype=np.uint32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])

    @staticmethod
    def _odd_rows(data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        at = [np.flatnonzero((data >= 28) & (data <= 31))]
        for string in _WIDE:
            i = np.flatnonzero(data[: len(data) - len(string) + 1] == string[0])
            for j in range(1, len(string)):
                i = i[data[i + j] == string[j]]
            at.append(i)
        places = np.concatenate(at)
        return np.unique(np.searchsorted(borders, places, side="right") - 1)


@functools.lru_cache(maxsize=1)
def process_tokens(path: str) -> Tokens:
    """The encoder that all tasks of a Python worker share, so that later tasks know most pieces already."""
    return Tokens(path)
