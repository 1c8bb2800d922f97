"""Substring deduplication: passages that earlier documents hold already are cut out.

A text is cut into sentences: after . ! or ? and white space, after the full stops, exclamation and question marks
of other scripts, and at line ends. Sentences are cut into pieces of at most WINDOW words by winnowing: of every WINDOW
words in a row within a sentence, the one of the least hash begins a piece. So cuts depend on the next WINDOW - 1 words
to either side only, and a passage is cut alike wherever it stands, with or without punctuation. From every piece the
least run of at least RUN pieces and MIN_WORDS words is hashed (over its lowered words of letters and digits, so case
and punctuation don't count), and so is the least one that ends with each sentence. All runs are joined globally
by hash; a piece is removed when some run that covers it isn't the first of its hash; a sentence that a
passage enters or leaves by under WINDOW words keeps them. First is the run in the
smallest doc_id (null ids last, then by the hash of the text), and within a document the earliest. A repeated
passage of 47 words, anywhere, holds at least one whole run (12 words to the first cut that all documents share, 22
of the run, 13 after it).

In scripts without spaces every character is a word of its own for cutting and hashing, and counts as a half (Chinese,
Japanese) or a quarter (Thai and the like) of a word towards MIN_WORDS.

Only 16 bytes and the order of a run are shuffled. Runs of one hash are summed up before the shuffle, and only
documents that a bitmap finds among those with repeats are shuffled whole; all others pass straight through.

Defined cases: a null text stays null; rows equal in id and text count as one row (neither repeats the other);
a text whose pieces all go becomes empty; ties cannot occur otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .bloom import possibly_in
from .bytewords import ALNUM, Words, mix, text_bytes, words
from .shared import batches, fresh, stored, wider

RUN, MIN_WORDS, WINDOW = 3, 16, 7
_STOP, _WHITE, _LINE = (np.zeros(256, dtype=np.int64) for _ in range(3))
_STOP[[33, 46, 63]] = 1
_WHITE[[9, 10, 11, 12, 13, 32]] = 1
_LINE[[10, 13]] = 1


def _begins(w: Words) -> np.ndarray:
    """Flags of the words that begin a sentence; rows begin new sentences."""
    n = len(w.hashes)
    gap_a, gap_z = (w.starts + w.lens)[:-1], w.starts[1:]
    count = lambda at: (lambda c: c[gap_z] - c[gap_a])(np.concatenate([[0], np.cumsum(at)]))
    within = lambda t: count(t[w.data])
    cut = np.zeros(n, dtype=bool)
    cut[1:] = (within(_LINE) > 0) | ((within(_STOP) > 0) & (within(_WHITE) > 0))
    if len(w.stops):
        there = np.zeros(len(w.data), dtype=np.int64)
        there[w.stops] = 1
        cut[1:] |= count(there) > 0
    cut[w.first[:-1][np.diff(w.first) > 0]] = True
    return cut


def sentences(w: Words) -> np.ndarray:
    """The first word of every piece of a sentence, and the number of words at the end."""
    n = len(w.hashes)
    if not n:
        return np.zeros(1, dtype=np.int64)
    cut = _begins(w)
    m = n - WINDOW + 1
    if m > 0:
        number = np.cumsum(cut)
        least, at = w.hashes[:m].copy(), np.arange(m)
        for j in range(1, WINDOW):
            less = w.hashes[j : m + j] <= least
            least[less] = w.hashes[j : m + j][less]
            at[less] = np.flatnonzero(less) + j
        cut[at[number[:m] == number[WINDOW - 1 :]]] = True
    return np.append(np.flatnonzero(cut), n)


def _sizes(w: Words, at: np.ndarray) -> np.ndarray:
    """Quarters of words before each place."""
    return np.concatenate([[0], np.cumsum(w.quarters)])[at]


def runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first piece and piece after the last of the least run from each piece; the first run of every row (n + 1 borders)."""
    at = sentences(w)
    n = len(at) - 1
    starts_of_rows = np.searchsorted(at[:-1], w.first)  # first piece of each row
    end_of_row = np.repeat(starts_of_rows[1:], np.diff(starts_of_rows))
    i = np.arange(n)
    # the piece after the last: RUN pieces on, or as many as MIN_WORDS words take
    size = _sizes(w, at)
    end = np.maximum(i + RUN, np.searchsorted(size, size[:-1] + 4 * MIN_WORDS))
    ok = end <= end_of_row
    return _hashed(w, at, i[ok], end[ok], starts_of_rows)


def all_runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As runs, with the least run that ends with each sentence, so that a passage goes up to its end."""
    at = sentences(w)
    n = len(at) - 1
    h, i, end, first = runs(w)
    if not n:
        return h, i, end, first
    starts_of_rows = np.searchsorted(at[:-1], w.first)
    z = np.append(np.flatnonzero(_begins(w)[at[:-1]])[1:], n)  # pieces after the last of each sentence
    size = _sizes(w, at)
    a = np.minimum(z - RUN, np.searchsorted(size, size[z] - 4 * MIN_WORDS, side="right") - 1)
    start_of_row = np.repeat(starts_of_rows[:-1], np.diff(starts_of_rows))
    ok = a >= start_of_row[z - 1]
    both = np.unique(np.concatenate([i * (n + 1) + end, a[ok] * (n + 1) + z[ok]]))
    return _hashed(w, at, both // (n + 1), both % (n + 1), starts_of_rows)


def _hashed(w: Words, at: np.ndarray, i: np.ndarray, end: np.ndarray, starts_of_rows: np.ndarray):
    # a run's hash: the polynomial of its word hashes, from sums over all words with wrapped arithmetic
    hashes = np.zeros(len(i), dtype=np.uint64)
    a, z = at[i], at[end]
    step = np.arange(len(i))
    for k in range(int((z - a).max()) if len(i) else 0):
        alive = a[step] + k < z[step]
        step = step[alive]
        hashes[step] = mix(hashes[step]) + w.hashes[a[step] + k]
    return mix(hashes), i, end, np.searchsorted(i, starts_of_rows)


def _own_repeats(h: np.ndarray) -> np.ndarray:
    """Flags of the runs of one row whose hash an earlier run of it has."""
    _, first = np.unique(h, return_index=True)
    out = np.ones(len(h), dtype=bool)
    out[first] = False
    return out


def _keep_ends(drop: np.ndarray, sentence: np.ndarray, sizes: np.ndarray) -> None:
    """Take from a stretch of dropped pieces the few words (under WINDOW) of a sentence that it enters or leaves, in place."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if s and sentence[s - 1] == sentence[s]:
            t = int(np.searchsorted(sentence, sentence[s], side="right"))
            if t < e and sizes[s:t].sum() < WINDOW:
                drop[s:t] = False
        if e < len(drop) and sentence[e] == sentence[e - 1]:
            b = int(np.searchsorted(sentence, sentence[e - 1]))
            if b > s and sizes[b:e].sum() < WINDOW:
                drop[b:e] = False


def _run_table(df: DataFrame) -> DataFrame:
    """Per row of (doc_id, tk, text): doc_id, tk, its distinct run hashes, and if it repeats one itself."""

    def work(batches_):
        for b in batches_:
            h, _, _, first = all_runs(words(b.column("text"), ALNUM, apart=True))
            parts = [np.unique(h[a:z]).view(np.int64) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            borders = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "tk": b.column("tk"), "runs": pa.ListArray.from_arrays(pa.array(borders), pa.array(flat, pa.int64())),
                "own": pa.array(np.diff(borders) < np.diff(first)),
            })

    return stored(batches(df, work, "doc_id long, tk long, runs array<long>, own boolean"), "runs")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with its texts cut, and n_removed and words_removed: sentences that lost words, and words that went."""
    removed, gone, tk, r_id, r_tk, r_hits = fresh(df.columns, "n_removed", "words_removed", "tk", "r_id", "r_tk", "r_hits")
    keyed = df.withColumn(tk, F.xxhash64(text_col))
    table = _run_table(keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(tk).alias("tk"), F.col(text_col).alias("text")))
    # one number that orders documents by id, then by text: 19 digits for either
    number = F.coalesce(F.col("doc_id").cast("decimal(38,0)"), F.lit("9300000000000000000").cast("decimal(38,0)"))
    order = (number * F.lit("10000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + (F.col("tk").cast("decimal(20,0)") + F.lit("9223372036854775808").cast("decimal(20,0)"))
    spread = table.withColumn("ord", order.cast("decimal(38,0)")).select("doc_id", "tk", "ord", F.explode("runs").alias("h"))
    firsts = spread.select("h", "ord").groupBy("h").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").select("h", "first")
    hits = spread.join(stored(firsts, "firsts"), "h").filter("ord > first").groupBy("doc_id", "tk").agg(F.collect_set("h").alias("hits"))
    own = table.filter("own").select("doc_id", "tk", F.array().cast("array<long>").alias("hits"))
    told = stored(hits.unionByName(own).groupBy("doc_id", "tk").agg(F.max_by("hits", F.size("hits")).alias("hits")), "repeats")

    def cut(batches_):
        for b in batches_:
            column = b.column(text_col)
            w = words(column, ALNUM, apart=True)
            h, i, end, first = all_runs(w)
            at = sentences(w)
            sentence = np.cumsum(_begins(w)[at[:-1]])
            rows = np.searchsorted(at[:-1], w.first)
            raw, borders = text_bytes(column)
            texts, n_removed, n_words = [], [], []
            for r, hits in enumerate(b.column(r_hits).to_pylist()):
                part = slice(int(first[r]), int(first[r + 1]))
                bad = _own_repeats(h[part]) | np.isin(h[part].view(np.int64), np.array(hits or [], dtype=np.int64))
                a, z = int(rows[r]), int(rows[r + 1])
                covered = np.zeros(z - a + 1, dtype=np.int64)
                np.add.at(covered, i[part][bad] - a, 1)
                np.add.at(covered, end[part][bad] - a, -1)
                drop = np.cumsum(covered)[: z - a] > 0
                _keep_ends(drop, sentence[a:z], np.diff(at[a : z + 1]))
                if hits is None or not drop.any():
                    texts.append(column[r].as_py())
                    n_removed.append(0)
                    n_words.append(0)
                    continue
                begin = np.append(w.starts[at[a:z]], borders[r + 1])  # a piece reaches to the next one's first word
                begin[0] = borders[r]
                texts.append(b"".join(raw[begin[k] : begin[k + 1]].tobytes() for k in np.flatnonzero(~drop).tolist()).decode())
                n_removed.append(len(np.unique(sentence[a:z][drop])))
                n_words.append(int(np.diff(at[a : z + 1])[drop].sum()))
            out = dict(zip(b.schema.names, b.columns, strict=True)) | {text_col: pa.array(texts, pa.string()), removed: pa.array(n_removed, pa.int64()), gone: pa.array(n_words, pa.int64())}
            out.pop(r_hits)
            yield pa.record_batch(out)

    flag = possibly_in(told.select("tk"), "tk")(F.col(tk))
    keys = told.toDF(r_id, r_tk, r_hits)
    joined = keyed.filter(flag).join(keys, (F.col(tk) == F.col(r_tk)) & F.col(id_col).cast("long").eqNullSafe(F.col(r_id)), "left").select(*df.columns, r_hits)
    schema = wider(df, **{removed: LongType(), gone: LongType()})
    alone = keyed.filter(~flag).select(*df.columns, F.lit(0).cast("long").alias(removed), F.lit(0).cast("long").alias(gone))
    return alone.unionByName(batches(joined, cut, schema))
