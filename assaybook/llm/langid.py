"""Language identification with a byte convolutional network, trained here in numpy.

A text's bytes (A-Z lowered) are cut into windows of WINDOW bytes. Each byte has a small vector; filters
of several widths slide over the window, the largest answer of each filter is kept, and a softmax layer
turns these into language probabilities. A text's probabilities are the mean over all of its windows, weighted
by their bytes, so the whole text counts.

Training: windows of a bounded sample of labelled rows (SAMPLE_ROWS texts of each language, chosen by the
hash of the text; WINDOWS_OF_ROW windows of each, spread over the whole text) go to the driver. Every language is
learned: TOTAL_ROWS texts of all languages are shared out evenly where SAMPLE_ROWS of each would be more, so at most
TOTAL_ROWS * WINDOWS_OF_ROW * WINDOW bytes go to the driver (and one text of each language at least).
The result depends on the rows alone: weights start from a fixed seed.

With `noise` the model also learns what is no language, as the label `und`: windows of the sample with their bytes
in random order, or with random letters, as many as of a language on average. A closed choice can't tell this by its score: random
letters score 0.3 to 0.7, as short texts do.

Defined cases: a null text, or one without any letter, is `und` with score 0, as is every text when nothing
could be learned. Rows with a null language are never learned from. Ties go to the first language by name.
Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .bytewords import LOWER, text_bytes
from .shared import batches, fresh, wider

WINDOW = 128
WIDTHS, FILTERS, DIM = (2, 3, 4), 16, 8
SAMPLE_ROWS, WINDOWS_OF_ROW, TOTAL_ROWS = 1200, 6, 240_000
UND = "und"
#: A shorter text with a letter is never taken for noise: less than two windows are too little to tell.
SURE_BYTES = 2 * WINDOW
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = True


@dataclass
class Model:
    """Weights: byte vectors, one (width * DIM, FILTERS) matrix a width, their biases, and the softmax layer."""

    languages: list[str]
    vectors: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled answers of all filters (windows x filters), and where each was found, for windows of bytes."""
        emb = self.vectors[x]  # windows x WINDOW x DIM
        pooled, where = [], []
        for width, w, b in zip(WIDTHS, self.filters, self.biases, strict=True):
            n = x.shape[1] - width + 1
            # a filter's answer is the sum of one product for each byte of its width
            answers = emb[:, :n] @ w[:DIM]
            for j in range(1, width):
                answers += emb[:, j : j + n] @ w[j * DIM : (j + 1) * DIM]
            at = answers.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(answers, at[:, None, :], 1)[:, 0] + b)
        return np.maximum(np.concatenate(pooled, axis=1), 0), where

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities of windows; a filter's answer is summed up from tables of its answers to each byte."""
        tables = self._tables()
        pooled = []
        for width, parts in zip(WIDTHS, tables, strict=True):
            n = x.shape[1] - width + 1
            answers = parts[0].take(x[:, :n], axis=0)
            for j in range(1, width):
                answers += parts[j].take(x[:, j : j + n], axis=0)
            pooled.append(answers.max(axis=1))
        h = np.maximum(np.concatenate(pooled, axis=1) + np.concatenate(self.biases), 0)
        return _softmax(h @ self.out + self.out_bias)

    def _tables(self) -> list[list[np.ndarray]]:
        if not hasattr(self, "_made"):
            self._made = [[np.ascontiguousarray(self.vectors @ w[j * DIM : (j + 1) * DIM]) for j in range(width)] for width, w in zip(WIDTHS, self.filters, strict=True)]
        return self._made


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Model:
    """Adam on cross entropy, every language weighted alike; x: windows of bytes, y: numbers of languages."""
    rng = np.random.default_rng(seed)
    f = np.float32
    model = Model(
        languages, rng.normal(0, 0.5, (256, DIM)).astype(f), [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)).astype(f) for w in WIDTHS],
        [np.zeros(FILTERS, f) for _ in WIDTHS], rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(f), np.zeros(len(languages), f),
    )
    params = [model.vectors, *model.filters, *model.biases, model.out, model.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))).astype(f)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), batch):
            rows = order[a : a + batch]
            xb, yb = x[rows], y[rows]
            h, where = model.features(xb)
            dz = _softmax(h @ model.out + model.out_bias)
            dz[np.arange(len(rows)), yb] -= 1
            dz *= weight[yb][:, None] / len(rows)
            dh = (dz @ model.out.T) * (h > 0)
            grads = [np.zeros_like(model.vectors)]
            d_filters = []
            for k, (width, w, at) in enumerate(zip(WIDTHS, model.filters, where, strict=True)):
                d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                dw = np.zeros_like(w)
                for j in range(width):
                    seen = np.take_along_axis(xb, at + j, 1)  # the byte under this part of each filter
                    dw[j * DIM : (j + 1) * DIM] = np.einsum("nfd,nf->df", model.vectors[seen], d)
                    np.add.at(grads[0], seen, d[:, :, None] * w[j * DIM : (j + 1) * DIM].T[None])
                d_filters.append(dw)
            grads += [*d_filters, *[dh[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))], h.T @ dz, dz.sum(axis=0)]
            step += 1
            lr = rate * (1 - epoch / epochs * 0.7)
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(f)
    return model


def windows(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all rows (count x WINDOW, short ones filled up with 0), the row of each, and its bytes."""
    sizes = np.diff(borders)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    k = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = borders[:-1][row] + k * WINDOW
    used = np.minimum(WINDOW, borders[1:][row] - starts)
    if not len(row):
        return np.zeros((0, WINDOW), dtype=np.uint8), row, used
    place = starts[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < used[:, None]
    return np.where(inside, LOWER[data[np.minimum(place, len(data) - 1)]], 0).astype(np.uint8), row, used


def scrambled(x: np.ndarray) -> np.ndarray:
    """Windows without a language: every other one with its bytes in random order, the rest with random letters for a-z."""
    rng, out = np.random.default_rng(11), x.copy()
    for i, row in enumerate(out):
        used = row[: np.count_nonzero(row)]
        if i % 2:
            used[:] = rng.permutation(used)
        else:
            letters = np.flatnonzero((used >= 97) & (used < 123))
            used[letters] = rng.integers(97, 123, len(letters))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", only: Column | None = None, noise: bool = False) -> Model | None:
    """A model of the languages of docs, or of the rows for which `only` holds; None if no row can be learned from.

    With `noise` also of what is no language (UND).
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), (F.lit(True) if only is None else only).alias("use"))
    rows = rows.filter("use and lang is not null and length(text) > 0").drop("use")
    keyed = rows.withColumn("h", F.xxhash64("text"))
    # texts, not rows: copies of a text count once
    counts = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    names = sorted(counts)
    if not names:
        return None
    most = max(1, min(SAMPLE_ROWS, TOTAL_ROWS // len(names)))
    # texts of the least hashes: some more than wanted of each language, then exactly as many
    share = F.create_map(*[F.lit(v) for name, n in counts.items() for v in (name, min(1.0, (1.5 * most + 20) / max(n, 1)))])
    few = keyed.filter(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < share[F.col("lang")])
    ranked = few.dropDuplicates(["lang", "h"]).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= most)

    def cut(batches_):
        for b in batches_:
            w, row, _ = windows(*text_bytes(b.column("text")))
            first = np.searchsorted(row, np.arange(b.num_rows + 1))
            pick = [a + (np.arange(min(WINDOWS_OF_ROW, z - a)) * (z - a)) // min(WINDOWS_OF_ROW, z - a) for a, z in zip(first[:-1], first[1:], strict=True) if z > a]
            at = np.concatenate(pick) if pick else np.zeros(0, dtype=np.int64)
            yield pa.record_batch({"lang": b.column("lang").take(pa.array(row[at])), "bytes": pa.array([x.tobytes() for x in w[at]], pa.binary())})

    got = batches(ranked.select("lang", "text"), cut, "lang string, bytes binary").toArrow()
    number = {name: i for i, name in enumerate(names)}
    pairs = sorted((b, number[x]) for b, x in zip(got.column("bytes").to_pylist(), got.column("lang").to_pylist(), strict=True) if x in number)
    x = np.frombuffer(b"".join(b for b, _ in pairs), dtype=np.uint8).reshape(-1, WINDOW)
    y = np.array([n for _, n in pairs])
    if noise:
        bad = scrambled(x[:: len(names)])
        names = names if UND in names else [*names, UND]
        x, y = np.concatenate([x, bad]), np.concatenate([y, np.full(len(bad), names.index(UND))])
    return train(x, y, names)


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """df with lang_pred and score (names with underscores before them if df has such columns)."""
    pred, score = fresh(df.columns, "lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)

    def letters(column: pa.Array, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Rows with a letter; non-ASCII texts without ASCII letters are looked at character by character."""
        seen = np.concatenate([[0], np.cumsum(_LETTERS[data])])[borders]
        has = np.diff(seen) > 0
        for i in np.flatnonzero(~has & (np.diff(borders) > 0)).tolist():
            has[i] = any(c.isalpha() for c in column[i].as_py())
        return has

    def work(batches_):
        model = shared.value
        for b in batches_:
            column = b.column(text_col)
            data, borders = text_bytes(column)
            has = letters(column, data, borders)
            langs, scores = [UND] * b.num_rows, np.zeros(b.num_rows)
            if model is not None and has.any():
                w, row, used = windows(data, borders)
                total = np.zeros((b.num_rows, len(model.languages)))
                for a in range(0, len(w), 64):  # answers of 64 windows fit in a core's cache
                    np.add.at(total, row[a : a + 64], model.probabilities(w[a : a + 64]) * used[a : a + 64, None])
                best = total.argmax(axis=1)
                share = total.max(axis=1) / np.maximum(np.diff(borders), 1)
                for i in np.flatnonzero(has).tolist():
                    langs[i], scores[i] = model.languages[best[i]], min(1.0, float(share[i]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*b.schema.names, pred, score])

    return batches(df, work, wider(df, **{pred: StringType(), score: DoubleType()}))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; a null id has fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)), F.lit(0))


def identify(df: DataFrame, model: Model | None, text_col: str = "text", margin: float = 0.001) -> DataFrame:
    """df without the rows that have no language: `und`, or a score that is no better than a blind guess.

    A blind guess among L languages scores 1/L; a text must exceed it by `margin` of what is left up to 1. This finds
    only texts of which the model knows nothing; noise, and languages that were not learned, go as `und` with a model that was fitted
    with `noise`. There a text with a letter and fewer than SURE_BYTES bytes stays.

    Without a model only texts without a letter go: that nothing could be learned says nothing about a text.
    """
    if model is None:
        return df.filter(F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    told = predict(df, model, text_col)
    pred, score = told.columns[-2:]
    blind = 1 / len(model.languages)
    min_score = blind + margin * (1 - blind)
    short = (F.col(score) > 0) & (F.octet_length(F.col(text_col)) < SURE_BYTES)
    return told.filter(((F.col(pred) != UND) | short) & (F.col(score) >= min_score)).select(*df.columns)
