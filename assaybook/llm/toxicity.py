"""Toxicity grades by cumulative-link ordinal regression over sparse word counts.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector for all grades and rising thresholds, so the
grades share what is learned. x holds log(1 + count) of the vocabulary's features in the whole text: words, and
word beginnings of PREFIXES bytes, for languages that build words from stems. Outputs are
the probabilities of the grades, their expectation (the severity), and whether grade 0 is the less likely half.

Learning: labels say toxic or not; a bounded sample of labelled documents is taken (SAMPLE_ROWS of either
label, by the hash of their id). The vocabulary is the VOCABULARY features whose share of toxic documents
exceeds that of clean ones most clearly (likelihood ratio), counted over the sample in the cluster; their weights
never fall below 0. Labels have no degrees, so a toxic document's grade is 1,
2 or 3 by thirds of how much told-off language (features of strong log odds) it holds; a column of
grades is taken as it is when there is one. Weights of rows restore the labels' own shares. At most SAMPLE_ROWS
* 2 * VOCABULARY counts go to the driver.

Defined cases: null and empty texts have no features and get the grade that the thresholds alone give; nulls
among labels or ids are passed over, repeated labels of an id count by their largest; without both kinds
of labelled rows every severity is 0; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import ALNUM, prefix_hashes, words
from .shared import batches

SAMPLE_ROWS, VOCABULARY, LEAST_DOCS, LEAST_RATIO = 3000, 512, 5, 4.0
PREFIXES = (4, 5, 6, 7, 8, 10)  # bytes


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted uint64 word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising; one fewer than the grades

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        upto = 1 / (1 + np.exp(-np.clip(self.thresholds - score[:, None], -60, 60)))
        return np.diff(np.concatenate([np.zeros((len(score), 1)), upto, np.ones((len(score), 1))], axis=1), axis=1)


def features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every word, and of every beginning of each size."""
    w = words(column, ALNUM)
    row = w.row_of()
    return [(row, w.hashes), *[(row[at], h) for at, h in prefix_hashes(w, PREFIXES)]]


def counts(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of a batch: row, feature and count of each entry."""
    pairs = [np.zeros(0, dtype=np.int64)]
    for row, h in features(column):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = np.flatnonzero(vocabulary[at] == h)
        pairs.append(row[known] * len(vocabulary) + at[known])
    pair, n = np.unique(np.concatenate(pairs), return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), n


def train(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, vocabulary: np.ndarray, steps: int = 400, decay: float = 1e-4, rising: bool = False) -> Model:
    """Adam on the weighted likelihood; thresholds rise because they are sums of exponentials. rising: no weight below 0."""
    grades = int(grade.max()) + 1
    w = np.zeros(x.shape[1])
    base = np.zeros(1)
    gaps = np.zeros(max(0, grades - 2))
    params, first, second = [w, base, gaps], [np.zeros_like(p) for p in (w, base, gaps)], [np.zeros_like(p) for p in (w, base, gaps)]
    weight = weight / weight.sum()
    rows = np.arange(len(x))
    for step in range(1, steps + 1):
        theta = np.concatenate([base, base + np.cumsum(np.exp(gaps))])
        z = np.clip(theta - (x @ w)[:, None], -30, 30)
        upto = np.concatenate([np.zeros((len(x), 1)), 1 / (1 + np.exp(-z)), np.ones((len(x), 1))], axis=1)
        slope = upto * (1 - upto)  # of each boundary; none at the outer ones
        p = np.maximum(upto[rows, grade + 1] - upto[rows, grade], 1e-12)
        d_high, d_low = -weight * slope[rows, grade + 1] / p, weight * slope[rows, grade] / p
        d_theta = np.zeros(grades + 1)
        np.add.at(d_theta, grade + 1, d_high)
        np.add.at(d_theta, grade, d_low)
        d_theta = d_theta[1:grades]
        after = np.cumsum(d_theta[::-1])[::-1]
        grads = [-(x.T @ (d_high + d_low)) + decay * w, np.array([after[0]]), after[1:] * np.exp(gaps)]
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        if rising:
            np.maximum(w, 0, out=w)
    return Model(vocabulary, w, np.concatenate([base, base + np.cumsum(np.exp(gaps))]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", grade_col: str | None = None) -> Model | None:
    """A model of labels (id, toxic 0/1, and grades if grade_col names them); None without both kinds."""
    told = labels.select(F.col(id_col).alias("label_id"), F.col(toxic_col).cast("int").alias("toxic"), (F.col(grade_col) if grade_col else F.lit(None)).cast("int").alias("grade"))
    told = told.filter("label_id is not null and toxic is not null").groupBy("label_id").agg(F.max("toxic").alias("toxic"), F.max("grade").alias("grade"))
    sizes = {r.toxic: r.n for r in told.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r.toxic in (0, 1)}
    if len(sizes) < 2:
        return None
    # ids of the least hashes, about 1.5 times as many as wanted; then exactly as many
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.5 * SAMPLE_ROWS / sizes[1]))).otherwise(F.lit(min(1.0, 1.5 * SAMPLE_ROWS / sizes[0])))
    h = F.xxhash64("label_id")
    near = told.filter(F.col("toxic").isin(0, 1)).withColumn("h", h).filter(F.shiftrightunsigned("h", 11) * F.lit(2.0**-53) < share)
    chosen = near.withColumn("r", F.row_number().over(Window.partitionBy("toxic").orderBy("h", "label_id"))).filter(F.col("r") <= SAMPLE_ROWS).drop("h", "r")
    # at most 2 * SAMPLE_ROWS ids: a size bound that allows a broadcast
    sample = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "label_id")
    # of several texts of an id that of the largest hash, whatever the order of rows
    of_id = F.max_by(F.struct("text", "toxic", "grade"), F.struct(F.xxhash64("text"), "text"))
    sample = sample.groupBy("label_id").agg(of_id.alias("s")).select("label_id", "s.*")

    def seen(batches_):
        for b in batches_:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for row, h in features(b.column("text")):
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                once = np.ones(len(h), dtype=bool)
                once[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                yield pa.record_batch({"word": pa.array(h[once].view(np.int64)), "toxic": pa.array(toxic[row[once]], pa.int32())})

    found = batches(sample.select("text", "toxic"), seen, "word long, toxic int").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    n_t, n_c = min(sizes[1], SAMPLE_ROWS), min(sizes[0], SAMPLE_ROWS)
    odds = F.log((F.col("t") + 0.5) / (n_t - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n_c - F.col("c") + 0.5))
    t, c = F.col("t"), F.col("c")
    both = (t + c) / (n_t + n_c)
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    # the likelihood ratio of two shares against one, for features that toxic documents have more often
    ratio = part(t, both * n_t) + part(c, both * n_c) + part(n_t - t, (1 - both) * n_t) + part(n_c - c, (1 - both) * n_c)
    leaning = found.filter((t + c >= LEAST_DOCS) & (odds > 1)).select("word", odds.alias("odds"), ratio.alias("ratio")).filter(F.col("ratio") > LEAST_RATIO)
    top = leaning.orderBy(F.desc("ratio"), "word").limit(VOCABULARY).collect()
    if not top:
        return None
    vocabulary = np.array([r.word for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = vocabulary[order]
    strong = (np.array([r.odds for r in top]) > 2)[order]

    def sparse(batches_):
        for b in batches_:
            row, word, n = counts(b.column("text"), vocabulary)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.record_batch({
                "toxic": b.column("toxic"), "grade": b.column("grade"), "label_id": b.column("label_id"),
                "word": pa.ListArray.from_arrays(pa.array(cuts), pa.array(word, pa.int64())), "n": pa.ListArray.from_arrays(pa.array(cuts), pa.array(n, pa.int64())),
            })

    id_type = dict(docs.dtypes)[id_col]
    got = batches(sample.select("toxic", "grade", "label_id", "text"), sparse, f"toxic int, grade int, label_id {id_type}, word array<long>, n array<long>").toArrow().sort_by("label_id")
    x = np.zeros((got.num_rows, len(vocabulary)))
    for i, (word, n) in enumerate(zip(got.column("word").to_pylist(), got.column("n").to_pylist(), strict=True)):
        x[i, word] = n
    toxic = got.column("toxic").to_numpy()
    if not 0 < toxic.sum() < len(toxic):
        return None
    if grade_col:
        grade = np.maximum(np.where(toxic > 0, [g if g is not None else 1 for g in got.column("grade").to_pylist()], 0), 0)
    else:
        amount = np.log1p(x[:, strong]).sum(axis=1)
        cuts = np.quantile(amount[toxic > 0], [1 / 3, 2 / 3])
        grade = np.where(toxic > 0, 1 + np.searchsorted(cuts, amount), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # grades without a row don't count
    weight = np.where(toxic > 0, sizes[1] / max(1, toxic.sum()), sizes[0] / max(1, (1 - toxic).sum()))
    return train(np.log1p(x), grade.astype(np.int64), weight, vocabulary, rising=True)


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, severity (expected grade), grade (the likeliest), p_toxic, toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches_):
        model = shared.value
        for b in batches_:
            total = np.zeros(b.num_rows)
            if model is not None:
                row, word, n = counts(b.column("text"), model.vocabulary)
                np.add.at(total, row, np.log1p(n) * model.weights[word])
                p = model.probabilities(total)
            else:
                p = np.ones((b.num_rows, 1))
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "severity": pa.array(p @ np.arange(p.shape[1])), "grade": pa.array(p.argmax(axis=1), pa.int32()),
                "p_toxic": pa.array(1 - p[:, 0]), "toxic": pa.array(p[:, 0] <= 0.5),
            })

    id_type = df.select(id_col).dtypes[0][1]
    return batches(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work, f"doc_id {id_type}, severity double, grade int, p_toxic double, toxic boolean")
