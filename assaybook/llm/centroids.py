"""Centroid clustering with zone maps: vectors in Hilbert order, in blocks with min/max boxes.

Vectors become rows of integers and are put in the order of a Hilbert curve over the components that vary most, so
that neighbours share a block. A block of BLOCK vectors is stored with the least and the largest value of each
component. A pass over the blocks bounds, for each block, how much farther any point of its box can be from a
centroid c than from the centroid p nearest to the box's middle: |x-c|^2 - |x-p|^2 is linear in x, so its minimum over
the box is a sum over components. Where that minimum is above zero, no vector of the block is nearest to c. What is
left are the block's candidates; its vectors are compared with these, exactly, as one array operation.

Boxes prune when vectors lie in clumps (and always where copies of a vector fill a block). On vectors that fill all
directions evenly no box can prune much; the result is the same, by comparing with all centroids.

A pass sends one row of sums per centroid and task; the driver sees k rows of integers a round, whatever the number
of vectors. The blocks are stored once in the shared folder and read by every pass. Vectors on one spot of the curve
are told apart by a row number, so that many copies fall into several partitions.

Arithmetic is exact: 64-bit floats while all sums stay below 2^53, 64-bit integers beyond; sums over vectors are decimals.

Defined cases: vectors of another length, null vectors and those with a null or non-finite component are left out;
a null id hashes after all others; rows that repeat an id are vectors of their own (ties among starting centroids go
by components); with fewer kept vectors than k there are fewer centroids; none kept, or an empty table, gives no rows;
other columns are ignored, whatever their names. Components so large that squared distances leave 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from .shared import batches, partitions, stored

BLOCK = 128
CURVE_DIMS, CURVE_BITS = 8, 7


def kept_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their components as integers) of a column of lists of numbers."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    valid = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(offsets) == dims)
    rows = np.flatnonzero(valid)
    values = column.values
    flat = values.fill_null(math.nan).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    got = flat[(offsets[rows, None] + np.arange(dims)).ravel()].reshape(len(rows), dims)
    fine = np.isfinite(got).all(axis=1)
    rows, got = rows[fine], np.floor(scale * got[fine])
    limit = math.isqrt((1 << 60) // dims)
    if len(got) and np.abs(got).max() > limit:
        raise ValueError(f"components beyond {limit // scale} give squared distances beyond 64 bits")
    return rows, got.astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with coordinates in [0, 2^bits), one row a point.

    From the highest bit down, each coordinate's bit says how the sub-cube is turned: either the first coordinate's
    lower bits are flipped or they change places with this coordinate's. The turned coordinates are a Gray code of the
    place, their bits interleaved.
    """
    x = [c.astype(np.int64) for c in cells.T]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            turned = (x[i] >> bit & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = x[0] ^ np.where(turned, low, swap)
            if i:
                x[i] = x[i] ^ swap
    key = np.zeros(len(cells), dtype=np.int64)
    parity = np.zeros(len(cells), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for c in x:
            parity ^= c >> bit & 1  # a Gray code's prefix parity is the plain number's bit
            key = key << 1 | parity
    return key


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest (ties included) to a point of the box, in rising order."""
    middle = (low + high) // 2
    p = centroids[np.argmin(((centroids - middle) ** 2).sum(axis=1))]
    slope = 2 * (p - centroids)
    least = (centroids**2).sum(axis=1) - (p**2).sum() + np.minimum(slope * low, slope * high).sum(axis=1)
    return np.flatnonzero(least <= 0)


def nearest(vectors: np.ndarray, centroids: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid among `near`, smaller numbers first, and the squared distance) of each vector."""
    chosen = centroids[near]
    most = max(int(np.abs(vectors).max()), int(np.abs(chosen).max()))
    if 4 * most * most * vectors.shape[1] < 1 << 53:
        x, c = vectors.astype(np.float64), chosen.astype(np.float64)
        d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    else:
        d = np.stack([((vectors - c) ** 2).sum(axis=1) for c in chosen], axis=1)
    at = np.argmin(d, axis=1)
    return near[at], d[np.arange(len(d)), at].astype(np.int64)


def block_arrays(batch, kind: np.dtype, dims: int):
    """(ids, vectors, low, high) of each block of a batch of stored blocks."""
    get = lambda x: np.frombuffer(x.as_py(), dtype=kind).astype(np.int64)
    for ids, *data in zip(*[batch.column(c) for c in ("ids", "vecs", "low", "high")], strict=True):
        vectors, low, high = map(get, data)
        yield ids.values, vectors.reshape(-1, dims), low, high


class VectorBlocks:
    """Vectors of a table in Hilbert order, in stored blocks with their boxes."""

    def __init__(self, df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 64):
        self.spark, self.dims, self.scale = df.sparkSession, dims, scale
        self.source = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
        self.id_type = self.source.schema["id"].dataType
        self._measure()
        self.blocks = self._write() if self.rows else None

    def _measure(self) -> None:
        """Number of kept vectors, and mean, deviation and largest size of each component, over all of them."""
        dims, scale = self.dims, self.scale

        def work(batches_):
            n, total, square, most = 0, np.zeros(dims), np.zeros(dims), 0
            for b in batches_:
                got = kept_vectors(b.column("vec"), dims, scale)[1]
                if len(got):
                    n, most = n + len(got), max(most, int(np.abs(got).max()))
                    total, square = total + got.sum(axis=0), square + (got.astype(np.float64) ** 2).sum(axis=0)
            yield pa.record_batch({"n": pa.array([n], pa.int64()), "most": pa.array([most], pa.int64()), "sums": pa.array([[*total, *square]], pa.list_(pa.float64()))})

        parts = batches(self.source.select("vec"), work, "n long, most long, sums array<double>")
        sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * dims)]
        row = parts.agg(F.sum("n").alias("n"), F.max("most").alias("most"), *sums).first()
        self.rows, self.most = row["n"] or 0, row["most"] or 0
        if self.rows:
            s = np.array([row[f"s{i}"] for i in range(2 * dims)]) / self.rows
            self.mean, self.spread = s[:dims], np.sqrt(np.maximum(s[dims:] - s[:dims] ** 2, 0))

    def _write(self) -> DataFrame:
        dims, scale, spark = self.dims, self.scale, self.spark
        kind = np.dtype("<i1" if self.most < 1 << 7 else "<i2" if self.most < 1 << 15 else "<i4")
        self.kind = kind
        axes = np.argsort(-self.spread, kind="stable")[: min(CURVE_DIMS, dims)]
        first, cell = (self.mean - 3 * self.spread)[axes], np.maximum(6 * self.spread[axes], 1e-9) / (1 << CURVE_BITS)

        def keys(batches_):
            for b in batches_:
                rows, got = kept_vectors(b.column("vec"), dims, scale)
                cells = np.clip((got[:, axes] - first) // cell, 0, (1 << CURVE_BITS) - 1)
                data = pa.py_buffer(np.ascontiguousarray(got.astype(kind)))
                cuts = pa.py_buffer((np.arange(len(rows) + 1) * dims * kind.itemsize).astype(np.int32))
                yield pa.record_batch({
                    "id": b.column("id").take(pa.array(rows)), "key": pa.array(hilbert_keys(cells, CURVE_BITS)), "vec": pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, cuts, data]),
                })

        def blocks(batches_):
            held, n = [], 0
            for b in batches_:
                if b.num_rows:
                    held, n = [*held, b], n + b.num_rows
                while n >= BLOCK:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, BLOCK))
                    held, n = table.slice(BLOCK).to_batches(), n - BLOCK
            if n:
                yield block(pa.Table.from_batches(held))

        def block(table):
            ids = table.column("id").combine_chunks()
            data = b"".join(table.column("vec").to_pylist())
            got = np.frombuffer(data, dtype=kind).reshape(-1, dims)
            return pa.record_batch({
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "vecs": pa.array([data], pa.binary()),
                "low": pa.array([got.min(axis=0).tobytes()], pa.binary()), "high": pa.array([got.max(axis=0).tobytes()], pa.binary()),
            })

        keyed = batches(self.source, keys, StructType([StructField("id", self.id_type), *StructType.fromDDL("key long, vec binary").fields]))
        keyed = keyed.withColumn("row", F.monotonically_increasing_id())
        ranged = keyed.repartitionByRange(partitions(spark), "key", "row").sortWithinPartitions("key", "row").select("id", "vec")
        schema = StructType([StructField("ids", ArrayType(self.id_type)), *[StructField(c, BinaryType()) for c in ("vecs", "low", "high")]])
        return stored(batches(ranged, blocks, schema), "vector-blocks")

    def first_centroids(self, k: int, seed: int = 1) -> np.ndarray:
        """The vectors of the k ids whose SHA-256 of '<seed>:<id>' is smallest, in this order; ties by components."""
        kind, dims = self.kind, self.dims

        def rows(batches_):
            for b in batches_:
                for ids, vectors, _, _ in block_arrays(b, kind, dims):
                    code = (vectors + (1 << 31)).astype(">u4")  # these bytes sort as the components do
                    yield pa.record_batch({"id": ids, "code": pa.array([x.tobytes() for x in code], pa.binary())})

        coded = batches(self.blocks.select("ids", "vecs", "low", "high"), rows, StructType([StructField("id", self.id_type), StructField("code", BinaryType())]))
        hashed = coded.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "code")
        found = hashed.orderBy(F.col("h").asc_nulls_last(), "code").limit(k).collect()
        return np.array([np.frombuffer(r.code, dtype=">u4") for r in found], dtype=np.int64) - (1 << 31)

    def sums(self, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(centroid, number of its vectors, their sums by component), a row for each centroid that has any."""
        kind, dims = self.kind, self.dims

        def work(batches_):
            n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dims), dtype=np.int64)
            for b in batches_:
                for _, vectors, low, high in block_arrays(b, kind, dims):
                    at = nearest(vectors, centroids, candidates(low, high, centroids))[0]
                    n += np.bincount(at, minlength=len(n))
                    np.add.at(total, at, vectors)
            some = np.flatnonzero(n)
            yield pa.record_batch({"c": pa.array(some, pa.int32()), "n": pa.array(n[some]), "sums": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

        parts = batches(self.blocks, work, "c int, n long, sums array<long>")
        exact = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
        # k rows of dims integers
        return [(r["c"], r["n"], [int(r[f"s{i}"]) for i in range(dims)]) for r in parts.groupBy("c").agg(F.sum("n").alias("n"), *exact).collect()]

    def improve(self, centroids: np.ndarray, rounds: int) -> np.ndarray:
        """Centroids after so many rounds; one that has no vector stays where it is."""
        for _ in range(rounds):
            centroids = centroids.copy()
            for c, n, sums in self.sums(centroids):
                centroids[c] = [s // n for s in sums]
        return centroids

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """vec_id, cluster, distance of every vector."""
        kind, dims = self.kind, self.dims

        def work(batches_):
            for b in batches_:
                for ids, vectors, low, high in block_arrays(b, kind, dims):
                    at, d = nearest(vectors, centroids, candidates(low, high, centroids))
                    yield pa.record_batch({"vec_id": ids, "cluster": pa.array(at, pa.int32()), "distance": pa.array(d)})

        return batches(self.blocks, work, StructType([StructField("vec_id", self.id_type), *StructType.fromDDL("cluster int, distance long").fields]))

    def candidate_counts(self, centroids: np.ndarray) -> DataFrame:
        """n_vectors, n_candidates of every block: how much the boxes prune."""
        kind, dims = self.kind, self.dims

        def work(batches_):
            for b in batches_:
                got = [(len(v), len(candidates(low, high, centroids))) for _, v, low, high in block_arrays(b, kind, dims)]
                yield pa.record_batch({"n_vectors": pa.array([x[0] for x in got], pa.int64()), "n_candidates": pa.array([x[1] for x in got], pa.int64())})

        return batches(self.blocks, work, "n_vectors long, n_candidates long")


def cluster(
    df: DataFrame, k: int = 16, rounds: int = 3, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, scale: int = 64, seed: int = 1,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (see the module)."""
    kept = VectorBlocks(df, id_col, vec_col, dims, scale)
    out = StructType([StructField("vec_id", kept.id_type), *StructType.fromDDL("cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").fields])
    if not kept.rows:
        return df.sparkSession.createDataFrame([], out)
    centroids = kept.improve(kept.first_centroids(k, seed), rounds)
    rows = stored(kept.assigned(centroids), "assigned")
    totals = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    table = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return rows.select(
        "vec_id", "cluster", "distance", F.element_at(table(totals.items()), F.col("cluster")).cast("long").alias("cluster_inertia"),
        F.lit(sum(totals.values())).cast("long").alias("inertia"), F.element_at(table(enumerate(shas)), F.col("cluster")).alias("centroid_sha256"),
    )
