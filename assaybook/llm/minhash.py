"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Signature: shingle hashes are put in a random order by one permutation (of 32-bit numbers); a second
permutation, shifted circularly by k, gives coordinate k as the least value it takes over the set. So
two permutations make all 256 coordinates. Bands of 4 of the first 128 make 32 bucket keys a document: a pair
of similarity 0.8 shares none of them with a probability of 5e-8.

Documents with equal shingle sets are one class and take part once. Within a bucket not all pairs are
compared at once: first every member with the bucket's smallest member, then, in buckets whose members aren't
connected by then, with the member that is most like all (most coordinates in common with the bucket's most
frequent values: the original, where the others are edited copies), and in those still open the pairs of
different components, in blocks of at most 2 * BLOCK members. A pair is verified on its full shingle sets, read
from the texts, unless its set sizes rule it out, or counts of its shingles in CELLS hash cells do (the sum of
the smaller counts bounds the intersection from above), or its signatures agree in under 70 % of the
coordinates (a pair of similarity 0.8 does so with a probability of 2e-5). No bucket or candidate is capped. Pairs stay pairs of class representatives.

Defined cases: a set holds the distinct runs of `width` words; a text of fewer words has its whole sequence
as its only element; null texts and texts without words have an empty set and link with nothing. Rows with a
null id form groups like others; a group's component_id is its smallest non-null id (null if it has none).
Repeated rows are rows of one group. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import possibly_in
from .bytewords import SPACED, mix, shingles, words
from .shared import batches, fresh, stored

COORDINATES, BANDED, BAND, CELLS = 256, 128, 4, 256
BLOCK = 512  # members of a bucket that one side of a comparison holds
_CHUNK = 1 << 16  # shingles worked on at once, so that they stay in the cache


def _mix32(x: np.ndarray, y: np.ndarray) -> None:
    """A permutation of 32-bit numbers, in place; y is scratch space."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        np.right_shift(x, np.uint32(shift), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(factor), out=x)
    np.right_shift(x, np.uint32(16), out=y)
    np.bitwise_xor(x, y, out=x)


def signatures(flat: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """COORDINATES minima for each row, none of which may be empty: rows x COORDINATES, uint32."""
    n = len(borders) - 1
    out = np.empty((n, COORDINATES), dtype=np.uint32)
    row = 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(borders, borders[row] + _CHUNK, side="right")) - 1)
        part = flat[borders[row] : borders[last]]
        sigma = (part ^ (part >> np.uint64(32))).astype(np.uint32)
        scratch, work = np.empty_like(sigma), np.empty_like(sigma)
        _mix32(sigma, scratch)
        starts = borders[row:last] - borders[row]
        for k in range(COORDINATES):
            np.add(sigma, np.uint32(k), out=work)
            _mix32(work, scratch)
            out[row:last, k] = np.minimum.reduceat(work, starts)
        row = last
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket key for each band: rows x bands, int64; keys of different bands differ."""
    parts = sig[:, :BANDED].reshape(len(sig), BANDED // BAND, BAND).astype(np.uint64)
    acc = mix(np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64) + np.uint64(1), parts.shape[:2]))
    for j in range(BAND):
        acc = mix(acc + parts[:, :, j])
    return acc.view(np.int64)


def cells(flat: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many shingles of each row fall into each hash cell: rows x CELLS, uint8; all 255 if a count exceeds 254."""
    n = len(borders) - 1
    row = np.repeat(np.arange(n), np.diff(borders))
    out = np.bincount(row * CELLS + (flat >> np.uint64(40)).astype(np.int64) % CELLS, minlength=n * CELLS).reshape(n, CELLS)
    out[(out > 254).any(axis=1)] = 255
    return out.astype(np.uint8)


def _possible(x: np.ndarray, y: np.ndarray, n_x, n_y, percent: int) -> np.ndarray:
    """Whether sets of these cells and sizes can have the similarity, row by row."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return (100 * most >= percent * (n_x + n_y - most)) | ((x[:, 0] == 255) & (y[:, 0] == 255))


def _prepare(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: id, keys of its text, set size, digest of its set, signature (low bytes) and cells, bucket keys."""

    def work(batches_):
        for b in batches_:
            flat, borders = shingles(words(b.column("text"), SPACED), width)
            sizes = np.diff(borders)
            full = np.flatnonzero(sizes)
            raw = flat.tobytes()
            sets = [hashlib.blake2b(raw[8 * a : 8 * z], digest_size=16).digest() if z > a else None for a, z in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
            sig = signatures(flat, np.append(borders[:-1][full], borders[-1]))
            low, keys = [None] * len(sizes), [None] * len(sizes)
            count = cells(flat, borders)
            for i, s, k in zip(full.tolist(), sig.astype(np.uint8), bands(sig), strict=True):
                low[i], keys[i] = s.tobytes() + count[i].tobytes(), k
            yield pa.record_batch({
                "doc_id": b.column("doc_id"), "tk": b.column("tk"), "tk2": b.column("tk2"), "n_shingles": pa.array(sizes, pa.int64()),
                "class": pa.array(sets, pa.binary()), "sig": pa.array(low, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())),
            })

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tk"), F.hash(text_col).alias("tk2"), F.col(text_col).alias("text"))
    schema = "doc_id long, tk long, tk2 int, n_shingles long, class binary, sig binary, bands array<long>"
    return stored(batches(src, work, schema).withColumn("row", F.monotonically_increasing_id()), "signatures")


def _sketches(t) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(t.to_pylist()), dtype=np.uint8).reshape(-1, COORDINATES + CELLS)
    return both[:, :COORDINATES], both[:, COORDINATES:]


def _likely(pairs: DataFrame, percent: int, share: float) -> DataFrame:
    """Of pairs (a, b, n_a, n_b, sig_a, sig_b) those that signatures and cells don't rule out: distinct (a, b)."""
    least = round(share * COORDINATES)

    def work(batches_):
        for b in batches_:
            if b.num_rows:
                (x, x_cells), (y, y_cells) = (_sketches(b.column(c)) for c in ("sig_a", "sig_b"))
                n_a, n_b = (b.column(c).to_numpy() for c in ("n_a", "n_b"))
                ok = pa.array(((x == y).sum(axis=1) >= least) & _possible(x_cells, y_cells, n_a, n_b, percent))
                yield pa.record_batch({c: b.column(c).filter(ok) for c in ("a", "b")})

    return pairs.mapInArrow(work, "a long, b long").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have a Jaccard similarity of at least percent / 100."""

    def work(batches_):
        for b in batches_:
            (x, xs), (y, ys) = (shingles(words(b.column(c), SPACED), width) for c in ("text_a", "text_b"))
            ok = []
            for i in range(b.num_rows):
                u, v = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                common = len(np.intersect1d(u, v, assume_unique=True))
                ok.append(100 * common >= percent * (len(u) + len(v) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch({c: b.column(c).filter(keep) for c in ("a", "b")})

    wide = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return batches(wide.select("a", "b", "text_a", "text_b"), work, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """node, comp for every node of edges (a, b): comp is the smallest node that it is connected with.

    Every component hooks onto its smallest neighbour, and chains of hooks are followed by doubling until
    all point at their end; the edges left between components form the next, much smaller graph.
    """
    labels, left = None, edges.select("a", "b")
    while True:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "hooks")
        while True:
            up = hooks.select(F.col("a").alias("to"), F.col("to").alias("up"))
            longer = stored(hooks.join(up, "to", "left").select("a", F.coalesce("up", "to").alias("to"), (F.col("up") < F.col("to")).alias("moved")), "hooks")
            hooks, moved = longer.select("a", "to"), not longer.filter("moved").isEmpty()
            if not moved:
                break
        roots = hooks.select(F.col("a").alias("comp"), F.col("to").alias("root"))
        if labels is None:
            labels = hooks.select(F.col("a").alias("node"), F.col("to").alias("comp"))
        else:
            labels = labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
        labels = stored(labels, "labels")
        of = lambda c: hooks.select(F.col("a").alias(c), F.col("to").alias(f"to_{c}"))
        left = stored(
            left.join(of("a"), "a").join(of("b"), "b").filter("to_a <> to_b")
            .select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(),
            "edges",
        )
        if left.isEmpty():
            return labels


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets whose members are in more than one component, with their comp."""
    told = stored(members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
    keys = told.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low < high").select("key", "n")
    return stored(told.join(keys, "key"), "open")


def _blocks(members: DataFrame) -> DataFrame:
    """Members with the number of blocks of their bucket, and their own block: about BLOCK members each."""
    placed = members.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    return placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))


def _centres(members: DataFrame) -> DataFrame:
    """key and node of the member of each bucket (of its first block) that agrees most with the others' values."""

    def work(key, t):
        sig = _sketches(t.column("sig"))[0]
        if len(sig) > 2:
            values, order = np.sort(sig, axis=0), np.arange(len(sig))[:, None]
            new = np.ones_like(values, dtype=bool)
            new[1:] = values[1:] != values[:-1]
            since = order - np.maximum.accumulate(np.where(new, order, 0), axis=0)  # how often a value came before
            mode = values[since.argmax(axis=0), np.arange(COORDINATES)]
            i = int((sig == mode).sum(axis=1).argmax())
        else:
            i = len(sig) - 1
        return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "node": t.column("node").slice(i, 1)})

    return _blocks(members).filter("block = 0").select("key", "node", "sig").groupBy("key").applyInArrow(work, "key long, node long")


def _pairs_left(members: DataFrame, percent: int, share: float) -> DataFrame:
    """Likely pairs of different components within each bucket; large buckets in pairs of blocks.

    A pair that shares several bands is found in each of them and made distinct afterwards: the low bytes that members
    carry don't tell which other buckets a pair shares.
    """
    least = round(share * COORDINATES)

    def work(key, t):
        i, j = key[1].as_py(), key[2].as_py()
        node, comp, size, block = (t.column(c).to_numpy() for c in ("node", "comp", "n_shingles", "block"))
        sig, cell = _sketches(t.column("sig"))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out = []
        for p in left.tolist():
            q = right[(comp[right] != comp[p]) & (100 * np.minimum(size[right], size[p]) >= percent * np.maximum(size[right], size[p]))]
            same = sig[q] == sig[p]
            q = q[same.sum(axis=1) >= least]
            q = q[_possible(cell[q], cell[p : p + 1], size[q], size[p], percent)]
            out.append(np.stack([np.minimum(node[q], node[p]), np.maximum(node[q], node[p])], axis=1))
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)
        return pa.table({"a": pa.array(got[:, 0], pa.int64()), "b": pa.array(got[:, 1], pa.int64())})

    # block i meets block j >= i once: a member goes with its block to the pairs that hold it
    dealt = _blocks(members).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return dealt.select("key", "i", "j", "block", "node", "comp", "n_shingles", "sig").groupBy("key", "i", "j").applyInArrow(work, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, share: float = 0.7) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept, and tk, tk2, the keys of its text."""
    rows = _prepare(df, id_col, text_col, width)
    classes = stored(rows.filter("class is not null").groupBy("class").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), "classes")
    reps = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "tk", "tk2", "n_shingles", "sig", "bands")
    keys = reps.select("node", F.posexplode("bands").alias("band", "key"))
    busy = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1").select("key", "pivot")
    placed = stored(keys.join(busy, "key"), "placed")
    shared_nodes = placed.select("node").distinct()
    candidates = stored(reps.drop("bands").join(shared_nodes, "node", "left_semi"), "candidates")
    members = stored(placed.join(candidates.select("node", "n_shingles", "sig"), "node"), "members")
    # the full texts of the candidates: a bitmap keeps all other texts out of the shuffle
    of_text = df.select(F.xxhash64(text_col).alias("tk"), F.hash(text_col).alias("tk2"), F.col(text_col).alias("text"))
    near = of_text.filter(possibly_in(candidates.select("tk"), "tk")(F.col("tk"))).dropDuplicates(["tk", "tk2"])
    texts = stored(near.join(candidates.select("node", "tk", "tk2"), ["tk", "tk2"]).select("node", "text"), "texts")

    fits = F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def against(members, pivots):
        one = pivots.select("key", F.col("node").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"), F.col("comp").alias("comp_a"))
        two = members.select("key", F.col("node").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"), F.col("comp").alias("comp_b"))
        return _likely(two.join(one, "key").filter(F.col("comp_a") != F.col("comp_b")).filter(fits).select("a", "b", "n_a", "n_b", "sig_a", "sig_b"), percent, share)

    alone = members.withColumn("comp", F.col("node"))
    edges = stored(_verified(against(alone, alone.filter("node = pivot")), texts, width, percent), "edges")
    labels = connected(edges)
    members = members.drop("pivot")
    for step in range(2):
        left = _open(members, labels)
        if left.isEmpty():
            break
        if step == 0:
            pairs = against(left, left.join(stored(_centres(left), "centres"), ["key", "node"]))
        else:
            pairs = _pairs_left(left, percent, share)
        more = stored(_verified(pairs, texts, width, percent), "edges")
        if not more.isEmpty():
            edges = edges.unionAll(more)
            labels = connected(edges)
    found = classes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = found.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_class = stored(found.join(lowest, "comp").select("class", "component_id"), "membership")
    linked = rows.filter("class is not null").select("doc_id", "n_shingles", "class", "tk", "tk2").join(of_class, "class")
    empty = rows.filter("class is null").select("doc_id", "n_shingles", "class", "tk", "tk2", F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), "tk", "tk2",
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """df with one document of each group, that of the smallest id; of rows that tie there, one stays.

    Texts without words are no group and all stay. Only rows of groups of several rows are shuffled whole.
    """
    found = stored(near_duplicates(df, id_col, text_col, width, percent), "near")
    groups = found.filter("n_shingles > 0").groupBy("component_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "tk", "tk2")).alias("best"))
    groups = stored(groups.filter("n > 1"), "groups")
    several = found.filter("n_shingles > 0").alias("f").join(groups.alias("g"), F.expr("f.component_id <=> g.component_id")).select(
        "f.doc_id", "f.tk", "f.tk2", F.expr("f.doc_id <=> g.best.doc_id and f.tk = g.best.tk and f.tk2 = g.best.tk2").alias("stays"),
    )
    several = stored(several.distinct(), "several")
    tk, tk2, key, s_id, s_tk, s_tk2, s_stays = fresh(df.columns, "tk", "tk2", "key_id", "s_id", "s_tk", "s_tk2", "stays")
    hashed = df.withColumn(tk, F.xxhash64(text_col)).withColumn(tk2, F.hash(text_col)).withColumn(key, F.col(id_col).cast("long"))
    flag = possibly_in(several.select("tk"), "tk")(F.col(tk))
    told = several.toDF(*[s_id, s_tk, s_tk2, s_stays])
    joined = hashed.filter(flag).join(told, F.col(tk).eqNullSafe(F.col(s_tk)) & F.col(tk2).eqNullSafe(F.col(s_tk2)) & F.col(key).eqNullSafe(F.col(s_id)), "left")
    winners = joined.filter(F.col(s_stays)).dropDuplicates([key, tk, tk2])
    return hashed.filter(~flag).select(*df.columns).unionByName(joined.filter(F.col(s_stays).isNull()).select(*df.columns)).unionByName(winners.select(*df.columns))
