"""Every stage of the pipeline against a brute-force version on its own input."""

import re

import corpus_pipeline as pipeline
from test_packing import whole

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return (text or "").translate(LOWER)


def sets(text):
    w = SPACED.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90_001, None, "en", "s", 0), (90_002, "12 3", None, "s", 4), (90_003, "the word of the day", None, None, 19), (90_003, "the word of the day", None, None, 19)], docs.schema)
    docs = docs.unionByName(odd)
    kept, frames = docs, {}
    for name, stage in pipeline.STAGES:
        before = kept.collect()
        after = stage(spark, kept, sf)
        if name != "pack":
            assert after.columns == docs.columns
            after = spark.createDataFrame(after.collect(), docs.schema)
        frames[name] = (before, after.collect())
        kept = after

    before, after = frames["language"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert gone == {90_001, 90_002} and len(before) - len(after) == 2

    before, after = frames["exact"]
    best = {}
    for r in before:
        best[low(r.text)] = max(best.get(low(r.text), -1), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(best.values())

    before, after = frames["near"]
    shingles = {r.doc_id: sets(r.text) for r in before}
    parent = {i: i for i in shingles}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(shingles)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(shingles[a] & shingles[b])
            if common and 100 * common >= 80 * (len(shingles[a]) + len(shingles[b]) - common):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    assert sorted(r.doc_id for r in after) == [i for i in ids if root(i) == i]

    before, after = frames["clean"]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = WORD.findall(low(r.text))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    want = {}
    for r in before:
        spans = [m.span() for m in WORD.finditer(low(r.text))]
        w = [low(r.text)[a:z] for a, z in spans]
        hit = [False] * len(w)
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit[i : i + n] = [True] * n
        if 2 * sum(hit) > len(w):
            continue
        out, at, i = [], 0, 0
        while i < len(w):
            j = i
            while j < len(w) and hit[j]:
                j += 1
            if j > i:
                out.append(r.text[at : spans[i][0]])
                at = spans[j - 1][1]
            i = j + 1 if j == i else j
        want[r.doc_id] = " ".join([*out, r.text[at:]])
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    assert any(want[r.doc_id] != r.text for r in before if r.doc_id in want)

    before, after = frames["pack"]
    assert whole(after, [(r.doc_id, r.text) for r in before]) == 0


def test_model_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.selectExpr("*", "1 AS n_chars_before", "2 AS cleaned", "'x' AS coverage")
    got = pipeline.clean(spark, wide, sf)
    assert got.columns == wide.columns
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, pipeline.clean(spark, docs, sf).collect()))
    assert pipeline.clean(spark, docs.drop("n_chars"), sf).columns == [c for c in docs.columns if c != "n_chars"]
