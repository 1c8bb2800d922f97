"""Exact, near and passage deduplication against brute force; nulls, ties, clashing names, hot groups."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from assaybook.llm import bloom, exact_dedup, minhash, substrings
from assaybook.llm.bytewords import ALNUM, SPACED, shingles, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
low = lambda t: (t or "").translate(LOWER)

ODD = ["", None, "a", "A  b", "É é", "x\x0by\x1cz", "word " * 3000, "über x\n\n"]


def test_words_and_shingles():
    for kind, pattern in ((SPACED, r"[^\x20\x09-\x0D]+"), (ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        w = words(pa.array(ODD), kind)
        for i, t in enumerate(ODD):
            spans = range(w.first[i], w.first[i + 1])
            assert [w.data[w.starts[k] : w.starts[k] + w.lens[k]].tobytes().decode() for k in spans] == re.findall(pattern, low(t))
        flat, borders = shingles(w, 4)
        for i, t in enumerate(ODD):
            found = re.findall(pattern, low(t))
            want = {tuple(found[j : j + 4]) for j in range(max(1, len(found) - 3))} if found else set()
            assert borders[i + 1] - borders[i] == len(want)
    assert len(set(words(pa.array(["ab", "ba", "a b", "aab", "abb", "b a"]), SPACED).hashes.tolist())) == 6


@pytest.mark.parametrize("bits", [1 << 10, 1 << 16])
def test_bitmaps_have_no_false_negatives(spark, bits, monkeypatch):
    monkeypatch.setattr(bloom, "MAX_BITS", bits)
    df = spark.range(6000).selectExpr("xxhash64(id % 4000) as h", "id").repartition(7)
    maybe = {r.id for r in df.filter(bloom.possibly_repeated(df, "h")).select("id").collect()}
    assert maybe >= {i for i in range(6000) if i < 2000 or i >= 4000}
    keys = df.filter("id < 50")
    assert {r.id for r in df.filter(bloom.possibly_in(keys, "h")(df["h"])).collect()} >= set(range(50)) | set(range(4000, 4050))


def test_exact(spark):
    rows = [(1, "Ab", 1), (2, "aB", 2), (3, "É", 3), (4, "é", 4), (5, None, 5), (6, "", 6), (None, "aB", 7), (2, "AB", 8), (None, "q", 9), (None, "q", 9)]
    rows += [(100 + i, "hot", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_sha int").repartition(5)
    got = exact_dedup.duplicate_groups(df).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(low(t), []).append(i)
    best = {t: max((i for i in g if i is not None), default=None) for t, g in groups.items()}
    want = Counter((i, best[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t, _ in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sorted(str(r.doc_id) for r in got if r.kept) == sorted(str(i) for i in best.values())
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and Counter((r.doc_id, low(r.text)) for r in kept.collect()) == Counter((i, t) for t, i in best.items())
    assert exact_dedup.drop_duplicates(df.limit(0)).count() == exact_dedup.duplicate_groups(df.limit(0)).count() == 0


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.5, 0.8):
        errors = []
        for _ in range(30):
            base = rng.integers(0, 2**63, 600, dtype=np.uint64)
            common = int(600 * 2 * share / (1 + share))
            other = np.concatenate([base[:common], rng.integers(0, 2**63, 600 - common, dtype=np.uint64)])
            sig = minhash.signatures(np.concatenate([base, other]), np.array([0, 600, 1200]))
            errors.append((sig[0] == sig[1]).mean() - common / (1200 - common))
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.035


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_groups_of_edited_copies_and_chains(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choice(vocabulary, 150).tolist()
    rows = []
    for i in range(120):  # copies of one text, some edited too much to link with it
        copy = list(base)
        for k in rng.choice(150, int(rng.integers(1, 12)), replace=False):
            copy[k] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(copy)))
    for i in range(40):  # a chain: each links with its neighbours only
        rows.append((2000 + i, " ".join(f"c{k}" for k in range(8 * i, 8 * i + 100))))
    rows += [(3000 + i, " ".join(rng.choice(vocabulary, 60))) for i in range(60)] + [(1, "A b"), (2, "a  B"), (3, "a b c"), (4, None), (5, " \n"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute_components(rows, 4)
    assert len({c for i, (_, c) in want.items() if 1000 <= i < 1200}) > 3 and len({c for i, (_, c) in want.items() if 2000 <= i < 2100}) == 1
    got = minhash.near_duplicates(df, width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_defined_cases(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(9, long, 1, 1), (9, long, 1, 1), (8, long + " end", 2, 2), (None, long, 3, 3), (4, None, 4, 4), (None, None, 5, 5), (7, "own words in here only", 6, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tk int, node int")
    got = minhash.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in got) == Counter([(9, 8, False), (9, 8, False), (8, 8, True), (None, 8, False), (4, 4, True), (None, None, True), (7, 7, True)])
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and Counter((r.doc_id, r.tk) for r in kept.collect()) == Counter([(8, 2), (4, 4), (None, 5), (7, 6)])
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0


PASSAGE = "The river rose over night and took the bridge. Nobody had seen it coming at all! People stood on the bank for hours. Then the rain began to fall again, harder than before."


def test_passages(spark):
    own = lambda k: f"Only document {k} says this about itself and nothing else here. It has {k} further things to tell the reader of it. All of them are {k} and stay as they are."
    rows = [(1, own(1) + "\n" + PASSAGE + "\n" + own(11)), (2, own(2) + "\n" + PASSAGE.upper() + "\n" + own(12)), (3, PASSAGE), (4, own(4)), (5, None), (6, ""), (7, "Yes. No. Yes."), (8, "Yes. No. Yes."),
            (9, own(9) + "\n" + own(9)), (10, own(10)), (10, own(10)), (None, own(4))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as tk", "2 as n_removed").repartition(4)
    out = substrings.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "tk", "n_removed", "_n_removed", "words_removed"]
    got = [(r.doc_id, r.text, r["_n_removed"]) for r in out.collect()]
    by_id = {i: t for i, t, _ in got}
    assert by_id[1] == rows[0][1] and by_id[3] == "" and by_id[4] == own(4) and by_id[5] is None and by_id[7] == by_id[8] == "Yes. No. Yes."
    assert by_id[2] == own(2) + "\n" + own(12) and by_id[9].strip() == own(9) and by_id[None] == ""
    assert [t for i, t, _ in got if i == 10] == [own(10)] * 2
    assert sum(n for i, _, n in got if i == 2) == 4
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_passages_without_punctuation_and_runs_by_definition(spark):
    rng = np.random.default_rng(2)
    passage = " ".join(f"p{i}" for i in rng.integers(0, 900, 70))
    rows = [(i, " ".join(f"d{x}" for x in rng.integers(0, 9000, 40)) + " " + passage + " " + " ".join(f"e{x}" for x in rng.integers(0, 9000, 40))) for i in range(4)]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].words_removed == 0
    for i in (1, 2, 3):
        left = Counter(re.findall(r"p\d+", got[i].text)).total()
        assert left <= 35 and len(re.findall(r"[de]\d+", got[i].text)) == 80, left
    w = words(pa.array([PASSAGE, "", None, "One two. " * 9]), ALNUM)
    at = substrings.sentences(w)
    h, i, end, first = substrings.runs(w)
    assert first.tolist()[0] == 0 and (np.diff(first) >= 0).all() and len(h) == first[-1]
    for a, z in zip(i, end, strict=True):
        assert z - a >= substrings.RUN and at[z] - at[a] >= substrings.MIN_WORDS
        assert z - a == substrings.RUN or at[z - 1] - at[a] < substrings.MIN_WORDS


def _covered(column, apart):
    """Of each row but the first: how many words are under a run that the first row has too."""
    w = words(pa.array(column), ALNUM, **({"apart": True} if apart else {}))
    at = substrings.sentences(w)
    h, i, end, first = getattr(substrings, "all_runs", substrings.runs)(w)
    out = []
    for r in range(1, len(column)):
        part = slice(first[r], first[r + 1])
        hit = np.isin(h[part], h[: first[1]])
        out.append(len({k for a, z in zip(i[part][hit], end[part][hit], strict=True) for k in range(at[a], at[z])}))
    return out


def test_no_repeated_passage_of_51_to_60_words_is_missed():
    rng = np.random.default_rng(8)
    around = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 10**6, n))
    missed = 0
    for seed in range(300):
        tokens = [f"p{x}" for x in np.random.default_rng(seed).integers(0, 3000, 51 + seed % 10)]
        if seed % 3 == 1:  # three or four unfinished sentences
            step = 17 if seed % 2 else 13
            tokens = [t + "." if k % step == step - 1 and k < len(tokens) - 1 else t for k, t in enumerate(tokens)]
        passage = " ".join(tokens)
        texts = [f"{around(rng.integers(0, 40))} {passage} {around(rng.integers(0, 40))}" for _ in range(4)]
        missed += sum(n < 16 for n in _covered(texts, False))
    assert missed == 0


CHINESE = "\u6cb3\u6c34\u4e00\u591c\u4e4b\u95f4\u6f32\u4e86\u8d77\u6765\uff0c\u51b2\u8d70\u4e86\u90a3\u5ea7\u8001\u6865\u3002\u6ca1\u6709\u4eba\u60f3\u5230\u4f1a\u53d1\u751f\u8fd9\u6837\u7684\u4e8b\u60c5\uff01\u4eba\u4eec\u5728\u5cb8\u8fb9\u7ad9\u4e86\u51e0\u4e2a\u5c0f\u65f6\u3002\u7136\u540e\u96e8\u53c8\u4e0b\u4e86\u8d77\u6765\uff0c\u6bd4\u4ee5\u524d\u66f4\u5927\u3002"


def test_passages_in_scripts_without_spaces(spark):
    rng = np.random.default_rng(4)
    other = lambda lo, hi: "".join(map(chr, rng.integers(lo, hi, 30)))
    thai = other(0x0E01, 0x0E2E) + other(0x0E01, 0x0E2E) + other(0x0E01, 0x0E2E) + other(0x0E01, 0x0E2E)
    rows = [(i, other(0x5000, 0x9000) + "\u3002" + CHINESE + other(0x5000, 0x9000)) for i in range(3)]
    rows += [(10 + i, other(0x0E01, 0x0E2E) + thai + other(0x0E01, 0x0E2E)) for i in range(2)] + [(20, "ab\u6cb3cd\uff0cef")]
    got = {r.doc_id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[10].text == rows[3][1] and got[20].text == rows[5][1]
    for i in (1, 2):
        assert got[i].text == rows[i][1].replace(CHINESE, "") and got[i].n_removed == 4
    assert got[11].words_removed >= 80 and len(got[11].text) >= 60
    w = words(pa.array([rows[5][1]]), ALNUM, apart=True)
    assert [w.data[a : a + n].tobytes().decode() for a, n in zip(w.starts, w.lens, strict=True)] == ["ab", "\u6cb3", "cd", "ef"] and w.quarters.tolist() == [4, 2, 4, 4]


def test_pairs_meet_whatever_other_bands_low_bytes_say(spark):
    """The pairs of all bands are those that share a real bucket, also where low bytes agree in an earlier band."""
    rng = np.random.default_rng(3)
    members, want = [], set()
    for p in range(60):
        one = rng.integers(0, 2**32, minhash.COORDINATES, dtype=np.uint32)
        two = np.where(rng.random(minhash.COORDINATES) < 0.8, one, rng.integers(0, 2**32, minhash.COORDINATES, dtype=np.uint32)).astype(np.uint32)
        if p % 2:  # the first band agrees in low bytes only
            two[: minhash.BAND] = one[: minhash.BAND] ^ np.uint32(0xABCD00)
        keys = minhash.bands(np.stack([one, two]))
        for band in np.flatnonzero(keys[0] == keys[1]).tolist():
            want.add((2 * p, 2 * p + 1))
            for node, sig in ((2 * p, one), (2 * p + 1, two)):
                members.append((int(keys[0][band]), band, node, node, 100, bytearray(sig.astype(np.uint8).tobytes() + b"\xff" * minhash.CELLS), 2))
    df = spark.createDataFrame(members, "key long, band int, node long, comp long, n_shingles long, sig binary, n long")
    got = [(r.a, r.b) for r in minhash._pairs_left(df, 80, 0.7).collect()]
    assert len(want) > 50 and sorted(got) == sorted(want)
