"""Suffix automaton against all substrings; windows, short items, shards and cutting against brute force."""

import hashlib
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from assaybook.llm import decontaminate
from assaybook.llm.decontaminate import Automaton

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
word_list = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
letters = st.lists(st.integers(0, 2), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(letters, max_size=4), letters, st.integers(1, 4))
def test_automaton(items, text, window):
    auto = decontaminate.Automaton([(str(k), x) for k, x in enumerate(items)], window)
    inside = {tuple(x[a:z]) for x in items for a in range(len(x)) for z in range(a + 1, len(x) + 1)}
    for i, (_, length) in enumerate(auto.walk(text)):
        assert length == max((n for n in range(i + 2) if tuple(text[i + 1 - n : i + 1]) in inside), default=0)
    found = Counter((a, z, tuple(sorted(o))) for a, z, o in auto.matches(text))
    want = Counter()
    for a in range(len(text)):
        for n in {min(window, len(x)) for x in items if x}:
            if a + n <= len(text):
                owners = sorted({str(k) for k, x in enumerate(items) if x and min(window, len(x)) == n and any(x[b : b + n] == text[a : a + n] for b in range(len(x) - n + 1))})
                if owners:
                    want[a, a + n, tuple(owners)] += 1
    assert found == want


ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Alpha, beta!"), (3, "solo"), (4, None), (5, " .. "), (None, "quiet item here"), (10, "alpha beta"), (6, "one two three four five six seven eight nine ten other")]
DOCS = [
    (1, None), (2, ""), (3, "x ONE two, three four five six seven eight nine ten y"), (4, "one two three four five six seven eight nine"), (5, "solo"), (6, "é solo alpha beta é"), (7, "quiet item here " + "word " * 20_000),
    (8, "one two three four five six seven eight nine ten " * 500), (9, "two three four five six seven eight nine ten eleven solo."), (9, "beta alpha"), (9, "beta alpha"), (None, "alpha-beta"),
]


def brute(text):
    words = word_list(text)
    hit, items = set(), set()
    for name, item in ITEMS:
        x = word_list(item)
        n = min(10, len(x))
        for b in range(len(x) - n + 1 if n else 0):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == x[b : b + n]:
                    hit |= set(range(a, a + n))
                    items |= {str(name)} - {"None"}
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def test_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as cleaned", "2 as coverage").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = Counter((i, *brute(t)) for i, t in DOCS)
    for shard in (100_000, 5):
        got = decontaminate.contamination(docs, bench, shard_words=shard).collect()
        assert Counter(tuple(r) for r in got) == want
    kept = decontaminate.remove_contamination(docs, bench, max_coverage=0.85, shard_words=5)
    assert kept.columns == docs.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    assert texts[1, None] == texts[2, ""] == texts[6, "é   é"] == 1 and texts[9, "beta alpha"] == 2 and texts[3, "x   y"] == 1
    assert {i for i, _ in texts} == {1, 2, 3, 4, 6, 7, 9}
    none = decontaminate.contamination(docs, bench.limit(0))
    assert none.filter("contaminated or n_items > 0").count() == 0 and none.count() == len(DOCS)
    assert decontaminate.remove_contamination(docs.limit(0), bench).count() == 0


def test_equal_words_take_time_in_proportion():
    item = [1] * 100_000
    start = time.perf_counter()
    auto = Automaton([("x", item), ("y", [1, 2] * 50_000)], 10)
    got = sum(1 for _ in auto.matches([1] * 100_000))
    assert got == 99_991 and time.perf_counter() - start < 20


def test_an_automaton_is_built_once_for_many_batches(spark, monkeypatch):
    """More shards than a task keeps: documents go through them together, not batch by batch."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(3000)}"
    items = [(i, " ".join(word() for _ in range(40))) for i in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    shards = decontaminate._shards(bench, "item_id", "text", 10, 1000)
    assert len(shards) == 8
    built = []
    monkeypatch.setattr(decontaminate, "Automaton", lambda *a: built.append(1) or Automaton(*a))
    texts = [" ".join([word(), items[int(rng.integers(200))][1], word()]) for _ in range(600)]
    batches = [pa.record_batch({"text": texts[i : i + 30]}) for i in range(0, 600, 30)]
    got = list(decontaminate._scanned(iter(batches), "text", shards, 10))
    assert len(got) == 20 and len(built) <= 8
    assert all((np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first]) >= 40).all() for _, w, hit, _ in got)
    assert all(len(found) == 30 for *_, found in got)
    decontaminate._load.cache_clear()
