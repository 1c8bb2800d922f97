"""Packing: exact round trips against the plain tokenizer, limits, padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assaybook.llm.packing import Limits, Packer, pack_documents, pack_examples
from assaybook.llm.tokens import Tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
CODER = Tokens(PATH, max_pieces=500)

ODD = ["", " ", "\n", "\n\n x", "a  b", "a \n b\n", "it's 'twas don't", " \t\tx ", "été nu", "a b", "x\x1cy z", "日本 語　x", "<|endoftext|> a", "a\n\xa0\xa099 9", " \xa0b c\n\u3000d", "x \x1cy", "12 345a!?", "a\u0085b", "🙂 ok"]


def same(texts):
    ids, borders = CODER.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == PLAIN.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_ids_of_odd_texts():
    same(ODD + [None, "word " * 3000])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab'sé9! \x1f世"), max_size=40), max_size=6))
def test_ids_of_any_texts(texts):
    same(texts)


def whole(rows, docs, end_id=1, limits=Limits(segments=2048)):
    """Every id in exactly one piece, digests right, sequences gapless and within limits."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, _ in docs}
    for i, text in docs:
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, end_id], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        total += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding / total


def test_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000_001, None), (10_000_002, ""), (10_000_003, "x " * 30_000)], "doc_id long, text string")
    df = df.unionByName(extra)
    rows = pack_documents(df, PATH).collect()
    assert whole(rows, [(r.doc_id, r.text) for r in df.collect()]) == 0
    few = Limits(256, 3, 256)
    kept = pack_documents(df.limit(40), PATH, limits=few, keep_ids=True).collect()
    assert whole(kept, [(r.doc_id, r.text) for r in df.limit(40).collect()], limits=few) < 0.3
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in kept)


@pytest.mark.parametrize("kind", ["tiny", "short", "mixed"])
def test_short_texts_leave_no_padding(spark, kind):
    rng = np.random.default_rng(7)
    texts = {"tiny": lambda: None, "short": lambda: "a b c d", "mixed": lambda: "a b " * int(rng.choice([0, 1, 2, 3, 400, 3000], p=[0.4, 0.3, 0.2, 0.08, 0.01, 0.01]))}[kind]
    docs = [(i, texts()) for i in range(6000)]
    rows = pack_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), PATH).collect()
    assert whole(rows, docs) < 0.01


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (3, None, 3)], "doc_id long, text string, length long")
    rows = pack_documents(df, PATH).collect()
    assert sorted((r.doc_id is None, r.doc_tokens) for r in rows if r.start == 0) == [(False, 1), (True, 3), (True, 3)]
    assert pack_documents(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_whole_examples_within_all_limits(seed):
    rng = np.random.default_rng(seed)
    limits, items = Limits(1000, 8, 600), [(i, int(t), int(min(t, l))) for i, (t, l) in enumerate(zip(rng.integers(0, 500, 5000), rng.integers(0, 300, 5000), strict=True))]
    packer = Packer(limits, cut=False)
    got = [x for i, t, l in items for x in packer.add((i, t, l), t, l)] + list(packer.finish())
    assert sorted(k[0] for k, *_ in got) == list(range(5000))
    sums = defaultdict(lambda: np.zeros(3))
    for (_, t, l), _, n, sequence, _ in got:
        assert n == t
        sums[sequence] += (t, 1, l)
    assert all((s <= (1000, 8, 600)).all() for s in sums.values())
    total = np.array([(t, 1, l) for _, t, l in items]).sum(axis=0) / (1000, 8, 600)
    assert len(sums) <= 1.04 * total.max() + 1


def test_example_frame(spark):
    df = spark.createDataFrame([("a", 10, 4), ("b", None, None), ("c", 3000, 1), ("d", 5, -2)], "id string, tokens int, loss int")
    rows = {r.id: r for r in pack_examples(df, "id", "tokens", "loss").collect()}
    assert {k: r.fits for k, r in rows.items()} == {"a": True, "b": True, "c": False, "d": True}
    assert sum(r.sequence_id == rows["c"].sequence_id for r in rows.values()) == 1
