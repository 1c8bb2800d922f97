"""Token files: ids against the plain tokenizer, files read back whole and at random places."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assaybook.llm import tokenfiles
from assaybook.llm.tokenfiles import TokenFiles, WordCoder, read_token_files, token_digests, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
SMALL = WordCoder(PATH, slots=6, max_pieces=300)  # loses pieces all the time
ODD = ["", " ", "a", "A's don't 'tis ,'s x''y", "H̱ ẖ İİ", "≠ ≮ a̸", "12 3a4!?b", "1⃣ Ⅷ", "x\x1cy \x1f", "<|endoftext|>", "a b c\u0085", "世界。ok", "\U0001f642 ok"]


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def same(texts, coder=SMALL):
    ids, borders = coder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[borders[i] : borders[i + 1]].tolist() == plain(t), repr(t)


def test_ids_of_odd_texts():
    same([*ODD, None, "Word " * 3000])
    same([])
    same([""])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\tab'sStTdl9!,.é̸̱HI\x1f世　ß"), max_size=40), max_size=6))
def test_ids_of_any_texts(texts):
    same(texts)


def test_long_texts_are_cut_in_parts(monkeypatch):
    monkeypatch.setattr(tokenfiles, "PART_BYTES", 50)
    rng = np.random.default_rng(3)
    same(["".join(rng.choice(list("ab1,' é"), n)) for n in (0, 49, 50, 51, 400, 3000)] + ["x" * 20_000, "", "é" * 300], WordCoder(PATH))


def expected(rows):
    """(start, tokens, crc) of rows in order, and all ids."""
    out, flat = [], []
    for text in rows:
        ids = [*plain(text), 1]
        out.append((len(flat), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        flat += ids
    return out, flat


def test_documents_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(-5, None), (10_000_001, "x y " * 30_000), (10_000_002, "")], "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    manifest = write_token_files(docs, PATH, shards=5)
    rows = docs.orderBy("doc_id").collect()
    want, flat = expected([r.text for r in rows])
    got = token_digests(read_token_files(spark, manifest)).orderBy("doc_id").collect()
    assert [(r.doc_id, (r.start, r.n_tokens, r.ids_crc32)) for r in got] == [(r.doc_id, w) for r, w in zip(rows, want, strict=True)]
    files = TokenFiles(manifest.collect())
    assert 1 < len(files.rows) <= 5 and len(files) == len(rows)
    assert files.stretch(0, len(flat)).tolist() == flat
    rng = np.random.default_rng(1)
    for a, n in zip(rng.integers(0, len(flat), 50).tolist(), rng.integers(1, 5000, 50).tolist(), strict=True):
        assert files.stretch(a, n).tolist() == flat[a : a + n]
    for k in (0, 1, len(rows) // 2, len(rows) - 1):
        assert files.document(k).tolist() == flat[want[k][0] : want[k][0] + want[k][1]]


def test_odd_rows(spark):
    """Null and repeated ids, rows told apart by nothing, clashing columns."""
    rows = [(None, "b", 1, "p"), (None, None, 2, "q"), (7, "x y", 3, "r"), (7, "z", 4, "s"), (3, "", 5, "t")] + [(9, "same text", k, "u") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, h string").repartition(4)
    manifest = write_token_files(df, PATH, shards=6)
    got = sorted(token_digests(read_token_files(spark, manifest)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 3, 7, 7] + [9] * 300
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1].tolist()]
    assert sorted(r.n_tokens for r in got[:2]) == [1, 2] and {r.n_tokens for r in got[3:5]} == {2, 3}
    assert manifest.agg(F.sum("docs")).first()[0] == 305
    assert manifest.filter("docs > 150").count() == 0  # one id's 300 rows lie in several shards


def test_string_ids_and_no_rows(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "y z")], "k string, t string")
    got = read_token_files(spark, write_token_files(df, PATH, id_col="k", text_col="t", end_id=70_000), "string").orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [("a", 0, 3), ("b", 3, 2)]
    assert np.frombuffer(got[1].ids, dtype="<u4").tolist() == [*plain("x"), 70_000]  # too large for two bytes
    none = write_token_files(df.limit(0), PATH, id_col="k", text_col="t")
    assert none.count() == 0 and read_token_files(spark, none, "string").count() == 0
    assert len(TokenFiles(none.collect())) == 0 and not len(TokenFiles(none.collect()).stretch(0, 9))
