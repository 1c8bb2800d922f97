"""Language identification: held-out accuracy, gradients, defined cases."""

import base64
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from assaybook.llm import langid
from assaybook.llm.bytewords import text_bytes


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(docs, only=langid.fold() != 2)
    told = langid.predict(docs.select("doc_id", "text", "lang"), model).withColumn("held", langid.fold() == 2)
    row = told.filter("held and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("share")).first()
    assert row.share > 0.97
    bad = told.filter("score < 0 or score > 1 or lang_pred is null").count()
    assert bad == 0
    r = told.select("doc_id", "held").limit(50).collect()
    assert all(x.held == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in r)


def test_windows_cover_every_byte():
    texts = ["", "A" * 128, None, "b" * 129, "é" * 100]
    data, borders = text_bytes(pa.array(texts))
    w, row, used = langid.windows(data, borders)
    assert row.tolist() == [1, 3, 3, 4, 4] and used.tolist() == [128, 128, 1, 128, 72]
    joined = b"".join(w[i][: used[i]].tobytes() for i in range(len(w)))
    assert joined == ("a" * 128 + "b" * 129 + "é" * 100).encode()


def test_tables_and_training_view_agree():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    model = langid.train(x, np.arange(40) % 3, ["a", "b", "c"], epochs=1)
    h, _ = model.features(x)
    assert np.allclose(model.probabilities(x), langid._softmax(h @ model.out + model.out_bias), atol=1e-4)


def test_defined_cases(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 2), (3, "12 .!", "en", 3), (4, "the cat and the dog", "en", 4), (5, "der hund und die katze", "de", 5),
            (None, "the end", None, 6), (7, "世界 人", None, 7), (7, "世界 人", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(df)
    assert model.languages == ["de", "en"]
    got = langid.predict(df, model)
    assert got.columns == ["doc_id", "text", "lang", "score", "lang_pred", "_score"]
    by_id = {r.doc_id: r for r in got.collect()}
    assert [by_id[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and by_id[1]["_score"] == 0
    assert by_id[7].lang_pred in ("de", "en") and by_id[None].lang_pred in ("de", "en")
    kept = langid.identify(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 5, 7, None}
    assert langid.fit(df.filter("lang is null")) is None
    assert {r.lang_pred for r in langid.predict(df.drop("score"), None).collect()} == {"und"}
    assert {r.doc_id for r in langid.identify(df, None).collect()} == {4, 5, 7, None}
    assert langid.predict(df.limit(0), model).count() == 0


def test_every_language_is_learned(spark):
    """Many labels, the last by name the largest; copies of a few texts; one text alone."""
    rng = np.random.default_rng(2)
    letters = [chr(0x4E00 + i) for i in range(40)]
    rows = [(f"a{i:03d}", f"{i} some words {rng.integers(10**9)}") for i in range(300)]
    rows += [("zh", "".join(rng.choice(letters, 60))) for _ in range(500)] + [("few", f"ein text {i % 3}") for i in range(3000)]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    saved = langid.SAMPLE_ROWS, langid.TOTAL_ROWS, langid.train
    seen = {}
    try:
        langid.SAMPLE_ROWS, langid.TOTAL_ROWS = 200, 9000
        langid.train = lambda x, y, names: seen.update(zip(*[v.tolist() for v in np.unique(np.array(names)[y], return_counts=True)], strict=True)) or names
        assert langid.fit(df) == sorted({x for x, _ in rows})
    finally:
        langid.SAMPLE_ROWS, langid.TOTAL_ROWS, langid.train = saved
    assert len(seen) == 302 and seen["zh"] >= 29 and seen["few"] == 3


def test_threshold_follows_the_number_of_languages(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "123")], "doc_id long, text string")
    for count in (2, 60):
        names = [f"l{i:02d}" for i in range(count)]
        x = np.zeros((count, langid.WINDOW), dtype=np.uint8)
        model = langid.train(x, np.arange(count), names, epochs=0)
        for weight, kept in ((0.0, []), (9.0, [1])):  # all languages alike, or one that is sure
            model.out[:], model.out_bias[:] = 0, 0
            model.out_bias[0] = weight
            assert [r.doc_id for r in langid.identify(df, model).collect()] == kept


def test_noise_has_no_language(spark, sf):
    """Random letters, base64 and a script that was never learned go; every given document, whatever its length, stays."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rng = np.random.default_rng(5)
    noise = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(n)) for n in (60, 400)]
    noise += [base64.b64encode(rng.bytes(n)).decode() for n in (200, 1500)]
    noise += ["".join(chr(0x4E00 + i) for i in rng.integers(0, 3000, n)) for n in (300, 900)]
    odd = spark.createDataFrame([(90_000 + i, t, None, "s", len(t)) for i, t in enumerate([*noise, "The end.", "All rights reserved."])], docs.schema)
    kept = corpus_pipeline.language(spark, docs.unionByName(odd), sf)
    want = [r.doc_id for r in docs.collect()] + [90_000 + len(noise), 90_001 + len(noise)]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
