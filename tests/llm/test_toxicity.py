"""Ordinal regression: recovered weights, held-out labels, defined cases."""

import numpy as np
from pyspark.sql import functions as F

from assaybook.llm import toxicity


def test_likelihood_and_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    grade = np.searchsorted([-1, 0.5, 2], x @ [1.5, -1, 0, 0.5] + rng.logistic(size=3000) * 0.5)
    model = toxicity.train(x, grade, np.ones(3000), np.arange(4, dtype=np.uint64), decay=1e-5)
    assert (np.diff(model.thresholds) > 0).all()
    assert np.allclose(model.weights / model.weights[0], [1, -1 / 1.5, 0, 0.5 / 1.5], atol=0.1)
    p = model.probabilities(x @ model.weights)
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert np.corrcoef(p @ np.arange(4), grade)[0, 1] > 0.75


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = toxicity.fit(docs, labels.filter(~held))
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    told = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels.filter(held), "doc_id")
    r = told.agg(F.sum(F.expr("int(said and toxic = 1)")).alias("tp"), F.sum(F.expr("int(said and toxic = 0)")).alias("fp"), F.sum(F.expr("int(not said and toxic = 1)")).alias("fn")).first()
    assert r.tp / (r.tp + r.fp) > 0.9 and r.tp / (r.tp + r.fn) > 0.85, r
    assert told.filter("severity < 0 or severity > 3 or said <> (p_toxic >= 0.5)").count() == 0


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "you idiot fool"), (2, None), (3, ""), (None, "fine words"), (4, "fine words here"), (4, "fine words here"), (5, "idiot " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, None), (None, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    assert toxicity.fit(docs, labels.filter("toxic = 1")) is None
    assert toxicity.score(docs, None).filter("severity = 0 and not toxic").count() == 7
    many = docs.filter("doc_id in (1, 4)").dropDuplicates().select(F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"), "doc_id", "text")
    many = many.select((F.col("k") * 10 + F.col("doc_id")).alias("doc_id"), "text")
    model = toxicity.fit(many, many.select("doc_id", (F.col("doc_id") % 10 == 1).cast("int").alias("toxic")))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert got[1].toxic and got[5].toxic and not got[4].toxic and got[2].severity == got[3].severity
    graded = many.select("doc_id", (F.col("doc_id") % 10 == 1).cast("int").alias("toxic"), F.lit(2).alias("g"))
    assert len(toxicity.fit(many, graded, grade_col="g").thresholds) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_repeated_ids_give_one_model(spark):
    """Of several texts of an id one is taken by a rule, so that the order of rows doesn't matter."""
    rows = [(i, text) for i in range(60) for text in ((f"you idiot fool {i}", f"fine words {i}") if i % 2 else (f"good day {i}", f"fine words here {i}"))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    models = [toxicity.fit(spark.createDataFrame(x, "doc_id long, text string").repartition(k), labels) for x, k in ((rows, 1), (rows[::-1], 5))]
    assert all((models[0].vocabulary == m.vocabulary).all() and np.array_equal(models[0].weights, m.weights) for m in models)
