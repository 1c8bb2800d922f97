"""Windows opened by the first call: against a plain loop over each client's calls."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from assaybook.streaming.rates import first_call_windows, rate_limit_audit

START = dt.datetime(2024, 1, 1)
SCHEMA = "client long, at timestamp_ntz, id long"


def plainly(rows, seconds):
    """{id: window start} and the order of the calls in their windows."""
    out, place = {}, {}
    for client in {r[0] for r in rows if r[0] is not None}:
        start = None
        for _, at, i in sorted((r for r in rows if r[0] == client and r[1] is not None), key=lambda r: (r[1], r[2])):
            if start is None or at >= start + dt.timedelta(seconds=seconds):
                start, n = at, 0
            n += 1
            out[i], place[i] = start, n
    return out, place


def calls(rng, gaps, n, clients=3):
    rows, now = [], {c: START + dt.timedelta(microseconds=rng.randrange(10**9)) for c in range(clients)}
    for i in range(n):
        c = rng.choice([0, 0, 0, *range(clients)])
        now[c] += dt.timedelta(microseconds=rng.choice(gaps))
        rows.append((c, now[c], i))
    return rows


@pytest.mark.parametrize(
    ("seed", "gaps"),
    [
        (1, [0, 1, 59_999_999, 60_000_000, 60_000_001]),  # ends of windows hit exactly
        (2, [3_000_000, 20_000_000]),  # long runs without a pause
        (3, [10_000_000, 61_000_000, 200_000_000, 4_000_000_000]),  # pauses of one and of many slots
        (4, [0, 500_000]),
        (5, [31_000_000, 45_000_000, 59_000_000]),
    ],
)
def test_windows(spark, seed, gaps):
    rng = random.Random(seed)
    rows = calls(rng, gaps, 400)
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, START, 9000), (1, None, 9001)], SCHEMA).repartition(5)
    want, place = plainly(rows, 60)
    got = {r.id: r.window_start for r in first_call_windows(df).collect()}
    assert got == want
    for limit in (2,):
        refused = rate_limit_audit(df, limit, windows="first_call")
        assert {(r.id, r.window_start) for r in refused.collect()} == {(i, want[i]) for i in want if place[i] > limit}


def test_hot_client_takes_rounds_by_logarithm(spark, monkeypatch):
    """A client of all calls, one every 0.7 s for six hours: 360 windows without a pause."""
    from assaybook.streaming import rates

    stored = []
    keep = rates._stored
    monkeypatch.setattr(rates, "_stored", lambda df, name: stored.append(name) or keep(df, name))
    rows = [(7, START + dt.timedelta(seconds=0.7 * i), i) for i in range(30_000)]
    got = {r.id: r.window_start for r in first_call_windows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == plainly(rows, 60)[0]
    assert stored.count("call-pointers") <= 11


def test_no_calls_and_one(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert first_call_windows(none).count() == 0 and rate_limit_audit(none, 1).count() == 0
    one = spark.createDataFrame([(1, START, 1), (1, START, 1), (1, START, 2)], SCHEMA)
    assert {r.window_start for r in first_call_windows(one).collect()} == {START}
    assert sorted(r.id for r in rate_limit_audit(one, 1, windows="first_call").collect()) == [2]
    with pytest.raises(ValueError, match="unknown windows"):
        rate_limit_audit(one, 1, windows="no")


def test_other_lengths(spark):
    rng = random.Random(9)
    rows = calls(rng, [5_000_000, 100_000_000], 200)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit(1)).withColumn("t", F.lit("x"))
    for seconds in (1, 7, 3600):
        got = first_call_windows(df, seconds)
        assert got.columns == [*df.columns, "window_start"]
        assert {r.id: r.window_start for r in got.collect()} == plainly(rows, seconds)[0]
