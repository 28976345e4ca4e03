"""The interval index join and chaining by stretches: equal to the plain forms, also for a key with a third of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loadgrid.operators import intervals
from tests.conftest import rows

T0 = dt.datetime(2025, 1, 1)


def _data(rng, hot_facts=3000, hot_intervals=1000):
    span = 30 * 86400
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(-86400, span + 86400))
    facts = [("hot", i, at()) for i in range(hot_facts)] + [(f"k{i % 200}", 10_000 + i, at()) for i in range(2 * hot_facts)] + [(None, 1, T0), ("k1", 2, None), ("k0", 3, T0)]
    cuts = sorted({rng.randrange(span) for _ in range(hot_intervals)})
    iv = [("hot", T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b), i) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for i in range(200):
        s = T0 + dt.timedelta(seconds=rng.randrange(span))
        iv.append((f"k{i}", s, rng.choice([dt.datetime(9999, 12, 31), s, s + dt.timedelta(days=rng.randrange(20))]), -i))
    iv += [(None, T0, T0 + dt.timedelta(days=1), 1), ("k0", None, T0, 2), ("k0", T0, None, 3), ("k0", T0, T0, 4), ("k0", dt.datetime(1900, 1, 1), dt.datetime(1900, 2, 1), 5)]
    return facts, iv


@pytest.fixture(scope="module")
def frames(spark):
    facts, iv = _data(random.Random(1))
    return spark.createDataFrame(facts, "k string, id int, at timestamp_ntz"), spark.createDataFrame(iv, "key string, start timestamp_ntz, stop timestamp_ntz, n int")


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("closed", [False, True])
def test_index_equals_the_plain_join(frames, how, closed):
    f, iv = frames
    args = (f, iv, [("k", "key")], "at", "start", "stop")
    want = rows(intervals.interval_join(*args, closed=closed, how=how), "id", "k", "at", "start", "stop", "n")
    assert rows(intervals.interval_index_join(*args, closed=closed, how=how), "id", "k", "at", "start", "stop", "n") == want and len(want) > 3000
    for width in (1800, 10 ** 7):
        assert rows(intervals.interval_index_join(*args, closed=closed, how=how, width=width), "id", "k", "at", "start", "stop", "n") == want
    bounded = intervals.interval_index_join(*args, closed=closed, how=how, bounds=(T0 - dt.timedelta(days=2), T0 + dt.timedelta(days=33)))
    assert rows(bounded, "id", "k", "at", "start", "stop", "n") == want


def test_dates_and_closed_edges(spark):
    d = lambda n: dt.date(2025, 3, n)
    f = spark.createDataFrame([("a", d(n)) for n in range(1, 12)], "k string, day date")
    iv = spark.createDataFrame([("a", d(2), d(5)), ("a", d(5), d(9)), ("a", d(9), d(9))], "key string, start date, stop date")
    for closed in (False, True):
        args = (f, iv, [("k", "key")], F.col("day"), "start", "stop")
        assert rows(intervals.interval_index_join(*args, closed=closed, width=86400)) == rows(intervals.interval_join(*args, closed=closed))


def test_hot_key_spreads(spark):
    """One key with a third of all facts and 10,000 intervals: its facts and pieces lie in many bins, and pairs to compare stay few."""
    facts, iv = _data(random.Random(2), hot_facts=12_000, hot_intervals=10_000)
    f, iv = spark.createDataFrame(facts, "k string, id int, at timestamp_ntz"), spark.createDataFrame(iv, "key string, start timestamp_ntz, stop timestamp_ntz, n int")
    seen = {}
    joined = intervals.interval_index_join(f, iv, [("k", "key")], "at", "start", "stop")
    width = intervals.index_bin_width(iv.where("stop < '2026-01-01' and start >= '2025-01-01'").select((F.unix_seconds(F.col("stop").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))).alias("len")),
                                      32 * 86400, 32)
    b = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    for name, df, key, at in (("facts", f, "k", "at"), ("intervals", iv.where("key = 'hot'"), "key", "start")):
        seen[name] = [r["count"] for r in df.where(F.col(at).isNotNull()).groupBy(key, b(at).alias("b")).count().collect()]
    # No task can get more than a (key, bin): a small part of the key's rows.
    assert max(seen["facts"]) < 0.02 * 12_000 and max(seen["intervals"]) < 0.02 * 10_000
    assert joined.where("k = 'hot'").count() == intervals.interval_join(f, iv, [("k", "key")], "at", "start", "stop").where("k = 'hot'").count()
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__fbin" in plan and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()


def test_empty_sides(spark):
    f, iv = spark.createDataFrame([], "k string, at timestamp_ntz"), spark.createDataFrame([], "key string, start timestamp_ntz, stop timestamp_ntz")
    one = spark.createDataFrame([("a", T0)], "k string, at timestamp_ntz")
    assert intervals.interval_index_join(f, iv, [("k", "key")], "at", "start", "stop").count() == 0
    assert intervals.interval_index_join(one, iv, [("k", "key")], "at", "start", "stop", how="left").count() == 1
    with pytest.raises(ValueError, match="how"):
        intervals.interval_index_join(one, iv, [("k", "key")], "at", "start", "stop", how="full")


def test_chains_by_stretches_equal_the_windows(spark):
    rng = random.Random(3)
    day = lambda: None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(500))
    data = [(rng.choice([None, "hot", "hot", "p1", "p2"]), f"m{rng.randrange(30)}", rng.choice(["A", "B", None]), float(rng.randrange(3)), day(), day(), day()) for _ in range(900)]
    df = spark.createDataFrame(data, "prem_num string, ami_dvc_name string, fpl_mtr_num string, kwh_csnt double, mtr_set_date date, efct_strt_date date, efct_end_date date")
    want = rows(intervals.chain_meter_intervals(df))
    for spread in ("month", "year"):
        assert rows(intervals.chain_meter_intervals(df, spread=spread)) == want


def test_row_numbers_keep_null_keys(spark):
    df = spark.createDataFrame([(None, dt.date(2025, 1, d)) for d in (1, 2, 9)] + [("a", dt.date(2025, 1, 5))], "k string, d date")
    got = intervals.bucketed_row_number(df, ["k"], [F.col("d")], "d", "n")
    assert rows(got, "k", "n") == [(None, 1), (None, 2), (None, 3), ("a", 1)]
