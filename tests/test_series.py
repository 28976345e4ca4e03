"""Steps of their own, readings off the grid, neighbours by bucket, wall clocks."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadgrid.operators import clocks, intervals, timeseries
from tests.conftest import rows

UTC, LOCAL = dt.timezone.utc, ZoneInfo("America/New_York")
FALL, SPRING = dt.date(2025, 11, 2), dt.date(2025, 3, 9)


def _midnight(day):
    return dt.datetime(day.year, day.month, day.day, tzinfo=LOCAL).astimezone(UTC).replace(tzinfo=None)


def _wall(t):
    return t.replace(tzinfo=UTC).astimezone(LOCAL).replace(tzinfo=None)


def _full(day, minutes):
    t, end = _midnight(day), _midnight(day + dt.timedelta(days=1))
    while t < end:
        yield t
        t += dt.timedelta(minutes=minutes)


def _frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


READS = "prem string, ts timestamp_ntz, value double, spi int"


@pytest.mark.parametrize("day, hours", [(FALL, 25), (SPRING, 23), (dt.date(2025, 6, 1), 24)])
def test_complete_days_of_any_step(spark, day, hours):
    data = [(f"p{m}", t, 1.0, m) for m in (15, 30, 60) for t in _full(day, m)]
    df = _frame(spark, data, READS)
    got = {r.prem: r for r in timeseries.completeness(df, ["prem"], "ts", minutes="spi").collect()}
    for m in (15, 30, 60):
        r = got[f"p{m}"]
        assert (r.expected_intervals, r.interval_count, r.deficit, r.hour_count) == (hours * 60 // m, hours * 60 // m, 0, hours)
    assert rows(timeseries.time_grid(df, ["prem"], "ts", "spi"), "prem", "ts") == sorted((p, t) for p, t, _, _ in data)
    shares = timeseries.interval_shares_from_readings(df.withColumn("f", F.lit("A")), ["prem"], "ts", "f", "spi")
    assert {(r.prem, r.n_intervals, r.goodintvper) for r in shares.collect()} == {(f"p{m}", hours * 60 // m, 100.0) for m in (15, 30, 60)}


def test_step_changes_within_a_day(spark):
    t0, hour = _midnight(FALL), dt.timedelta(hours=1)
    data = [("a", t0 + k * hour, float(k), 60) for k in (0, 1, 3, 5)]                                # hours 2 and 4 are missing
    data += [("a", t0 + 6 * hour + k * dt.timedelta(minutes=15), 10.0 + k, 15) for k in (0, 1, 5)]   # then quarters, three missing
    data += [("a", t0 + 8 * hour, 30.0, 60)]
    df = _frame(spark, data, READS)
    seg = timeseries.step_segments(df, ["prem"], "ts", "spi").orderBy("seg_start").collect()
    assert [(r.spi, r.seg_start, r.seg_stop) for r in seg] == [(60, t0, t0 + 6 * hour), (15, t0 + 6 * hour, t0 + 8 * hour), (60, t0 + 8 * hour, None)]
    out = timeseries.fill_between_readings(df, ["prem"], "ts", "value", "spi").orderBy("ts").collect()
    assert [r.spi for r in out] == [60] * 6 + [15] * 8 + [60] and sum(r.flag == "I" for r in out) == 2 + 5
    assert [r.ts for r in out] == [r.ts for r in timeseries.time_grid(df, ["prem"], "ts", "spi").orderBy("ts").collect()]
    assert {r.ts: r.filled for r in out}[t0 + 2 * hour] == 2.0 and {r.ts: r.filled for r in out}[t0 + 4 * hour] == 4.0
    c = timeseries.completeness(df, ["prem"], "ts", minutes="spi").collect()[0]
    assert (c.expected_intervals, c.interval_count) == (6 + 8 + 17, 8)                               # 25 hours: 6, 2 in quarters, 17
    # The window form over the grid gives the same.
    grid = timeseries.time_grid(df, ["prem"], "ts", "spi")
    slow = timeseries.fill_linear(timeseries.flag_gaps(grid, df, ["prem", "spi"], "ts"), ["prem"], "ts", "value")
    assert rows(slow, "ts", "flag", "filled") == rows(timeseries.fill_between_readings(df, ["prem"], "ts", "value", "spi"), "ts", "flag", "filled")


def test_constant_step_column_equals_the_number(spark):
    rng = random.Random(2)
    data = [(f"p{i % 3}", _midnight(SPRING) + dt.timedelta(minutes=15 * k), rng.random(), 15) for i in range(3) for k in sorted(rng.sample(range(300), 120))]
    df = _frame(spark, data, READS)
    for fn in (lambda s: timeseries.fill_between_readings(df, ["prem"], "ts", "value", s), lambda s: timeseries.time_grid(df, ["prem"], "ts", s),
               lambda s: timeseries.completeness(df, ["prem"], "ts", minutes=s)):
        cols = [c for c in fn(15).columns]
        assert rows(fn(15), *cols) == rows(fn("spi"), *cols)


def test_readings_off_the_grid_keep_their_energy(spark):
    rng = random.Random(4)
    t0 = _midnight(FALL)
    data = [("a", t0 + dt.timedelta(seconds=rng.randrange(0, 90_000)), rng.randrange(0, 10 ** 7) / 10 ** 6, rng.choice([15, 30, 60])) for _ in range(300)]
    data += [("b", t0 + dt.timedelta(minutes=7), 1.0, 15), ("b", t0 + dt.timedelta(minutes=22), None, 15), ("c", t0, 2.5, 0), ("d", t0 + dt.timedelta(minutes=30), 1.0, 60)]
    df = _frame(spark, data, READS)
    for step in (15, 60, 240, 1440):
        out = timeseries.split_to_grid(df, ["prem"], "ts", "value", "spi", step)
        got = {r.prem: r.s for r in out.groupBy("prem").agg(F.sum("value").alias("s")).collect()}
        for p in "abcd":
            assert abs(float(got[p]) - sum(v or 0 for q, _, v, _ in data if q == p)) < 1e-9
        assert all((r.ts.hour * 60 + r.ts.minute) % step == 0 and r.ts.second == 0 for r in out.collect())
    parts = {(r.prem, r.ts): float(r.value) for r in timeseries.split_to_grid(df, ["prem"], "ts", "value", "spi", 15).collect()}
    assert parts[("b", t0)] == pytest.approx(8 / 15, abs=1e-6) and parts[("b", t0 + dt.timedelta(minutes=15))] == pytest.approx(7 / 15, abs=1e-6)
    assert parts[("c", t0)] == 2.5 and [parts[("d", t0 + dt.timedelta(minutes=m))] for m in (30, 45, 60, 75)] == [0.25] * 4
    # Against second-by-second sums.
    want = {}
    for p, t, v, m in data:
        if p == "a":
            for s in range(0, m * 60, 60):
                for one in range(60):
                    at = t + dt.timedelta(seconds=s + one)
                    slot = at.replace(minute=at.minute // 15 * 15, second=0)
                    want[slot] = want.get(slot, 0) + v / (m * 60)
    for slot, v in want.items():
        assert parts[("a", slot)] == pytest.approx(v, abs=1e-4)


def test_floor_above_an_hour(spark):
    t = dt.datetime(2025, 3, 1, 17, 44, 59)
    df = _frame(spark, [(t, 90)], "t timestamp_ntz, m int")
    got = df.select(timeseries.floor_minutes("t", 15).alias("a"), timeseries.floor_minutes("t", 120).alias("b"), timeseries.floor_minutes("t", "m").alias("c"),
                    timeseries.floor_minutes("t", 1440).alias("d"), timeseries.floor_minutes("t", 60).alias("e")).first()
    assert tuple(got) == tuple(dt.datetime(2025, 3, 1, *x) for x in ((17, 30), (16, 0), (16, 30), (0, 0), (17, 0)))


def test_ordered_neighbour_equals_the_window(spark):
    rng = random.Random(6)
    data = [(rng.choice([None, 1, 2, 2, 2, 2]), None if rng.random() < 0.05 else dt.date(2025, 1, 1) + dt.timedelta(days=rng.randrange(90)), i, rng.choice([None, i])) for i in range(600)]
    df = _frame(spark, data, "k int, d date, i int, v int")
    up, down = [F.col("d").asc_nulls_last(), F.col("i")], [F.col("d").desc_nulls_first(), F.col("i")]
    for ahead in (True, False):
        for order, descending in ((up, False), (down, True)):
            got = intervals.ordered_neighbour(df, ["k"], order, ["i", "v"], F.trunc("d", "month"), ["i2", "v2"], ahead, descending)
            w, f = Window.partitionBy("k").orderBy(*order), (F.lead if ahead else F.lag)
            want = df.withColumn("i2", f("i").over(w)).withColumn("v2", f("v").over(w))
            assert rows(got, "i", "k", "i2", "v2") == rows(want, "i", "k", "i2", "v2")


# ---------------------------------------------------------------- wall clocks

WALLS = "prem string, seq int, wall timestamp_ntz, ts timestamp_ntz"


def _recorded(times, prem="a", start=1):
    return [(prem, start + i, _wall(t), t) for i, t in enumerate(times)]


def _found(df, **options):
    return {(r.prem, r.seq): r for r in clocks.instants_by_order(df, ["prem"], "wall", ["seq"], **options).collect()}


@pytest.mark.parametrize("step", [15, 30, 60])
def test_complete_days_are_found_whole(spark, step):
    data = [r for d in (FALL - dt.timedelta(days=1), FALL, SPRING) for r in _recorded(list(_full(d, step)), "a", d.toordinal() * 1000)]
    got = _found(_frame(spark, data, WALLS), step_minutes=step)
    assert all(r.ts_utc == r.ts for r in got.values())
    assert sum(r.wall_status == "second" for r in got.values()) == 60 // step == sum(r.wall_status == "first" for r in got.values())


def test_order_tells_the_passes_and_the_rest_is_flagged(spark):
    full = list(_full(FALL, 15))
    some = [t for i, t in enumerate(full) if i not in (2, 9, 30)]                         # incomplete, the clock still steps back once
    one_pass = [t for t in full if not dt.time(1) <= _wall(t).time() < dt.time(2) or t.hour == 5]
    disordered = full[:3] + full[2:3] + full[3:]                                          # a repeat before the hour: two steps back
    pair = full[:4] + [full[4], full[8]] + full[13:]                                      # 01:00 twice and nothing between
    upward = full[:4] + [full[4], full[9]] + full[13:]                                    # 01:00 and 01:15 of different passes look like one
    data = [r for p, ts in zip("bcdefg", (some, one_pass, disordered, pair, upward, full)) for r in _recorded(ts, p)]
    data += [("h", 1, dt.datetime(2025, 3, 9, 2, 30), None), ("h", 2, None, None), ("h", 3, dt.datetime(2025, 3, 9, 3, 30), dt.datetime(2025, 3, 9, 7, 30))]
    got = _found(_frame(spark, data, WALLS))
    of = lambda p: [r for r in got.values() if r.prem == p]
    assert all(r.ts_utc == r.ts for p in "beg" for r in of(p))
    for p, n in (("c", 4), ("d", 8), ("f", 2)):
        assert sum(r.wall_status == "unresolved" and r.ts_utc is None for r in of(p)) == n
        assert all(r.ts_utc == r.ts for r in of(p) if r.wall_status != "unresolved")
    assert [got[("h", i)].wall_status for i in (1, 2, 3)] == ["nonexistent", "unresolved", "plain"] and got[("h", 3)].ts_utc == got[("h", 3)].ts
    # A stored place in the day resolves what the order can't.
    start = _midnight(FALL)
    placed = _frame(spark, data[:-3], WALLS).withColumn("place", (F.timestamp_diff("MINUTE", F.lit(start), F.col("ts")) / 15 + 1).cast("int"))
    assert all(r.ts_utc == r.ts for r in _found(placed, position="place").values())


def test_result_does_not_depend_on_the_session_zone(spark):
    df = _frame(spark, _recorded(list(_full(FALL, 15))), WALLS)
    want = rows(clocks.instants_by_order(df, ["prem"], "wall", ["seq"]), "seq", "ts_utc", "wall_status")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert rows(clocks.instants_by_order(df, ["prem"], "wall", ["seq"]), "seq", "ts_utc", "wall_status") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_clock_offsets(spark):
    hour = dt.timedelta(hours=1)
    days = {"ok": lambda t: _wall(t), "same_clock": lambda t: t, "other_season": lambda t: t - 5 * hour, "converted_twice": lambda t: _wall(_wall(t)), "wrong_zone": lambda t: t - 3 * hour}
    data = [(name, t, f(t)) for name, f in days.items() for t in _full(dt.date(2025, 7, 1), 60)]
    data += [("mixed", t, t - k * hour) for t in _full(dt.date(2025, 7, 1), 60) for k in (4, 5, 7)]
    data += [("ok", t, _wall(t)) for t in _full(FALL, 60)] + [("null", _midnight(FALL), None)]
    got = clocks.clock_offsets(_frame(spark, data, "site string, ts timestamp_ntz, local timestamp_ntz"), ["site"], "ts", "local").collect()
    assert all(r.verdict == r.site for r in got) and len(got) == 7
    fall = next(r for r in got if r.day == FALL)
    assert (fall.expected_first, fall.expected_last, fall.n_offsets, fall.offset_minutes) == (240, 300, 2, 300)
