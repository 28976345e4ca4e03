"""Unit tests of operators on literal rows: NULLs, boundaries, DST, audit precedence."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import rows
from loadgrid.functions import columns as C
from loadgrid.functions import predicates as P
from loadgrid.operators import audit, dedupe, intervals, setops, timeseries, units

D = dt.date
T = dt.datetime


def test_bad_reading_filters_null_handling(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, "IRREGULAR", 0.0), (3, "IRREGULAR", 1.0), (4, "X_POWER_FAIL", 2.0), (5, "OK", 0.0)],
                               "id int, s string, r double")
    assert [r[0] for r in rows(df.where(P.status_ok("s", "r")), "id")] == [3, 5]        # NULL status dropped
    assert [r[0] for r in rows(df.where(P.channel_flag_ok("s", "r")), "id")] == [1, 2, 3, 4, 5]
    f = spark.createDataFrame([(1, None, 0.0), (2, "PO", 1.0), (3, "E", 0.0), (4, "E", 1.0), (5, None, 3.0)], "id int, s string, r double")
    assert [r[0] for r in rows(f.where(P.interval_status_ok("s", "r")), "id")] == [1, 4, 5]
    g = spark.createDataFrame([(1, None, 1.0), (2, "x", 1.0), (3, None, None)], "id int, s string, r double")
    assert [r[0] for r in rows(g.where(P.good_reading("s", "r")), "id")] == [1]


def test_later_earlier_of_with_null(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), D(2024, 2, 1)), (D(2024, 3, 1), D(2024, 2, 1)), (None, D(2024, 2, 1)), (D(2024, 3, 1), None)],
                               "a date, b date")
    out = df.select(C.later_of("a", "b").alias("l"), C.earlier_of("a", "b").alias("e")).collect()
    assert [(r.l, r.e) for r in out] == [(D(2024, 2, 1), D(2024, 1, 1)), (D(2024, 3, 1), D(2024, 2, 1)), (None, None),
                                         (D(2024, 3, 1), D(2024, 3, 1))]


def test_sum_or_zero_and_names(spark):
    df = spark.createDataFrame([(1.0, None, "A", None), (1.0, 2.0, "A", "B")], "a double, b double, n1 string, n2 string")
    out = df.select(C.sum_or_zero("a", "b").alias("s"), C.join_names("n1", "n2").alias("n")).collect()
    assert [(r.s, r.n) for r in out] == [(0.0, "A"), (3.0, "A B")]


def test_strip_prefix_and_channel(spark):
    df = spark.createDataFrame([("AB123",), ("123",), ("A",), (None,)], "id string")
    assert [r[0] for r in df.select(C.strip_id_prefix("id")).collect()] == ["123", "123", "", None]
    ch = spark.createDataFrame([("Q1", 1, 2), ("X", 2, 2), ("X", 1, 2)], "m string, c int, s int")
    assert [r[0] for r in ch.select(C.channel_number("m", "c", "s")).collect()] == [5, 5, 4]


def test_interval_join_edges(spark):
    iv = spark.createDataFrame([(1, D(2024, 1, 1), D(2024, 1, 10)), (1, D(2024, 1, 10), D(2024, 1, 20))], "k int, s date, e date")
    f = spark.createDataFrame([(1, D(2024, 1, 1)), (1, D(2024, 1, 10)), (1, D(2024, 1, 20)), (1, D(2024, 1, 25))], "fk int, at date")
    half = intervals.interval_join(f, iv, [("fk", "k")], "at", "s", "e")
    closed = intervals.interval_join(f, iv, [("fk", "k")], "at", "s", "e", closed=True)
    assert rows(half, "at", "s") == [(D(2024, 1, 1), D(2024, 1, 1)), (D(2024, 1, 10), D(2024, 1, 10))]
    # closed: the shared edge matches twice, the last stop matches once
    assert rows(closed, "at", "s") == [(D(2024, 1, 1), D(2024, 1, 1)), (D(2024, 1, 10), D(2024, 1, 1)),
                                       (D(2024, 1, 10), D(2024, 1, 10)), (D(2024, 1, 20), D(2024, 1, 10))]


def test_sql_in_three_valued(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    with_null = spark.createDataFrame([(1,), (None,)], "k int")
    no_null = spark.createDataFrame([(1,)], "k int")
    empty = spark.createDataFrame([], "k int")
    got = lambda keys: rows(setops.sql_in(df, "x", keys, "k", "f"), "x", "f")
    assert got(no_null) == [(None, None), (1, True), (2, False)]
    assert got(with_null) == [(None, None), (1, True), (2, None)]     # NOT IN keeps nothing
    assert got(empty) == [(None, False), (1, False), (2, False)]
    # same answers as Spark SQL's own NOT IN
    df.createOrReplaceTempView("x_t"); with_null.createOrReplaceTempView("k_t")
    assert spark.sql("select x from x_t where x not in (select k from k_t)").count() == 0


def test_priority_and_latest(spark):
    df = spark.createDataFrame([("r", "2_APP", 5.0), ("r", "1_IEE", 7.0), ("r", "1_IEE", 6.0), ("s", None, 1.0), ("s", "5_TMS", 9.0)],
                               "k string, src string, v double")
    assert rows(dedupe.priority_dedupe(df, ["k"], "src", "v"), "k", "src", "v") == [("r", "1_IEE", 6.0), ("s", "5_TMS", 9.0)]
    b = spark.createDataFrame([(1, None, 1), (1, D(2024, 1, 1), 2), (2, D(2024, 1, 1), 3), (2, D(2024, 2, 1), 4)], "k int, d date, id int")
    # DESC puts NULL first, as in the reference's dialect
    assert rows(dedupe.latest_per_key(b, ["k"], "d"), "k", "id") == [(1, 1), (2, 4)]
    m = spark.createDataFrame([(1, 202401), (1, 202402), (1, 202402), (1, 202403)], "k int, mo int")
    assert len(rows(dedupe.last_n_periods(m, ["k"], "mo", 2))) == 3


def test_bucketed_islands_equal_plain(spark):
    e = spark.range(0, 3000).select(
        (F.col("id") % 3).alias("u"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("id") * 7).cast("int"))).alias("ts"),
        F.when((F.col("id") / 11).cast("int") % 3 == 0, "a").otherwise("b").alias("t"), "id")
    order = [F.col("ts").asc(), F.col("id").asc()]
    plain = intervals.islands(e, ["u"], ["t"], order)
    buck = intervals.islands(e, ["u"], ["t"], order, bucket=F.to_date("ts"))
    assert rows(plain, "id", "grp") == rows(buck, "id", "grp")


def test_chain_meter_intervals(spark):
    pm = spark.createDataFrame([
        (1, "M1", "T", 1.0, D(2020, 1, 1), D(2020, 1, 5), D(2020, 6, 1)),
        (1, "M2", "T", 2.0, D(2020, 6, 1), D(2020, 6, 1), D(2021, 1, 1)),
        (1, "M2", "T", 2.0, D(2020, 6, 1), D(2020, 7, 1), D(2021, 3, 1)),
    ], "prem_num int, ami_dvc_name string, fpl_mtr_num string, kwh_csnt double, mtr_set_date date, efct_strt_date date, efct_end_date date")
    out = rows(intervals.chain_meter_intervals(pm), "meterid", "meterstart", "meterstop")
    # M1 stops at M2's set date; M2 starts at its set date and runs to its last end
    assert out == [("M1", D(2020, 1, 1), D(2020, 6, 1)), ("M2", D(2020, 6, 1), D(2021, 3, 1))]


def test_units_before_after(spark):
    df = spark.createDataFrame([("a", "Wh", 1000.0), ("a", "kWh", 2.0), ("b", "Wh", 5000.0), ("b", "Wh", 1500.0)], "k string, u string, e double")
    df = df.withColumn("e", F.col("e").cast("decimal(18,4)"))
    pre = rows(units.sum_kwh_before(df, ["k"], "e", "u", below=6.0), "k", "kwh")
    assert [(k, float(v)) for k, v in pre] == [("a", 3.0)]          # b sums to 6.5 >= 6
    post = rows(units.sum_kwh_after(df, ["k"], "e", "u"), "k", "u", "kwh")
    assert [(k, u, float(v)) for k, u, v in post] == [("a", "Wh", 1.0), ("a", "kWh", 2.0), ("b", "Wh", 6.5)]


def test_dst_expected_intervals_and_grid(spark):
    days = spark.createDataFrame([(D(2025, 11, 1),), (D(2025, 11, 2),), (D(2025, 3, 9),)], "day date")
    got = {r.day: (r.n, r.h) for r in days.select("day", timeseries.expected_intervals("day").alias("n"),
                                                   timeseries.expected_hours("day").alias("h")).collect()}
    assert got == {D(2025, 11, 1): (96, 24), D(2025, 11, 2): (100, 25), D(2025, 3, 9): (92, 23)}
    # grid over the fall-back local day (UTC 04:00 .. next 04:45) has 100 points; wall time shows 96
    s = spark.createDataFrame([(1, T(2025, 11, 2, 4, 0)), (1, T(2025, 11, 3, 4, 45))], "u int, ts timestamp_ntz")
    g = timeseries.time_grid(s, ["u"], "ts", 15)
    assert g.count() == 100
    assert g.select(C.wall_time("ts")).distinct().count() == 96
    first, second = spark.createDataFrame([(T(2025, 11, 2, 5, 0),), (T(2025, 11, 2, 6, 0),)], "ts timestamp_ntz") \
        .select(C.wall_time("ts").alias("w"), timeseries.offset_hours("ts").alias("o")).collect()
    assert first.w == second.w == T(2025, 11, 2, 1, 0) and (first.o, second.o) == (4, 5)


def test_fill_linear_matches_brute_force(spark):
    base = T(2024, 1, 1, 22, 0)
    vals = [1.0, None, None, 4.0, None, None, None, None, 8.0, None, 10.0]
    df = spark.createDataFrame([(1, base + dt.timedelta(minutes=15 * i), v) for i, v in enumerate(vals)], "u int, ts timestamp_ntz, v double")
    got = [r.f for r in timeseries.fill_linear(df, ["u"], "ts", "v", "f").orderBy("ts").collect()]
    known = [(i, v) for i, v in enumerate(vals) if v is not None]
    exp = []
    for i, v in enumerate(vals):
        if v is not None:
            exp.append(v)
            continue
        (i0, v0), (i1, v1) = max(k for k in known if k[0] < i), min(k for k in known if k[0] > i)
        exp.append(v0 + (v1 - v0) * (i - i0) * 900.0 / ((i1 - i0) * 900.0))
    assert got == exp


def test_audit_gate_precedence(spark):
    runs = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1"), ("e", "1")], "audit_id string, etl_process_detail_id string")
    a = spark.createDataFrame([
        ("b", "1", "target-write", "success"), ("b", "1", "target-write", "success"),      # wrong count
        ("c", "1", "target-write", "error"),                                                # error
        ("d", "1", "target-write", "error"), ("d", "1", "target-write", "success"),         # both: ED124 wins
        ("e", "1", "target-write", "success"), ("e", "1", "read", "success"),               # clean
    ], "audit_id string, etl_process_detail_id string, step string, etl_process_status string")
    got = dict(rows(audit.audit_gate(runs, a), "audit_id", "status_code"))
    assert got == {"a": "ED125", "b": "ED124", "c": "ED126", "d": "ED124", "e": "PASS"}


def test_control_files_listing_and_totals(spark):
    from loadgrid.sources.files import list_files, read_control_files
    d = tempfile.mkdtemp(prefix="ctl-", dir="/tmp")
    for day, n in (("20240101", 3), ("20240102", 5)):
        with open(os.path.join(d, f"SUCCESS_{day}.txt"), "w") as fh:
            fh.write(f"{n}\n")
    with open(os.path.join(d, "other.csv"), "w") as fh:
        fh.write("x")
    listed = list_files(spark, d, name_regex=r"^SUCCESS_\d+")
    assert sorted(r.name for r in listed.collect()) == ["SUCCESS_20240101.txt", "SUCCESS_20240102.txt"]
    ctl = read_control_files(spark, d, r"SUCCESS_(\d{8})", glob="SUCCESS_*")
    assert rows(ctl, "file_date", "number_rows") == [("20240101", 3), ("20240102", 5)]
    loaded = spark.createDataFrame([("20240101",)] * 3 + [("20240102",)] * 4, "d string")
    tot = dict(rows(audit.control_totals(ctl, loaded, "d"), "file_date", "matches"))
    assert tot == {"20240101": True, "20240102": False}


def test_audit_store_roundtrip(spark):
    from loadgrid.sources.audit_store import append_audit, read_audit
    path = os.path.join(tempfile.mkdtemp(prefix="audit-", dir="/tmp"), "css_audit")
    rows_ = [("1", "9", D(2024, 1, 1), T(2024, 1, 1, 1), T(2024, 1, 1, 2), "success", 10, "p", "t", "target-write"),
             ("1", "8", D(2024, 1, 1), T(2024, 1, 1, 1), T(2024, 1, 1, 2), "error", 0, "p", "t", "read")]
    append_audit(spark, rows_, path)
    got = read_audit(spark.read.parquet(path), "1", "9").collect()
    assert len(got) == 1 and got[0].step == "target-write"


def _flagged_grid_via_grid(spark, sf, fill):
    """The result built literally: grid, left join, window fill."""
    from loadgrid.plans.driver_queries import _buckets
    b = _buckets(spark, sf)
    f = timeseries.flag_gaps(timeseries.time_grid(b, ["user_id"], "ts", 15), b, ["user_id"], "ts")
    f = f.withColumn("flag", F.when((F.col("flag") == "A") & F.col("bad"), F.lit("B")).otherwise(F.col("flag"))).drop("bad")
    return timeseries.fill_linear(f, ["user_id"], "ts", "value", "filled") if fill else f


def test_fill_between_readings_equals_grid_form(spark):
    from loadgrid.plans.driver_queries import _flagged_grid
    sf = "/root/testdata/sf0.001"
    fast = _flagged_grid(spark, sf, fill=True)
    slow = _flagged_grid_via_grid(spark, sf, fill=True)
    assert fast.where("value IS NULL AND flag = 'B'").count() > 0        # readings without a value are filled too
    cols = ("user_id", "ts", "value", "flag", "filled")
    assert rows(fast, *cols) == rows(slow, *cols)


def test_fill_between_readings_with_nulls_and_long_gap(spark):
    base = T(2024, 1, 1, 22, 0)
    at = lambda i: base + dt.timedelta(minutes=15 * i)
    got = timeseries.fill_between_readings(spark.createDataFrame(
        [(1, at(0), 1.0), (1, at(1), None), (1, at(4), 5.0), (1, at(404), 405.0), (2, at(0), None)], "u int, ts timestamp_ntz, v double"), ["u"], "ts", "v").collect()
    one = sorted((r.ts, r.v, r.flag, r.filled) for r in got if r.u == 1 and r.ts <= at(4))
    assert [(r[2], r[3]) for r in one] == [("A", 1.0), ("A", 2.0), ("I", 3.0), ("I", 4.0), ("A", 5.0)]
    assert sorted(r.filled for r in got if r.u == 1) == [float(i) for i in range(1, 406)]
    assert [r.filled for r in got if r.u == 2] == [None]


def test_completeness_reports_missing_days(spark):
    d0 = T(2025, 11, 1, 4, 0)
    ts = [d0 + dt.timedelta(minutes=15 * i) for i in range(96)] + [d0 + dt.timedelta(hours=49, minutes=15 * i) for i in range(96)]
    df = spark.createDataFrame([("m", t) for t in ts], "k string, ts timestamp_ntz")
    got = {r.day: (r.interval_count, r.expected_intervals, r.deficit) for r in timeseries.completeness(df, ["k"], "ts").collect()}
    assert got == {D(2025, 11, 1): (96, 96, 0), D(2025, 11, 2): (0, 100, 100), D(2025, 11, 3): (96, 96, 0)}
    wide = timeseries.completeness(df, ["k"], "ts", first_day="2025-10-31", last_day="2025-11-04")
    assert [r[1] for r in rows(wide, "day", "interval_count")] == [0, 96, 0, 96, 0]
    assert [r[1] for r in rows(timeseries.completeness(df, [], "ts"), "day", "interval_count")] == [96, 0, 96]


def test_stage_triage_per_series(spark):
    day = [T(2025, 11, 2, 4, 0) + dt.timedelta(hours=i) for i in range(25)]           # the fall-back day
    mk = lambda spec: spark.createDataFrame([(k, t) for k, hours in spec for t in hours], "k string, ts timestamp_ntz")
    src = mk([("ok", day), ("up", day[:20]), ("proc", day), ("out", day)])
    prc = mk([("ok", day), ("up", day[:20]), ("proc", day[:24]), ("out", day)])
    out = mk([("ok", day), ("up", day[:20]), ("proc", day[:24]), ("out", day[:-1])])
    want = {"ok": "ok", "up": "upstream", "proc": "processing", "out": "output"}
    assert dict(rows(timeseries.stage_triage(src, prc, out, "ts", keys=["k"]), "k", "verdict")) == want
    wall = out.select("k", C.wall_time("ts").alias("w"))
    assert dict(rows(timeseries.stage_triage(src, prc, wall, "ts", keys=["k"], output_wall="w"), "k", "verdict")) == want


def test_islands_by_bucket_equal_plain_islands(spark):
    rows_ = [(i % 3, "a" if (i // 4) % 2 else "b", T(2024, 1, 1) + dt.timedelta(hours=5 * i), i) for i in range(60)]
    df = spark.createDataFrame(rows_, "k int, run string, ts timestamp_ntz, id int")
    order = [F.col("ts").asc(), F.col("id").asc()]
    cols = ("k", "run", "ts", "id", "grp")
    plain = intervals.islands(df, ["k"], ["run"], order)
    assert rows(intervals.islands(df, ["k"], ["run"], order, bucket=F.to_date("ts")), *cols) == rows(plain, *cols)


def test_shares_from_readings_equal_grid_shares(spark):
    from loadgrid.plans.driver_queries import ZONE, _buckets
    sf = "/root/testdata/sf0.001"
    slow = timeseries.interval_shares(_flagged_grid_via_grid(spark, sf, fill=False), ["user_id"], "ts", "flag", ZONE)
    b = _buckets(spark, sf).withColumn("flag", F.when(F.col("bad"), F.lit("B")).otherwise(F.lit("A")))
    fast = timeseries.interval_shares_from_readings(b, ["user_id"], "ts", "flag", 15, ZONE)
    assert rows(fast, *slow.columns) == rows(slow)
