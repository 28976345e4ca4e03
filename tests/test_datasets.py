"""Dataset builders on utility-schema fixtures."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import tables
from loadgrid.params import RunParams
from loadgrid.plans import datasets, runs

D, T = dt.date, dt.datetime
DAILY = dict(mode="daily", run_date=D(2025, 11, 2), start_date=D(2025, 11, 9), month_from=202509, month_to=202511,
             as_of=D(2025, 11, 10), company="FPL", exclude_premises=(373190907,), fetch_from=T(2022, 9, 30), fetch_to=T(2025, 11, 4))


def test_study_modes(spark):
    t = tables(spark)
    d = datasets.study(t, RunParams(**DAILY))
    assert [r[0] for r in rows(d, "studyid")] == ["S1", "S2"]        # S3 ended, UEV4 logged, S5 not billed
    b = datasets.study(t, RunParams(mode="backdate", month=202510, as_of=D(2025, 11, 10), company="FPL"))
    assert [r[0] for r in rows(b, "studyid")] == ["S3", "UEV4"]      # S1 logged for the month, S2 complete; S3 ends in 202511
    r = datasets.study(t, RunParams(mode="reprocess", month=202510, company="FPL"))
    assert [r_[0] for r_ in rows(r, "studyid")] == ["S1", "S1"]      # queued twice -> twice
    sp = datasets.study_premise(t, RunParams(mode="reprocess", month=202510, company="FPL"))
    assert [x[0] for x in rows(sp, "premiseid")] == [10]             # semi-join: once; deleted premise 13 dropped


def test_ami_day_and_uevmada(spark):
    t = tables(spark)
    a = datasets.ami_day(t, RunParams(**DAILY)).collect()
    assert [(x.greg_date, x.cycl_day_num, x.rltv_greg_mo, x.greg_days) for x in a] == [(D(2025, 11, 1), 1, 202511, 31)]
    u = datasets.uevmada(t, RunParams(mode="daily", run_date=D(2025, 11, 8))).collect()
    assert len(u) == 1 and float(u[0].billkwh) == 3.5 and u[0].rltv_mo == "202510" and u[0].billstart == D(2025, 10, 1)


def test_uevcust_and_mada(spark):
    t = tables(spark)
    c = datasets.uevcust(t, RunParams(**DAILY)).collect()
    assert [(x.accountid, x.ratecode, x.wc_dist) for x in c] == [("A2", "RS", "WC9")]
    m = datasets.mada(t, RunParams(**DAILY, avg_months=12, interval_months=13))
    got = m.collect()
    # two completed net-meter applications before the reading date: the left join fans out to 2 rows
    assert len(got) == 2
    r = got[0]
    assert (r.ratecode, r.customer, r.netmeter, float(r.evkwh), r.zipcode) == ("RS", "Ann Lee", 1, 0.0, "33101")
    assert float(r.avgmonthlykwh) == 450.0 and r.num_months_monthlyavg == 2


def test_meters_and_pb(spark):
    t = tables(spark)
    m = rows(datasets.meters(t, RunParams(**DAILY)), "premiseid", "meterid", "metertype")
    assert m == [("100", "MA", "ABCDEN"), ("101", "MB", "PLAIN"), ("5730", "CB1", "evmeter"), ("6000", "uevmeterid", "uevmeter")]
    pb = datasets.meters_pb(t, RunParams(**DAILY))
    got = rows(pb, "premiseid", "meterid", "channel", "grp", "meterstart", "meterstop")
    r1 = [g for g in got if g[1] == "R1"]
    # channel 1 has two islands (grp 0 and 1) split by the channel-4 row; stops chain to the next start
    assert [(g[2], g[3]) for g in r1] == [(1, 0), (1, 1), (4, 1)]
    assert ("SST" in [g[1] for g in got]) and not any(g[1] == "G5" for g in got) and not any(g[1] == "R9" and g[0] == 3 for g in got)
    acc = rows(datasets.pb_accounts(t, RunParams(**DAILY)), "premiseid")
    assert acc == [(1,), (2,), (3,), (4,)]


def test_power_billing(spark):
    t = tables(spark)
    pb = datasets.power_billing(t, RunParams(**DAILY))
    got = rows(pb, "meterid", "read_ts_utc", "kwh", "channel")
    assert {(r.read_ts_utc - r.read_strt_time).total_seconds() for r in pb.collect()} == {4 * 3600.0}   # wall time beside the instant
    # IEE (priority 1) wins at 00:00 over TMS and APP; SG alone at 00:15 (id 'ABR1' -> 'R1'); MV90 zero with status dropped
    assert (("R1", T(2022, 10, 1, 0, 0), 4.0, 1) in got) and (("R1", T(2022, 10, 1, 0, 15), 6.0, 1) in got)
    assert len([g for g in got if g[0] == "R1"]) == 2
    assert ("SST", T(2022, 10, 1, 0, 0), 3.75, 629) in got


def test_mass_market_fall_back(spark):
    t = tables(spark)
    nm = datasets.mass_market_nm(t, RunParams(**DAILY, legacy_wall_time=True))
    meter = nm.where(F.col("meterid") == "MA")
    assert meter.count() == 100 and meter.select("read_strt_time").distinct().count() == 96
    legacy = rows(nm.where(F.col("metertype") == "evmeter"), "meterid", "read_strt_time", "kwh")
    # reference behaviour: both 01:00 wall hours of charger CB1 are summed into one row (2 + 3); Wh / 1000 for CB2
    assert legacy == [("CB1", T(2025, 11, 2, 1, 0), 5.0), ("CB2", T(2025, 11, 2, 1, 0), 2.0)]
    fixed = datasets.mass_market_nm(t, RunParams(**DAILY))
    assert rows(fixed.where(F.col("metertype") == "evmeter"), "meterid", "kwh") == [("CB1", 2.0), ("CB1", 3.0), ("CB2", 2.0)]
    nn = datasets.mass_market_not_nm(t, RunParams(**DAILY))
    assert rows(nn.where(F.col("metertype") == "uevmeter"), "premiseid", "kwh") == [("5730", 2.0), ("5730", 3.0), ("6000", 2.0)]
    summed = datasets.mass_market_not_nm(t, RunParams(**DAILY, legacy_wall_time=True))
    assert rows(summed.where(F.col("metertype") == "uevmeter"), "premiseid", "kwh") == [("5730", 5.0), ("6000", 2.0)]
    assert nn.where(F.col("meterid") == "MB").count() == 4


def test_tz_probe(spark):
    t = tables(spark)
    got = datasets.tz_probe(t, "5730", D(2025, 11, 2)).collect()
    assert [(r.read_strt_dttm, r.eastern_time) for r in got] == [(T(2025, 11, 2, 5, 0), T(2025, 11, 2, 1, 0)),
                                                                (T(2025, 11, 2, 6, 0), T(2025, 11, 2, 1, 0))]


def test_run_daily_materialized(spark):
    t = tables(spark)
    out = runs.run(spark, t, RunParams(**DAILY), materialize=True, run_id="test")
    assert list(out) == runs.RUN_ORDER["daily"]
    assert spark.table("study").count() == 2 and spark.table("mass_market_nm").count() > 0


def test_plans_for_every_mode(spark):
    t = tables(spark)
    for mode, extra in (("backdate", {}), ("reprocess", {})):
        p = RunParams(mode=mode, month=202510, as_of=D(2025, 11, 20), company="FPL", exclude_premises=(373190907,), bill_from_date=D(2025, 8, 1), bill_to_date=D(2025, 12, 1),
                      bill_start=D(2025, 10, 1), bill_end=D(2025, 12, 1), min_bill_date=D(2024, 10, 1),
                      fetch_from=T(2025, 10, 1), fetch_to=T(2025, 11, 4), **extra)
        plans = runs.plan(t, p)
        assert list(plans) == runs.RUN_ORDER[mode]
        for name, df in plans.items():
            df.count()
        assert plans["mada"].count() == 2


def test_missing_and_text_parameters(spark):
    t = tables(spark)
    with pytest.raises(ValueError, match="fetch_from"):
        datasets.power_billing(t, RunParams(mode="daily", run_date="20251102"))
    with pytest.raises(ValueError, match="company"):
        datasets.study_premise(t, RunParams(mode="daily", run_date="20251102"))
    with pytest.raises(ValueError, match="mode"):
        RunParams(mode="weekly")
    assert RunParams(mode="daily", run_date="20251102").run_date == D(2025, 11, 2)


def test_average_keeps_the_scale_of_its_input(spark):
    bills = spark.createDataFrame([(1, 202510, 30, Decimal("100.1234"))], "prem_num int, rltv_mo int, service_days int, total_kwh decimal(18,4)")
    assert float(datasets.monthly_average(bills, 12).first().avgmonthlykwh) == 100.1234


def test_ties_in_source_priority(spark):
    t = dict(tables(spark))
    # the same recorder and channel on a second premise: source, value and start tie
    app = t["pb_app_device"]
    t["pb_app_device"] = app.unionByName(app.where("rcrdr_id = 'R1'").withColumn("prem_num", F.lit(9).cast("long")))
    got = datasets.power_billing(t, RunParams(**DAILY)).where("meterid = 'R1'").collect()
    assert {r.premiseid for r in got} == {"1"} and len(got) == 2


def test_app_rows_with_null_in_a_list(spark):
    t = dict(tables(spark))
    p = RunParams(**DAILY)
    assert datasets.app_device_rows(t, p).count() > 0
    iee = t["iee_pb_device"]
    t["iee_pb_device"] = iee.unionByName(iee.limit(1).withColumn("rcrdr_id", F.lit(None).cast("string")))
    assert datasets.app_device_rows(t, p).count() == 0        # NOT IN over a list with a NULL is never true
