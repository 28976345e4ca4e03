"""Queries on the driver's tables, each with an equivalent DuckDB SQL text (the oracle).

The utility tables do not exist in the driver data, so utility-shaped views are derived from the
driver tables (customer ~ study/premise, orders ~ logs, bills and accounts, lineitem ~ devices and
transactions, supplier ~ EV sites, events ~ interval readings). The same derivation is written
once in Spark (``_views``) and once in SQL (``VIEWS_SQL``); most queries then run the real dataset
builders or operators over whole tables. Decimal outputs are cast to double on both sides.
"""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadgrid.functions.columns import month_key
from loadgrid.params import RunParams, Scopes
from loadgrid.plans import datasets

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RUN_DATE = dt.date(1998, 8, 3)
START_DATE = dt.date(1998, 8, 18)     # minus 8 days is cycle day 10
MONTH = 199806
AS_OF = dt.date(2001, 8, 31)
ACCOUNT_CUTOFF = dt.date(2000, 1, 1)
DEVICE_CUTOFF = dt.date(1998, 1, 1)


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _dbl(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


# ------------------------------------------------------------------ derived utility-shaped views

def _sid(segment, custkey):
    return F.concat(F.when(segment == "AUTOMOBILE", F.lit("UEV")).otherwise(F.lit("S")), custkey.cast("string"))


def _views(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    c, o, l, s = (_t(spark, sf, n) for n in ("customer", "orders", "lineitem", "supplier"))
    cs = c.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey",
                  _sid(F.col("c_mktsegment"), F.col("c_custkey")).alias("studyid"))
    oc = o.join(cs.select("c_custkey", "studyid", "c_name"), o["o_custkey"] == cs["c_custkey"])
    w = o.groupBy("o_custkey").agg(
        F.min("o_orderdate").cast("date").alias("startdate"),
        F.when(F.count_if(F.col("o_orderstatus") == "O") > 0, F.lit(None).cast("date"))
         .otherwise(F.max("o_orderdate").cast("date")).alias("enddate"))
    study = cs.join(w, cs["c_custkey"] == w["o_custkey"]).select(
        "studyid", "c_name", (F.col("c_acctbal") > 0).alias("billingdata"),
        (F.col("c_mktsegment") != "HOUSEHOLD").alias("active_flag"),
        (F.col("c_mktsegment") != "MACHINERY").alias("backdated_flag"),
        F.when(F.col("c_nationkey") == 0, F.lit(None).cast("boolean")).otherwise(F.col("c_nationkey") > 22).alias("deleted_flg"),
        F.when(F.col("c_nationkey") == 1, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("fetchtype"),
        "startdate", "enddate")
    done = oc.where(F.col("o_orderstatus") == "F")
    etl_log = done.select("studyid", F.col("o_orderdate").cast("date").alias("greg_date"))
    etl_backdated = done.select("studyid", month_key("o_orderdate").alias("rltv_mo"),
                                (F.col("o_orderpriority") == "1-URGENT").alias("complete_flg"))
    queue = oc.select("studyid", month_key("o_orderdate").alias("rltv_mo"),
                      F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("date"))
                       .otherwise(F.col("o_orderdate").cast("date")).alias("validation_run_date"))
    study_premise = oc.select("studyid", F.col("o_orderkey").alias("premiseid"),
                              F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("FPL")).otherwise(F.col("o_orderpriority")).alias("company"),
                              F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("boolean"))
                               .otherwise(F.col("o_totalprice") < 5000).alias("deleted_flg"))
    days = o.select(F.col("o_orderdate").cast("date").alias("greg_date")).distinct()
    dom = F.dayofmonth("greg_date")
    day = days.select("greg_date", F.when(dom == 31, F.lit(None).cast("int")).when(dom > 21, F.lit(0)).otherwise(dom).alias("cycl_day_num"),
                      F.year("greg_date").alias("cal_yr"), F.month("greg_date").alias("cal_mo"))
    small = F.col("l_quantity") < 48
    dev = l.select(F.col("l_suppkey").alias("prem_num"), F.col("l_partkey").cast("string").alias("rcrdr_id"),
                   F.concat("l_returnflag", "l_linestatus").alias("fpl_mtr_num"),
                   F.col("l_shipdate").cast("date").alias("efct_strt_date"),
                   F.date_add(F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int") * 20).alias("efct_end_date"),
                   F.col("l_linenumber").alias("rcrdr_seq_num"), F.col("l_linenumber").alias("chnl_num"),
                   F.col("l_tax").cast("decimal(18,2)").alias("rgstr_csnt"), F.col("l_discount").cast("decimal(18,2)").alias("ke_csnt"),
                   "l_shipdate", "l_orderkey", "l_quantity", "l_linenumber")
    app = dev.where(small).select("prem_num", "rcrdr_id", "fpl_mtr_num", "efct_strt_date", "efct_end_date", "rcrdr_seq_num",
                                  F.col("efct_strt_date").alias("rcrdr_id_efct_strt_date"),
                                  F.col("efct_strt_date").alias("mtr_efct_strt_date"), "chnl_num", "rgstr_csnt", "ke_csnt")
    iee = dev.where(~small).select("prem_num", "rcrdr_id", "fpl_mtr_num",
                                   F.col("l_shipdate").alias("rcrdr_strt_date"),
                                   F.col("efct_end_date").cast("timestamp_ntz").alias("rcrdr_end_date"),
                                   F.when(F.col("l_linenumber") == 7, F.lit(None).cast("int")).otherwise(F.col("l_linenumber")).alias("rcrdr_seq_num"),
                                   "chnl_num", "rgstr_csnt", "ke_csnt", F.col("l_orderkey").alias("etl_batch_id"))
    apc = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_custkey").alias("install_num"), F.col("o_orderkey").alias("acct_num"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("rate_schd_cd"),
        F.col("c_name").alias("full_name"), F.col("o_orderstatus").alias("acct_stat_cd"), F.col("c_custkey").alias("cust_num"),
        F.col("o_orderdate").cast("date").alias("acct_open_date"))
    ai = o.select(F.col("o_custkey").alias("install_num"), F.col("o_orderkey").alias("acct_num"),
                  F.substring("o_orderpriority", 1, 1).alias("prem_dstr_cd"), (F.col("o_orderstatus") == "F").alias("crnt_row_flag"))
    trans = l.select(F.col("l_suppkey").alias("site_pk"), F.when(F.col("l_linenumber") == 3, F.lit(3)).otherwise(F.lit(1)).alias("prod_id"),
                     F.col("l_returnflag").alias("acct_num"), F.col("l_shipdate").alias("trans_end_dttm"),
                     F.col("l_extendedprice").cast("decimal(18,2)").alias("energy"),
                     F.when(F.col("l_linestatus") == "O", F.lit("Wh")).otherwise(F.lit("kWh")).alias("energy_unit"))
    site = s.select(F.col("s_suppkey").alias("site_pk"), F.lit(1).alias("prod_id"),
                    F.concat(F.lit("SITE"), F.col("s_suppkey").cast("string")).alias("site_id"),
                    (F.col("s_acctbal") > 0).alias("crnt_row_flag"), F.col("s_nationkey").cast("string").alias("zip"),
                    F.col("s_name").alias("addr"))
    pm = o.select(F.col("o_custkey").alias("prem_num"), F.col("o_orderpriority").alias("ami_dvc_name"),
                  F.when(F.col("o_totalprice") > 200000, F.concat("o_orderstatus", F.lit("N"))).otherwise(F.col("o_orderstatus")).alias("fpl_mtr_num"),
                  F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("decimal(18,2)"))
                   .otherwise(F.length("o_orderpriority").cast("decimal(18,2)")).alias("kwh_csnt"),
                  F.trunc(F.col("o_orderdate").cast("date"), "month").alias("mtr_set_date"),
                  F.col("o_orderdate").cast("date").alias("efct_strt_date"),
                  F.date_add(F.col("o_orderdate").cast("date"), 90).alias("efct_end_date"))
    cb = l.select(
        F.col("l_partkey").cast("string").alias("charge_box_id"), F.col("l_linenumber").alias("connector_id"),
        F.col("l_returnflag").alias("connector_type"), F.col("l_linestatus").alias("charge_point_serial_number"),
        F.col("l_suppkey").alias("site_pk"), F.lit(1).alias("prod_id"),
        (F.col("l_shipdate") - F.expr("INTERVAL 30 DAYS")).alias("chrgr_instl_dt"), F.col("l_shipdate").alias("efct_strt_dttm"),
        (F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_quantity") * 10).cast("int"))).alias("efct_end_dttm"),
        F.when(F.col("l_returnflag") == "R", F.lit("Asset In-Service")).when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
         .otherwise(F.lit("Retired")).alias("asset_status"),
        F.when(F.col("l_linestatus") == "O", F.lit(1500)).otherwise(F.lit(None).cast("int")).alias("sub_comp_cd"))
    return {"premise_meter": pm, "ev_charge_box": cb, "study": study, "etl_log": etl_log, "etl_backdated": etl_backdated, "study_to_reprocess": queue,
            "study_premise": study_premise, "day": day, "pb_app_device": app, "iee_pb_device": iee,
            "mv_acct_prem_cust": apc, "account_installation": ai, "ev_trans_detail_fact": trans, "ev_site": site}


VIEWS_SQL = """
cs AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey,
              CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'UEV' ELSE 'S' END || CAST(c_custkey AS VARCHAR) AS studyid
       FROM customer),
oc AS (SELECT o.*, cs.studyid, cs.c_name FROM orders o JOIN cs ON o.o_custkey = cs.c_custkey),
study AS (SELECT cs.studyid, cs.c_name, cs.c_acctbal > 0 AS billingdata, cs.c_mktsegment <> 'HOUSEHOLD' AS active_flag,
                 cs.c_mktsegment <> 'MACHINERY' AS backdated_flag,
                 CASE WHEN cs.c_nationkey = 0 THEN NULL ELSE cs.c_nationkey > 22 END AS deleted_flg,
                 CASE WHEN cs.c_nationkey = 1 THEN NULL ELSE cs.c_mktsegment END AS fetchtype,
                 w.startdate, w.enddate
          FROM cs JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS startdate,
                               CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN NULL
                                    ELSE CAST(MAX(o_orderdate) AS DATE) END AS enddate
                        FROM orders GROUP BY o_custkey) w ON cs.c_custkey = w.o_custkey),
etl_log AS (SELECT studyid, CAST(o_orderdate AS DATE) AS greg_date FROM oc WHERE o_orderstatus = 'F'),
etl_backdated AS (SELECT studyid, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS rltv_mo,
                         o_orderpriority = '1-URGENT' AS complete_flg FROM oc WHERE o_orderstatus = 'F'),
study_to_reprocess AS (SELECT studyid, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS rltv_mo,
                              CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS validation_run_date
                       FROM oc),
study_premise AS (SELECT studyid, o_orderkey AS premiseid,
                         CASE WHEN o_orderpriority = '1-URGENT' THEN 'FPL' ELSE o_orderpriority END AS company,
                         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice < 5000 END AS deleted_flg FROM oc),
day AS (SELECT greg_date,
               CAST(CASE WHEN day(greg_date) = 31 THEN NULL WHEN day(greg_date) > 21 THEN 0 ELSE day(greg_date) END AS INTEGER) AS cycl_day_num,
               CAST(year(greg_date) AS INTEGER) AS cal_yr, CAST(month(greg_date) AS INTEGER) AS cal_mo
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS greg_date FROM orders) d),
dev AS (SELECT l_suppkey AS prem_num, CAST(l_partkey AS VARCHAR) AS rcrdr_id, l_returnflag || l_linestatus AS fpl_mtr_num,
               CAST(l_shipdate AS DATE) AS efct_strt_date,
               CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) * 20 AS DATE) AS efct_end_date,
               l_linenumber AS rcrdr_seq_num, l_linenumber AS chnl_num,
               CAST(l_tax AS DECIMAL(18,2)) AS rgstr_csnt, CAST(l_discount AS DECIMAL(18,2)) AS ke_csnt,
               l_shipdate, l_orderkey, l_quantity, l_linenumber
        FROM lineitem),
pb_app_device AS (SELECT prem_num, rcrdr_id, fpl_mtr_num, efct_strt_date, efct_end_date, rcrdr_seq_num,
                         efct_strt_date AS rcrdr_id_efct_strt_date, efct_strt_date AS mtr_efct_strt_date, chnl_num,
                         rgstr_csnt, ke_csnt FROM dev WHERE l_quantity < 48),
iee_pb_device AS (SELECT prem_num, rcrdr_id, fpl_mtr_num, l_shipdate AS rcrdr_strt_date,
                         CAST(efct_end_date AS TIMESTAMP) AS rcrdr_end_date,
                         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS rcrdr_seq_num, chnl_num,
                         rgstr_csnt, ke_csnt, l_orderkey AS etl_batch_id FROM dev WHERE NOT (l_quantity < 48)),
mv_acct_prem_cust AS (SELECT o_custkey AS install_num, o_orderkey AS acct_num,
                             CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS rate_schd_cd,
                             c_name AS full_name, o_orderstatus AS acct_stat_cd, c_custkey AS cust_num,
                             CAST(o_orderdate AS DATE) AS acct_open_date
                      FROM orders JOIN customer ON o_custkey = c_custkey),
account_installation AS (SELECT o_custkey AS install_num, o_orderkey AS acct_num, substring(o_orderpriority, 1, 1) AS prem_dstr_cd,
                                o_orderstatus = 'F' AS crnt_row_flag FROM orders),
ev_trans_detail_fact AS (SELECT l_suppkey AS site_pk, CASE WHEN l_linenumber = 3 THEN 3 ELSE 1 END AS prod_id,
                                l_returnflag AS acct_num, l_shipdate AS trans_end_dttm,
                                CAST(l_extendedprice AS DECIMAL(18,2)) AS energy,
                                CASE WHEN l_linestatus = 'O' THEN 'Wh' ELSE 'kWh' END AS energy_unit FROM lineitem),
premise_meter AS (SELECT o_custkey AS prem_num, o_orderpriority AS ami_dvc_name,
                         CASE WHEN o_totalprice > 200000 THEN o_orderstatus || 'N' ELSE o_orderstatus END AS fpl_mtr_num,
                         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(length(o_orderpriority) AS DECIMAL(18,2)) END AS kwh_csnt,
                         CAST(date_trunc('month', o_orderdate) AS DATE) AS mtr_set_date, CAST(o_orderdate AS DATE) AS efct_strt_date,
                         CAST(CAST(o_orderdate AS DATE) + INTERVAL 90 DAY AS DATE) AS efct_end_date FROM orders),
ev_charge_box AS (SELECT CAST(l_partkey AS VARCHAR) AS charge_box_id, l_linenumber AS connector_id, l_returnflag AS connector_type,
                         l_linestatus AS charge_point_serial_number, l_suppkey AS site_pk, 1 AS prod_id,
                         l_shipdate - INTERVAL 30 DAY AS chrgr_instl_dt, l_shipdate AS efct_strt_dttm,
                         l_shipdate + to_days(CAST(l_quantity * 10 AS INTEGER)) AS efct_end_dttm,
                         CASE WHEN l_returnflag = 'R' THEN 'Asset In-Service' WHEN l_returnflag = 'A' THEN NULL ELSE 'Retired' END AS asset_status,
                         CASE WHEN l_linestatus = 'O' THEN 1500 ELSE NULL END AS sub_comp_cd
                  FROM lineitem),
ev_site AS (SELECT s_suppkey AS site_pk, 1 AS prod_id, 'SITE' || CAST(s_suppkey AS VARCHAR) AS site_id,
                   s_acctbal > 0 AS crnt_row_flag, CAST(s_nationkey AS VARCHAR) AS zip, s_name AS addr FROM supplier)
"""


def _with(sql: str) -> str:
    return "WITH " + VIEWS_SQL.strip() + ",\n" + sql.strip()


# ------------------------------------------------------------------ Q1/Q2 work selection

_DAILY_COND = f"""billingdata = true AND active_flag = true AND coalesce(deleted_flg, false) = false AND fetchtype IS NOT NULL
  AND startdate <= DATE '{RUN_DATE}' AND coalesce(enddate, DATE '9999-12-31') >= DATE '{RUN_DATE}'
  AND NOT EXISTS (SELECT 1 FROM etl_log l WHERE l.studyid = s.studyid AND l.greg_date = DATE '{RUN_DATE}')"""
_BACK_COND = f"""billingdata = true AND backdated_flag = true AND active_flag = true AND coalesce(deleted_flg, false) = false
  AND fetchtype IS NOT NULL
  AND CAST(strftime(startdate, '%Y%m') AS INTEGER) <= {MONTH}
  AND CAST(strftime(coalesce(enddate, DATE '{AS_OF}'), '%Y%m') AS INTEGER) >= {MONTH}
  AND NOT EXISTS (SELECT 1 FROM etl_backdated b WHERE b.studyid = s.studyid AND b.rltv_mo = {MONTH})
  AND NOT EXISTS (SELECT 1 FROM etl_backdated b WHERE b.studyid = s.studyid AND b.complete_flg = true)"""
_REPRO_JOIN = f"""study s JOIN study_to_reprocess r ON r.studyid = s.studyid AND r.validation_run_date IS NULL
  AND r.rltv_mo = {MONTH} WHERE s.billingdata = true"""

_P_DAILY = RunParams(mode="daily", run_date=RUN_DATE, company="FPL")
_P_BACK = RunParams(mode="backdate", month=MONTH, as_of=AS_OF, company="FPL")
_P_REPRO = RunParams(mode="reprocess", month=MONTH, as_of=AS_OF, company="FPL")


@query("study_active", _with(f"SELECT s.*, DATE '{RUN_DATE}' AS greg_date FROM study s WHERE {_DAILY_COND}"))
def q_study_active(spark, sf):
    return datasets.study(_views(spark, sf), _P_DAILY)


@query("study_backdate", _with(f"SELECT s.*, {MONTH} AS rltv_mo FROM study s WHERE {_BACK_COND}"))
def q_study_backdate(spark, sf):
    return datasets.study(_views(spark, sf), _P_BACK)


@query("study_reprocess", _with(f"SELECT s.*, {MONTH} AS rltv_mo FROM {_REPRO_JOIN}"))
def q_study_reprocess(spark, sf):
    return datasets.study(_views(spark, sf), _P_REPRO)


_SP = """SELECT p.* FROM study_premise p JOIN ({sel}) st ON st.studyid = p.studyid
WHERE (p.company = 'FPL' OR p.studyid LIKE '%UEV%') AND coalesce(p.deleted_flg, false) = false"""


@query("scope_premises", _with(_SP.format(sel=f"SELECT DISTINCT studyid FROM study s WHERE {_DAILY_COND}")))
def q_scope_premises(spark, sf):
    return datasets.study_premise(_views(spark, sf), _P_DAILY)


@query("scope_premises_backdate", _with(_SP.format(sel=f"SELECT DISTINCT studyid FROM study s WHERE {_BACK_COND}")))
def q_scope_premises_backdate(spark, sf):
    return datasets.study_premise(_views(spark, sf), _P_BACK)


@query("scope_premises_reprocess", _with(_SP.format(sel=f"SELECT DISTINCT s.studyid FROM {_REPRO_JOIN}")))
def q_scope_premises_reprocess(spark, sf):
    return datasets.study_premise(_views(spark, sf), _P_REPRO)


# ------------------------------------------------------------------ Q4, Q5, Q7, Q8

@query("distinct_union_all", _with(f"""
SELECT DISTINCT prem_num AS premiseid FROM pb_app_device WHERE chnl_num NOT IN (3, 4)
UNION ALL
SELECT DISTINCT prem_num AS premiseid FROM iee_pb_device
WHERE chnl_num NOT IN (3, 4) AND rcrdr_seq_num IS NOT NULL AND rcrdr_end_date >= TIMESTAMP '{DEVICE_CUTOFF} 00:00:00'"""))
def q_distinct_union_all(spark, sf):
    return datasets.pb_accounts(_views(spark, sf), RunParams(mode="daily", run_date=RUN_DATE, device_cutoff=DEVICE_CUTOFF))


@query("cycle_day_gap", _with("""
SELECT greg_date, cycl_day_num, rltv_greg_mo, greg_days FROM (
  SELECT greg_date, cycl_day_num, CAST(year(greg_date) * 100 + month(greg_date) AS INTEGER) AS rltv_greg_mo,
         CAST(greg_date - lag(greg_date) OVER (PARTITION BY cycl_day_num ORDER BY greg_date) AS INTEGER) AS greg_days
  FROM day) x
WHERE cycl_day_num <> 0 AND cycl_day_num IS NOT NULL"""))
def q_cycle_day_gap(spark, sf):
    from loadgrid.operators.calendar import read_cycle_day
    return read_cycle_day(_views(spark, sf)["day"], None)


@query("cycle_day_on_date", _with(f"""
SELECT greg_date, cycl_day_num, rltv_greg_mo, greg_days FROM (
  SELECT greg_date, cycl_day_num, CAST(year(greg_date) * 100 + month(greg_date) AS INTEGER) AS rltv_greg_mo,
         CAST(greg_date - lag(greg_date) OVER (PARTITION BY cycl_day_num ORDER BY greg_date) AS INTEGER) AS greg_days
  FROM day) x
WHERE greg_date = DATE '{START_DATE}' - INTERVAL 8 DAY AND cycl_day_num <> 0 AND cycl_day_num IS NOT NULL"""))
def q_cycle_day_on_date(spark, sf):
    return datasets.ami_day(_views(spark, sf), RunParams(mode="daily", run_date=RUN_DATE, start_date=START_DATE))


@query("latest_per_key", _with(f"""
SELECT premiseid, accountid, coalesce(ratecode, '68') AS ratecode, wc_dist, customer, account_status, cust_num FROM (
  SELECT apc.install_num AS premiseid, apc.acct_num AS accountid, apc.rate_schd_cd AS ratecode, ai.prem_dstr_cd AS wc_dist,
         apc.full_name AS customer, apc.acct_stat_cd AS account_status, apc.cust_num,
         row_number() OVER (PARTITION BY apc.install_num ORDER BY apc.acct_open_date DESC NULLS FIRST,
                            apc.acct_num ASC NULLS LAST) AS rn
  FROM mv_acct_prem_cust apc
  LEFT JOIN (SELECT install_num, acct_num, prem_dstr_cd FROM account_installation WHERE crnt_row_flag = true) ai
         ON ai.install_num = apc.install_num AND ai.acct_num = apc.acct_num
  WHERE apc.acct_open_date < DATE '{ACCOUNT_CUTOFF}') x
WHERE rn = 1"""))
def q_latest_per_key(spark, sf):
    return datasets.uevcust(_views(spark, sf), RunParams(mode="daily", run_date=ACCOUNT_CUTOFF))


_UEVMADA_SQL = """
SELECT min(strftime(CAST(t.trans_end_dttm AS DATE), '%Y%m')) AS rltv_mo,
       CAST(c.fom - INTERVAL 1 MONTH AS DATE) AS billstart, c.fom AS billstop,
       CAST(sum(CASE WHEN t.energy_unit = 'Wh' THEN t.energy * 0.001 ELSE t.energy END) AS DOUBLE) AS billkwh,
       1 AS avgmonthlykwh, 1 AS num_months_monthlyavg, s.zip AS zipcode, c.greg_date AS bill_date, 0 AS netmeter,
       c.greg_date, max(s.addr) AS streetaddress, 30 AS billdays,
       CAST(sum(CASE WHEN t.energy_unit = 'Wh' THEN t.energy * 0.001 ELSE t.energy END) AS DOUBLE) AS evkwh,
       s.site_id AS uev_site
FROM ev_trans_detail_fact t
JOIN ev_site s ON t.site_pk = s.site_pk AND t.prod_id = s.prod_id AND s.crnt_row_flag = true
JOIN (SELECT greg_date, cal_yr, cal_mo, make_date(cal_yr, cal_mo, 1) AS fom FROM day
      WHERE cycl_day_num = 8 AND cycl_day_num IS NOT NULL {cal_filter}) c
  ON c.fom > CAST(t.trans_end_dttm AS DATE) AND CAST(c.fom - INTERVAL 1 MONTH AS DATE) <= CAST(t.trans_end_dttm AS DATE)
WHERE t.prod_id <> 3
GROUP BY t.acct_num, s.site_id, c.fom, s.zip, c.greg_date, c.cal_yr, c.cal_mo"""


@query("month_join", _with(_UEVMADA_SQL.format(cal_filter=f"AND CAST(strftime(greg_date - INTERVAL 1 MONTH, '%Y%m') AS INTEGER) = {MONTH}")))
def q_month_join(spark, sf):
    out = datasets.uevmada(_views(spark, sf), RunParams(mode="backdate", month=MONTH, as_of=AS_OF))
    return _dbl(out, "billkwh", "evkwh")


@query("month_join_all_cycles", _with(_UEVMADA_SQL.format(cal_filter="")))
def q_month_join_all(spark, sf):
    out = datasets.uevmada(_views(spark, sf), RunParams(mode="history", month=None, as_of=AS_OF))
    return _dbl(out, "billkwh", "evkwh")


# ------------------------------------------------------------------ Q6 meters, Q10 recorder islands, W11

_CHAIN_SQL = """
g AS (SELECT prem_num, ami_dvc_name, fpl_mtr_num, kwh_csnt, mtr_set_date, min(efct_strt_date) AS min_start,
             max(efct_end_date) AS max_end
      FROM premise_meter WHERE kwh_csnt IS NOT NULL AND ami_dvc_name <> '1' {extra}
      GROUP BY prem_num, ami_dvc_name, fpl_mtr_num, kwh_csnt, mtr_set_date),
w AS (SELECT *,
        lag(mtr_set_date) OVER (PARTITION BY prem_num, mtr_set_date ORDER BY max_end ASC NULLS LAST,
            ami_dvc_name ASC NULLS LAST, fpl_mtr_num ASC NULLS LAST, kwh_csnt ASC NULLS LAST) AS prev,
        lead(mtr_set_date) OVER (PARTITION BY prem_num ORDER BY max_end ASC NULLS LAST, mtr_set_date ASC NULLS LAST,
            ami_dvc_name ASC NULLS LAST, fpl_mtr_num ASC NULLS LAST, kwh_csnt ASC NULLS LAST) AS nxt
      FROM g),
chain AS (SELECT prem_num AS premiseid, ami_dvc_name AS meterid, kwh_csnt AS metermtpl, fpl_mtr_num AS metertype,
                 CASE WHEN (CASE WHEN prev IS NULL THEN mtr_set_date ELSE min_start END) <= mtr_set_date THEN mtr_set_date
                      ELSE (CASE WHEN prev IS NULL THEN mtr_set_date ELSE min_start END) END AS meterstart,
                 CASE WHEN nxt IS NULL THEN max_end ELSE nxt END AS meterstop
          FROM w)"""


@query("interval_chain", _with(_CHAIN_SQL.format(extra="AND prem_num <> 1") + """
SELECT premiseid, meterid, CAST(metermtpl AS DOUBLE) AS metermtpl, metertype, meterstart, meterstop FROM chain"""))
def q_interval_chain(spark, sf):
    out = datasets.utility_meter_intervals(_views(spark, sf), exclude_premises=(1,))
    return _dbl(out, "metermtpl")


_CHARGERS_SQL = """
chg AS (SELECT s.site_id AS premiseid, cb.charge_box_id AS meterid, cb.charge_point_serial_number AS serial,
               CAST(cb.chrgr_instl_dt AS DATE) AS set_date,
               CAST(min(cb.efct_strt_dttm) AS DATE) AS strt, CAST(max(cb.efct_end_dttm) AS DATE) AS stop
        FROM ev_charge_box cb JOIN ev_site s ON cb.site_pk = s.site_pk AND cb.prod_id = s.prod_id AND s.crnt_row_flag = true
        WHERE {cond}
        GROUP BY s.site_id, cb.charge_box_id, cb.charge_point_serial_number, CAST(cb.chrgr_instl_dt AS DATE))"""


@query("envelope_3branch", _with(
    _CHAIN_SQL.format(extra="AND prem_num <> 1") + ",\n"
    + _CHARGERS_SQL.format(cond="cb.asset_status = 'Asset In-Service' AND cb.sub_comp_cd = 1500").replace("chg AS", "priv AS") + ",\n"
    + _CHARGERS_SQL.format(cond="(cb.asset_status = 'Asset In-Service' OR cb.asset_status IS NULL) AND cb.sub_comp_cd IS NULL").replace("chg AS", "pub AS")
    + """
SELECT CAST(premiseid AS VARCHAR) AS premiseid, meterid, CAST(metermtpl AS DOUBLE) AS metermtpl, metertype, meterstart, meterstop FROM chain
UNION ALL
SELECT premiseid, meterid, CAST(1 AS DOUBLE), 'evmeter', min(CASE WHEN strt >= set_date THEN set_date ELSE strt END), max(stop)
FROM priv GROUP BY premiseid, meterid
UNION ALL
SELECT premiseid, 'uevmeterid', CAST(1 AS DOUBLE), 'uevmeter', min(CASE WHEN strt >= set_date THEN set_date ELSE strt END), max(stop)
FROM pub GROUP BY premiseid"""))
def q_envelope_3branch(spark, sf):
    out = datasets.meters(_views(spark, sf), RunParams(mode="daily", run_date=RUN_DATE, exclude_premises=(1,)))
    return _dbl(out, "metermtpl")


_RECORDER_SQL = f"""
app_ok AS (
  SELECT a.* FROM pb_app_device a
  WHERE a.chnl_num NOT IN (3, 4)
    AND a.rcrdr_id NOT IN (SELECT rcrdr_id FROM iee_pb_device)
    AND (a.prem_num IN (SELECT prem_num FROM iee_pb_device GROUP BY prem_num, rcrdr_seq_num, chnl_num
                        HAVING min(rcrdr_strt_date) > TIMESTAMP '{DEVICE_CUTOFF} 00:00:00')
         OR (a.prem_num NOT IN (SELECT prem_num FROM iee_pb_device)
             AND a.prem_num NOT IN (SELECT prem_num FROM pb_app_device GROUP BY prem_num
                                    HAVING max(efct_end_date) < DATE '{DEVICE_CUTOFF}')))),
dev_rows AS (
  SELECT prem_num, CASE WHEN fpl_mtr_num LIKE 'Q%' OR chnl_num = 2 THEN rcrdr_seq_num * 3 - 1 ELSE rcrdr_seq_num * 3 - 2 END AS seq,
         rcrdr_id, fpl_mtr_num, efct_strt_date, efct_end_date, CAST(mtr_efct_strt_date AS TIMESTAMP) AS mtr_start,
         chnl_num, {{csnt}} AS csnt, 1 AS tbl
  FROM app_ok
  UNION ALL
  SELECT prem_num, CASE WHEN fpl_mtr_num LIKE 'Q%' OR chnl_num = 2 THEN rcrdr_seq_num * 3 - 1 ELSE rcrdr_seq_num * 3 - 2 END,
         rcrdr_id, fpl_mtr_num, CAST(rcrdr_strt_date AS DATE), CAST(rcrdr_end_date AS DATE), rcrdr_strt_date,
         chnl_num, {{csnt}}, 2
  FROM (SELECT *, row_number() OVER (PARTITION BY prem_num, rcrdr_id, rcrdr_seq_num, chnl_num, rcrdr_end_date
                                     ORDER BY rcrdr_strt_date ASC NULLS LAST, etl_batch_id DESC NULLS FIRST) AS rn
        FROM iee_pb_device
        WHERE chnl_num NOT IN (3, 4) {{g_filter}} AND rcrdr_seq_num IS NOT NULL
          AND rcrdr_end_date >= TIMESTAMP '{DEVICE_CUTOFF} 00:00:00') w
  WHERE rn = 1),
ordered AS (
  SELECT r.*,
    row_number() OVER (PARTITION BY prem_num, seq ORDER BY efct_end_date DESC NULLS FIRST, tbl DESC NULLS FIRST,
        rcrdr_id ASC NULLS LAST, fpl_mtr_num ASC NULLS LAST, efct_strt_date ASC NULLS LAST, chnl_num ASC NULLS LAST,
        csnt ASC NULLS LAST) AS end_order,
    row_number() OVER (PARTITION BY prem_num, rcrdr_id, fpl_mtr_num ORDER BY efct_strt_date ASC NULLS LAST,
        seq ASC NULLS LAST, csnt ASC NULLS LAST, efct_end_date ASC NULLS LAST, tbl ASC NULLS LAST, chnl_num ASC NULLS LAST,
        mtr_start ASC NULLS LAST)
    - row_number() OVER (PARTITION BY prem_num, rcrdr_id, fpl_mtr_num, seq, csnt ORDER BY efct_strt_date ASC NULLS LAST,
        seq ASC NULLS LAST, csnt ASC NULLS LAST, efct_end_date ASC NULLS LAST, tbl ASC NULLS LAST, chnl_num ASC NULLS LAST,
        mtr_start ASC NULLS LAST) AS grp
  FROM dev_rows r),
chained AS (
  SELECT *, min(mtr_start) OVER (PARTITION BY prem_num, rcrdr_id, fpl_mtr_num, seq, csnt, grp) AS start_date,
         CASE WHEN end_order = 1 THEN CAST(efct_end_date AS TIMESTAMP)
              ELSE lead(mtr_start) OVER (PARTITION BY prem_num, seq ORDER BY end_order DESC) END AS end_date
  FROM ordered),
recorders AS (
  SELECT prem_num, rcrdr_id, fpl_mtr_num, seq AS channel, chnl_num, csnt, grp, min(start_date) AS start_date,
         max(end_date) AS end_date
  FROM chained WHERE start_date <> end_date AND start_date < end_date
  GROUP BY prem_num, rcrdr_id, fpl_mtr_num, seq, chnl_num, csnt, grp
  HAVING max(end_date) >= TIMESTAMP '{DEVICE_CUTOFF} 00:00:00')"""


@query("recorder_islands", _with(_RECORDER_SQL.format(csnt="rgstr_csnt", g_filter="AND rcrdr_id NOT LIKE 'G%'") + """
SELECT prem_num, rcrdr_id, fpl_mtr_num, channel, chnl_num, CAST(csnt AS DOUBLE) AS csnt, grp, start_date, end_date
FROM recorders"""))
def q_recorder_islands(spark, sf):
    p = RunParams(mode="daily", run_date=RUN_DATE, device_cutoff=DEVICE_CUTOFF)
    return _dbl(datasets.recorder_intervals(_views(spark, sf), p, "rgstr_csnt", drop_g_recorders=True), "csnt")


@query("flag_rewrite", _with(_RECORDER_SQL.split("dev_rows AS")[0].rstrip().rstrip(",") + """
SELECT prem_num, rcrdr_id, fpl_mtr_num, efct_strt_date, efct_end_date, chnl_num FROM app_ok"""))
def q_flag_rewrite(spark, sf):
    p = RunParams(mode="daily", run_date=RUN_DATE, device_cutoff=DEVICE_CUTOFF)
    return datasets.app_device_rows(_views(spark, sf), p).select("prem_num", "rcrdr_id", "fpl_mtr_num", "efct_strt_date", "efct_end_date", "chnl_num")


@query("device_dedupe", """
SELECT event_id, user_id, event_type, day, ts, value FROM (
  SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, ts, value,
         row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)
                            ORDER BY ts ASC NULLS LAST, event_id DESC NULLS FIRST) AS rn
  FROM events) x
WHERE rn = 1""")
def q_device_dedupe(spark, sf):
    from loadgrid.operators import dedupe
    e = _t(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    top = dedupe.earliest_then_newest_load(e, ["user_id", "event_type", "day"], "ts", "event_id")
    return top.select("event_id", "user_id", "event_type", "day", "ts", "value")


# ------------------------------------------------------------------ reads: sources, units, ids, scaling, intervals

_SOURCES = (("purchase", "1_IEE"), ("click", "2_APP"), ("view", "3_SG"), ("signup", "4_MV90"), ("error", "5_TMS"))


@query("priority_dedupe", """
WITH f AS (
  SELECT '1_IEE' AS src, CASE WHEN regexp_matches(rid, '[A-Za-z]') THEN substring(rid, 3) ELSE rid END AS rcrdr_id,
         read_end_time, mrdg FROM (
    SELECT 'AM' || CAST(user_id AS VARCHAR) AS rid, date_trunc('hour', ts) + INTERVAL 1 HOUR AS read_end_time,
           CAST(floor(value / 5) AS DECIMAL(18,2)) AS mrdg,
           CASE WHEN value > 300 THEN 'POWER_FAIL' WHEN value < 10 THEN 'IRREGULAR' ELSE 'OK' END AS stat_code
    FROM events WHERE event_type = 'purchase') x
  WHERE stat_code NOT LIKE '%POWER_FAIL%' AND NOT (stat_code LIKE '%IRREGULAR%' AND mrdg = 0)
  UNION ALL
  SELECT '2_APP', CAST(user_id AS VARCHAR), date_trunc('hour', ts) + INTERVAL 1 HOUR, CAST(floor(value / 5) AS DECIMAL(18,2))
  FROM events WHERE event_type = 'click'
  UNION ALL
  SELECT '3_SG', CASE WHEN regexp_matches(rid, '[A-Za-z]') THEN substring(rid, 3) ELSE rid END, read_end_time, mrdg FROM (
    SELECT 'SG' || CAST(user_id AS VARCHAR) AS rid, date_trunc('hour', ts) + INTERVAL 1 HOUR AS read_end_time,
           CAST(floor(value / 5) AS DECIMAL(18,2)) AS mrdg,
           CASE WHEN value > 300 THEN 'Skipped' WHEN value < 10 THEN 'Partial' ELSE NULL END AS flag
    FROM events WHERE event_type = 'view') x
  WHERE coalesce(flag, '') NOT LIKE '%Skipped%' AND NOT (coalesce(flag, '') LIKE '%Partial%' AND mrdg = 0)
  UNION ALL
  SELECT '4_MV90', rid, read_end_time, mrdg FROM (
    SELECT CAST(user_id AS VARCHAR) AS rid, date_trunc('hour', ts) + INTERVAL 1 HOUR AS read_end_time,
           CAST(floor(value / 5) AS DECIMAL(18,2)) AS mrdg,
           CASE WHEN value > 300 THEN 'PO' WHEN value < 10 THEN 'E' ELSE NULL END AS itvl_stat
    FROM events WHERE event_type = 'signup') x
  WHERE coalesce(itvl_stat, '') <> 'PO' AND NOT (itvl_stat IS NOT NULL AND mrdg = 0)
  UNION ALL
  SELECT '5_TMS', CAST(user_id AS VARCHAR), date_trunc('hour', ts) + INTERVAL 1 HOUR, CAST(floor(value / 5) AS DECIMAL(18,2))
  FROM events WHERE event_type = 'error'),
s AS (SELECT src, rcrdr_id, read_end_time - INTERVAL 15 MINUTE AS read_start_time, mrdg FROM f)
SELECT rcrdr_id, date_for, src, CAST(mrdg AS DOUBLE) AS kwh FROM (
  SELECT rcrdr_id, CAST(read_start_time AS DATE) AS date_for, src, mrdg,
         row_number() OVER (PARTITION BY rcrdr_id, CAST(read_start_time AS DATE) ORDER BY src ASC NULLS LAST, mrdg ASC NULLS LAST) AS rn
  FROM s) y
WHERE rn = 1""")
def q_priority_dedupe(spark, sf):
    from loadgrid.functions import predicates as P
    from loadgrid.functions.columns import minutes_before, strip_id_prefix
    from loadgrid.operators import dedupe
    v, kind = F.col("value"), F.col("event_type")
    reading = F.floor(v / 5).cast("decimal(18,2)")
    # One scan: the source is a tag of the row, and so is the filter that applies to it.
    status = F.when(v > 300, "POWER_FAIL").when(v < 10, "IRREGULAR").otherwise("OK")
    flag = F.when(v > 300, "Skipped").when(v < 10, "Partial")
    itvl = F.when(v > 300, "PO").when(v < 10, "E")
    good = (F.when(kind == "purchase", P.status_ok(status, reading)).when(kind == "view", P.channel_flag_ok(flag, reading))
            .when(kind == "signup", P.interval_status_ok(itvl, reading)).otherwise(F.lit(True)))
    src = None
    for k, tag in _SOURCES:
        src = F.when(kind == k, tag) if src is None else src.when(kind == k, tag)
    prefix = F.when(kind == "purchase", "AM").when(kind == "view", "SG").otherwise("")
    f = _t(spark, sf, "events").where(kind.isin(*[k for k, _ in _SOURCES]) & good).select(
        src.alias("src"), strip_id_prefix(F.concat(prefix, F.col("user_id").cast("string"))).alias("rcrdr_id"), reading.alias("mrdg"),
        minutes_before(F.date_trunc("hour", "ts") + F.expr("INTERVAL 1 HOUR")).cast("date").alias("date_for"))
    best = dedupe.priority_dedupe(f, ["rcrdr_id", "date_for"], "src", "mrdg")
    return best.select("rcrdr_id", "date_for", "src", F.col("mrdg").cast("double").alias("kwh"))


_UNITS_CTE = """
u AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, CAST(l_extendedprice AS DECIMAL(18,2)) AS energy,
             CASE WHEN l_returnflag = 'R' THEN 'Wh' WHEN l_returnflag = 'A' THEN 'wh' ELSE 'kWh' END AS uom
      FROM lineitem)"""


def _units(spark, sf):
    l = _t(spark, sf, "lineitem")
    return l.select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"),
                    F.col("l_extendedprice").cast("decimal(18,2)").alias("energy"),
                    F.when(F.col("l_returnflag") == "R", "Wh").when(F.col("l_returnflag") == "A", "wh").otherwise("kWh").alias("uom"))


@query("unit_sum_pre", "WITH " + _UNITS_CTE.strip() + """
SELECT l_suppkey, day, CAST(sum(CASE WHEN lower(uom) = 'wh' THEN round(energy, 4) * 0.001 ELSE round(energy, 4) END) AS DOUBLE) AS kwh
FROM u GROUP BY l_suppkey, day
HAVING sum(CASE WHEN lower(uom) = 'wh' THEN round(energy, 4) * 0.001 ELSE round(energy, 4) END) < 60000""")
def q_unit_sum_pre(spark, sf):
    from loadgrid.operators import units
    out = units.sum_kwh_before(_units(spark, sf), ["l_suppkey", "day"], "energy", "uom", round_each=4,
                               case_insensitive=True, below=60000)
    return _dbl(out, "kwh")


@query("unit_sum_post", "WITH " + _UNITS_CTE.strip() + """
SELECT * FROM (
  SELECT l_suppkey, day, uom,
         CASE WHEN lower(uom) = 'wh' THEN CAST(CAST(round(sum(energy), 4) AS DECIMAL(24,4)) * 0.001 AS DOUBLE)
              ELSE CAST(round(sum(energy), 4) AS DOUBLE) END AS kwh
  FROM u GROUP BY l_suppkey, day, uom) x
WHERE kwh < 60000""")
def q_unit_sum_post(spark, sf):
    from loadgrid.operators import units
    out = units.sum_kwh_after(_units(spark, sf), ["l_suppkey", "day", "uom"], "energy", "uom", below=60000)
    return _dbl(out, "kwh")


@query("id_cleanup", """
SELECT p_partkey,
  CASE WHEN regexp_matches(p_brand, '[A-Za-z]') THEN substring(p_brand, 3) ELSE p_brand END AS brand_id,
  CASE WHEN regexp_matches(p_name, '[A-Za-z]') THEN substring(p_name, 3) ELSE p_name END AS name_id,
  CASE WHEN regexp_matches(CAST(p_partkey AS VARCHAR), '[A-Za-z]') THEN substring(CAST(p_partkey AS VARCHAR), 3)
       ELSE CAST(p_partkey AS VARCHAR) END AS key_id,
  CASE WHEN regexp_matches(substring(p_type, 1, 1), '[A-Za-z]') THEN substring(substring(p_type, 1, 1), 3)
       ELSE substring(p_type, 1, 1) END AS short_id,
  CASE WHEN p_type LIKE 'Q%' OR p_size = 2 THEN p_size * 3 - 1 ELSE p_size * 3 - 2 END AS channel
FROM part""")
def q_id_cleanup(spark, sf):
    from loadgrid.functions.columns import channel_number, strip_id_prefix
    p = _t(spark, sf, "part")
    return p.select("p_partkey", strip_id_prefix("p_brand").alias("brand_id"), strip_id_prefix("p_name").alias("name_id"),
                    strip_id_prefix(F.col("p_partkey").cast("string")).alias("key_id"),
                    strip_id_prefix(F.substring("p_type", 1, 1)).alias("short_id"),
                    channel_number("p_type", "p_size", "p_size").alias("channel"))


@query("read_scaling", """
SELECT l_orderkey, l_linenumber,
  CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 4) AS DOUBLE) AS kwh4,
  CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)), 6) AS DOUBLE) AS kwh6,
  l_extendedprice / nullif(l_quantity, 0) AS per_unit
FROM lineitem""")
def q_read_scaling(spark, sf):
    from loadgrid.functions.columns import dec, scaled
    l = _t(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber",
                    scaled(dec("l_quantity", 18, 2), 1 - dec("l_discount", 18, 2), 4).cast("double").alias("kwh4"),
                    scaled(dec("l_extendedprice", 18, 2), dec("l_tax", 18, 2), 6).cast("double").alias("kwh6"),
                    (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("per_unit"))


def _interval_join(spark, sf, closed: bool):
    from loadgrid.operators import intervals
    v = _views(spark, sf)
    iv = datasets.utility_meter_intervals(v)
    o, l = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    reads = l.join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), l["l_orderkey"] == o["o_orderkey"]).select(
        "o_custkey", "o_orderpriority", "l_orderkey", "l_linenumber", "l_quantity",
        F.col("l_shipdate").cast("date").alias("read_date"))
    j = intervals.interval_join(reads, iv, on=[("o_custkey", "premiseid"), ("o_orderpriority", "meterid")],
                                at="read_date", start="meterstart", stop="meterstop", closed=closed)
    return j.select("premiseid", "meterid", "metertype", "l_orderkey", "l_linenumber", "read_date",
                    F.round(F.col("l_quantity").cast("decimal(18,2)") * F.col("metermtpl"), 4).cast("double").alias("kwh"))


_IJ_SQL = _CHAIN_SQL.format(extra="") + """,
reads AS (SELECT o_custkey, o_orderpriority, l_orderkey, l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS read_date
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c.premiseid, c.meterid, c.metertype, r.l_orderkey, r.l_linenumber, r.read_date,
       CAST(round(CAST(r.l_quantity AS DECIMAL(18,2)) * c.metermtpl, 4) AS DOUBLE) AS kwh
FROM reads r JOIN chain c ON r.o_custkey = c.premiseid AND r.o_orderpriority = c.meterid
 AND c.meterstart <= r.read_date AND {upper}"""


@query("interval_join_halfopen", _with(_IJ_SQL.format(upper="c.meterstop > r.read_date")))
def q_interval_join_halfopen(spark, sf):
    return _interval_join(spark, sf, closed=False)


@query("interval_join_closed", _with(_IJ_SQL.format(upper="c.meterstop >= r.read_date")))
def q_interval_join_closed(spark, sf):
    return _interval_join(spark, sf, closed=True)


@query("sst_series", """
SELECT user_id AS premiseid, 'XXXXXXX' AS metertype, date_trunc('hour', ts) AS read_start_time,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS kwh, 'SST' AS meterid, 629 AS channel, 'kwh' AS uom, 60 AS spi
FROM events WHERE event_type IN ('purchase', 'view')
GROUP BY user_id, date_trunc('hour', ts)""")
def q_sst_series(spark, sf):
    e = _t(spark, sf, "events").where(F.col("event_type").isin("purchase", "view"))
    g = e.groupBy("user_id", F.date_trunc("hour", "ts").alias("read_start_time")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("kwh"))
    return g.select(F.col("user_id").alias("premiseid"), F.lit("XXXXXXX").alias("metertype"), "read_start_time",
                    F.col("kwh").cast("double"), F.lit("SST").alias("meterid"), F.lit(629).alias("channel"),
                    F.lit("kwh").alias("uom"), F.lit(60).alias("spi"))


@query("sst_intervals", _with(_CHAIN_SQL.format(extra="") + """
SELECT CAST(premiseid AS BIGINT) AS premiseid, meterid, CAST(meterstart AS TIMESTAMP) AS meterstart,
       CAST(meterstop AS TIMESTAMP) AS meterstop FROM chain
UNION ALL
SELECT user_id, 'SST', min(ts), TIMESTAMP '9999-12-31 00:00:00' FROM events GROUP BY user_id"""))
def q_sst_intervals(spark, sf):
    from loadgrid.functions.columns import OPEN_END_TS, lit_ts
    from loadgrid.operators import setops
    iv = datasets.utility_meter_intervals(_views(spark, sf)).select(
        F.col("premiseid").cast("long"), "meterid", F.col("meterstart").cast("timestamp_ntz"), F.col("meterstop").cast("timestamp_ntz"))
    sst = _t(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("meterstart")).select(
        F.col("user_id").alias("premiseid"), F.lit("SST").alias("meterid"), "meterstart", lit_ts(OPEN_END_TS).alias("meterstop"))
    return setops.union_all(iv, sst)


# ------------------------------------------------------------------ time series and DST (events shifted into the fall-back)

SHIFT_DAYS = 300
FALL_BACK_DAY = dt.date(2024, 11, 3)
ZONE = "America/New_York"
_WALL = "((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


def _utc_sql(wall: str) -> str:
    return f"(({wall}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'"


_SHIFTED = f"ev AS (SELECT event_id, ts + INTERVAL {SHIFT_DAYS} DAY AS ts, user_id, event_type, value FROM events)"


def _shifted(spark, sf, day: dt.date | None = None):
    """Events moved by SHIFT_DAYS; with ``day`` bounded on the unshifted column, so that the bound reaches the scan."""
    e = _t(spark, sf, "events")
    if day is not None:
        from loadgrid.operators.timeseries import day_start_utc
        shift = F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")
        d = F.lit(str(day)).cast("date")
        e = e.where((F.col("ts") >= day_start_utc(d, ZONE) - shift) & (F.col("ts") < day_start_utc(F.date_add(d, 1), ZONE) - shift))
    return e.select("event_id", (F.col("ts") + F.expr(f"INTERVAL {SHIFT_DAYS} DAYS")).alias("ts"), "user_id", "event_type", "value")


def _expected_sql(day: str) -> str:
    return (f"CAST((epoch({_utc_sql(f'CAST({day} + INTERVAL 1 DAY AS TIMESTAMP)')}) - "
            f"epoch({_utc_sql(f'CAST({day} AS TIMESTAMP)')})) / 900 AS INTEGER)")


@query("tz_probe", f"""
WITH {_SHIFTED}
SELECT e.ts AS read_strt_dttm, {_WALL.replace('ts', 'e.ts')} AS eastern_time,
       CAST((epoch(e.ts) - epoch({_WALL.replace('ts', 'e.ts')})) / 3600 AS INTEGER) AS offset_hours,
       e.user_id, e.event_id, n.n_name
FROM ev e JOIN customer c ON e.user_id = c.c_custkey AND c.c_acctbal > 0
JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE e.ts >= {_utc_sql(f"TIMESTAMP '{FALL_BACK_DAY} 00:00:00'")}
  AND e.ts < {_utc_sql(f"TIMESTAMP '{FALL_BACK_DAY + dt.timedelta(days=1)} 00:00:00'")}
ORDER BY e.ts, e.event_id
LIMIT 20""")
def q_tz_probe(spark, sf):
    from loadgrid.functions.columns import wall_time
    from loadgrid.operators.timeseries import local_day_filter, offset_hours
    e = local_day_filter(_shifted(spark, sf), "ts", FALL_BACK_DAY, ZONE)
    c = _t(spark, sf, "customer").where(F.col("c_acctbal") > 0)
    n = _t(spark, sf, "nation")
    j = e.join(c, e["user_id"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    out = j.select(F.col("ts").alias("read_strt_dttm"), wall_time("ts", ZONE).alias("eastern_time"),
                   offset_hours("ts", ZONE).alias("offset_hours"), "user_id", "event_id", "n_name")
    return out.orderBy("read_strt_dttm", "event_id").limit(20)


@query("hour_histogram", f"""
WITH {_SHIFTED}
SELECT date_trunc('hour', {_WALL}) AS hour_local, date_trunc('hour', ts) AS utc_hour, count(*) AS record_count
FROM ev WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY 1, 2""")
def q_hour_histogram(spark, sf):
    from loadgrid.operators.timeseries import hour_histogram
    c = _t(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    e = _shifted(spark, sf).join(c, "user_id", "left_semi")
    return hour_histogram(e, "ts", ZONE)


_COMPLETE_SQL = f"""
WITH {_SHIFTED}, d AS (SELECT CAST({_WALL} AS DATE) AS day, user_id, ts FROM ev {{where}}),
c AS (SELECT day, user_id, count(*) AS interval_count, count(DISTINCT date_trunc('hour', ts)) AS hour_count,
             count(DISTINCT date_trunc('hour', {_WALL})) AS wall_hour_count FROM d GROUP BY day, user_id),
s AS (SELECT user_id, CAST(unnest(generate_series(CAST({{lo}} AS TIMESTAMP), CAST({{hi}} AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM c GROUP BY user_id)
SELECT s.day, s.user_id, coalesce(interval_count, 0) AS interval_count, coalesce(hour_count, 0) AS hour_count,
       coalesce(wall_hour_count, 0) AS wall_hour_count, {_expected_sql('s.day')} AS expected_intervals,
       {_expected_sql('s.day')} - coalesce(interval_count, 0) AS deficit
FROM s LEFT JOIN c ON s.user_id = c.user_id AND s.day = c.day"""


@query("day_completeness", _COMPLETE_SQL.format(where="", lo="min(day)", hi="max(day)"))
def q_day_completeness(spark, sf):
    from loadgrid.operators.timeseries import completeness
    return completeness(_shifted(spark, sf), ["user_id"], "ts", ZONE)


_DAY0, _DAY1 = FALL_BACK_DAY - dt.timedelta(days=2), FALL_BACK_DAY + dt.timedelta(days=2)


@query("day_completeness_range", _COMPLETE_SQL.format(
    where=f"WHERE CAST({_WALL} AS DATE) BETWEEN DATE '{_DAY0}' AND DATE '{_DAY1}'", lo=f"DATE '{_DAY0}'", hi=f"DATE '{_DAY1}'"))
def q_day_completeness_range(spark, sf):
    from loadgrid.operators.timeseries import completeness
    return completeness(_shifted(spark, sf), ["user_id"], "ts", ZONE, first_day=_DAY0, last_day=_DAY1)


@query("date_counts", f"""
WITH {_SHIFTED}, d AS (SELECT CAST({_WALL} AS DATE) AS day, ts FROM ev),
c AS (SELECT day, count(*) AS interval_count, count(DISTINCT date_trunc('hour', ts)) AS hour_count,
             count(DISTINCT date_trunc('hour', {_WALL})) AS wall_hour_count FROM d GROUP BY day)
SELECT *, {_expected_sql('day')} AS expected_intervals, {_expected_sql('day')} - interval_count AS deficit FROM c""")
def q_date_counts(spark, sf):
    from loadgrid.operators.timeseries import completeness
    return completeness(_shifted(spark, sf), [], "ts", ZONE)


def _bucket_sql(t: str) -> str:
    return f"(date_trunc('hour', {t}) + to_minutes(CAST(floor(minute({t}) / 15) * 15 AS INTEGER)))"


@query("ambiguous_hours", f"""
WITH {_SHIFTED}
SELECT {_bucket_sql(_WALL)} AS wall_bucket, count(DISTINCT {_bucket_sql('ts')}) AS n_instants,
       min({_bucket_sql('ts')}) AS first_utc, max({_bucket_sql('ts')}) AS last_utc, count(*) AS n_rows
FROM ev GROUP BY 1 HAVING count(DISTINCT {_bucket_sql('ts')}) > 1""")
def q_ambiguous_hours(spark, sf):
    from loadgrid.operators.timeseries import ambiguous_wall_times
    return ambiguous_wall_times(_shifted(spark, sf), "ts", ZONE)


@query("dst_day_bounds", f"""
WITH {_SHIFTED}
SELECT event_id, user_id, ts, {_WALL} AS wall_time FROM ev
WHERE ts >= {_utc_sql(f"TIMESTAMP '{FALL_BACK_DAY} 00:00:00'")}
  AND ts < {_utc_sql(f"TIMESTAMP '{FALL_BACK_DAY + dt.timedelta(days=1)} 00:00:00'")}""")
def q_dst_day_bounds(spark, sf):
    from loadgrid.functions.columns import wall_time
    from loadgrid.operators.timeseries import local_day_filter
    e = local_day_filter(_shifted(spark, sf, FALL_BACK_DAY), "ts", FALL_BACK_DAY, ZONE)
    return e.select("event_id", "user_id", "ts", wall_time("ts", ZONE).alias("wall_time"))


_GRID_SQL = f"""
WITH {_SHIFTED},
b AS (SELECT user_id, {_bucket_sql('ts')} AS ts, CASE WHEN bool_or(event_type = 'error') AND user_id % 2 = 1 THEN NULL
                  ELSE CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) END AS value,
             bool_or(event_type = 'error') AS bad
      FROM ev GROUP BY user_id, {_bucket_sql('ts')}),
g AS (SELECT user_id, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) AS ts FROM b GROUP BY user_id),
f AS (SELECT g.user_id, g.ts, b.value,
             CASE WHEN b.user_id IS NULL THEN 'I' WHEN b.bad THEN 'B' ELSE 'A' END AS flag
      FROM g LEFT JOIN b ON g.user_id = b.user_id AND g.ts = b.ts)"""


@query("grid_gapfill", _GRID_SQL + """,
n AS (SELECT *,
        last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w1 AS pt,
        last_value(value IGNORE NULLS) OVER w1 AS pv,
        first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w2 AS nt,
        first_value(value IGNORE NULLS) OVER w2 AS nv
      FROM f
      WINDOW w1 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             w2 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, ts, value, flag,
       CASE WHEN value IS NOT NULL THEN value
            ELSE pv + (nv - pv) * CAST(datediff('second', pt, ts) AS DOUBLE) / CAST(datediff('second', pt, nt) AS DOUBLE) END AS filled
FROM n""")
def q_grid_gapfill(spark, sf):
    return _flagged_grid(spark, sf, fill=True)


def _flagged_grid(spark, sf, fill: bool):
    from loadgrid.operators.timeseries import fill_between_readings
    b = _buckets(spark, sf).withColumn("__f", F.when(F.col("bad"), F.lit("B")).otherwise(F.lit("A")))
    out = fill_between_readings(b, ["user_id"], "ts", "value", 15, flag="flag", name="filled", flag_col="__f")
    return out if fill else out.drop("filled")


def _buckets(spark, sf):
    from loadgrid.operators.timeseries import floor_minutes
    e = _shifted(spark, sf)
    b = e.groupBy("user_id", floor_minutes("ts").alias("ts")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"),
        F.max(F.col("event_type") == "error").alias("bad"))
    return b.withColumn("value", F.when(~(F.col("bad") & (F.col("user_id") % 2 == 1)), F.col("value")))


@query("interp_share", _GRID_SQL + f"""
SELECT CAST({_WALL} AS DATE) AS greg_date, user_id,
       round(100.0 * count(*) FILTER (WHERE flag = 'A') / count(*), 4) AS goodintvper,
       round(100.0 * count(*) FILTER (WHERE flag = 'B') / count(*), 4) AS badintvper,
       round(100.0 * count(*) FILTER (WHERE flag = 'I') / count(*), 4) AS interpolper,
       count(*) AS n_intervals
FROM f GROUP BY 1, 2""")
def q_interp_share(spark, sf):
    from loadgrid.operators.timeseries import interval_shares_from_readings
    # Shares need counts only: grid points per (user, local day) are computed from the bounds.
    b = _buckets(spark, sf).withColumn("flag", F.when(F.col("bad"), F.lit("B")).otherwise(F.lit("A")))
    return interval_shares_from_readings(b, ["user_id"], "ts", "flag", 15, ZONE)


_TRIAGE_EXPECTED = (f"CAST((epoch({_utc_sql('CAST(day + INTERVAL 1 DAY AS TIMESTAMP)')}) - "
                    f"epoch({_utc_sql('CAST(day AS TIMESTAMP)')})) / 3600 AS INTEGER)")
_TRIAGE_SQL = f"""
WITH {_SHIFTED},
h AS (SELECT user_id % 3 AS grp, CAST({_WALL} AS DATE) AS day, date_trunc('hour', ts) AS h, date_trunc('hour', {_WALL}) AS wh,
             event_type <> 'error' OR user_id % 3 = 0 AS p, (event_type <> 'error' AND value < 400) OR user_id % 3 < 2 AS o FROM ev),
t AS (SELECT grp, day, count(DISTINCT h) AS source_hours, count(DISTINCT CASE WHEN p THEN h END) AS processed_hours,
             count(DISTINCT CASE WHEN p THEN wh END) AS processed_wall,
             count(DISTINCT CASE WHEN p AND o THEN {{hour}} END) AS output_hours FROM h GROUP BY grp, day)
SELECT grp, day, source_hours, processed_hours, output_hours, {_TRIAGE_EXPECTED} AS expected_hours,
       CASE WHEN source_hours < {_TRIAGE_EXPECTED} THEN 'upstream' WHEN processed_hours < source_hours THEN 'processing'
            WHEN output_hours < {{before}} THEN 'output' ELSE 'ok' END AS verdict
FROM t"""


def _stages(spark, sf):
    e = _shifted(spark, sf).withColumn("grp", F.col("user_id") % 3)
    processed = e.where((F.col("event_type") != "error") | (F.col("grp") == 0))
    return e, processed, processed.where(((F.col("event_type") != "error") & (F.col("value") < 400)) | (F.col("grp") < 2))


@query("stage_triage", _TRIAGE_SQL.format(hour="h", before="processed_hours"))
def q_stage_triage(spark, sf):
    from loadgrid.operators.timeseries import stage_triage
    return stage_triage(*_stages(spark, sf), "ts", ZONE, keys=["grp"])


@query("stage_triage_wall", _TRIAGE_SQL.format(hour="wh", before="processed_wall"))
def q_stage_triage_wall(spark, sf):
    from loadgrid.functions.columns import wall_time
    from loadgrid.operators.timeseries import stage_triage
    e, processed, output = _stages(spark, sf)
    return stage_triage(e, processed, output.select("grp", wall_time("ts", ZONE).alias("wall")), "ts", ZONE, keys=["grp"], output_wall="wall")


# ------------------------------------------------------------------ audit gate, monthly average

@query("audit_gate", """
WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS audit_id, c_mktsegment AS etl_process_detail_id,
                  CASE WHEN o_orderpriority = '1-URGENT' THEN 'target-write' ELSE 'transform' END AS step,
                  CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'success' END AS etl_process_status
           FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT audit_id, etl_process_detail_id, count(*) AS n_rows, count(*) FILTER (WHERE step = 'target-write') AS target_writes,
             count(*) FILTER (WHERE etl_process_status = 'error') AS errors FROM a GROUP BY 1, 2),
r AS (SELECT CAST(c_custkey AS VARCHAR) AS audit_id, c_mktsegment AS etl_process_detail_id,
             CAST(c_custkey % 4 + 1 AS INTEGER) AS expected_steps FROM customer)
SELECT r.audit_id, r.etl_process_detail_id, r.expected_steps, coalesce(n_rows, 0) AS n_rows, coalesce(target_writes, 0) AS target_writes,
       coalesce(errors, 0) AS errors,
       CASE WHEN n_rows IS NULL THEN 'ED125' WHEN target_writes <> expected_steps THEN 'ED124' WHEN errors > 0 THEN 'ED126' ELSE 'PASS' END AS status_code
FROM r LEFT JOIN g ON r.audit_id = g.audit_id AND r.etl_process_detail_id = g.etl_process_detail_id""")
def q_audit_gate(spark, sf):
    from loadgrid.operators.audit import audit_gate
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    a = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_custkey").cast("string").alias("audit_id"), F.col("c_mktsegment").alias("etl_process_detail_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "target-write").otherwise("transform").alias("step"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("success").alias("etl_process_status"))
    runs = c.select(F.col("c_custkey").cast("string").alias("audit_id"), F.col("c_mktsegment").alias("etl_process_detail_id"),
                    (F.col("c_custkey") % 4 + 1).cast("int").alias("expected_steps"))
    return audit_gate(runs, a, expected_steps="expected_steps")


@query("last_n_periods", """
WITH bills AS (SELECT o_custkey AS prem_num, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS rltv_mo,
                      CAST(day(o_orderdate) + 20 AS INTEGER) AS service_days, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1.25 AS DECIMAL(18,4)) AS total_kwh
               FROM orders),
m AS (SELECT prem_num, rltv_mo, service_days, sum(total_kwh) AS total_kwh,
             dense_rank() OVER (PARTITION BY prem_num ORDER BY rltv_mo DESC NULLS FIRST) AS seq_num
      FROM bills GROUP BY prem_num, rltv_mo, service_days)
SELECT prem_num,
       CAST((2 * CAST(sum(total_kwh) * 10000 AS HUGEINT) * 30 + sum(service_days)) // (2 * sum(service_days)) AS DOUBLE)
         / 10000 AS avgmonthlykwh,
       count(DISTINCT rltv_mo) AS num_months_monthlyavg
FROM m WHERE seq_num <= 6 GROUP BY prem_num""")
def q_last_n_periods(spark, sf):
    o = _t(spark, sf, "orders")
    bills = o.select(F.col("o_custkey").alias("prem_num"), month_key("o_orderdate").alias("rltv_mo"),
                     (F.dayofmonth("o_orderdate") + 20).alias("service_days"),
                     (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(Decimal("1.25"))).cast("decimal(18,4)").alias("total_kwh"))
    return _dbl(datasets.monthly_average(bills, 6), "avgmonthlykwh")


@query("islands", """
WITH r AS (
  SELECT user_id, event_type, ts, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
         - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS grp
  FROM events)
SELECT user_id, event_type, grp, min(ts) AS island_start, max(ts) AS island_end, count(*) AS n_events,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
FROM r GROUP BY user_id, event_type, grp
HAVING min(ts) < max(ts)""")
def q_islands(spark, sf):
    from loadgrid.operators import intervals
    e = _t(spark, sf, "events")
    g = intervals.islands(e, ["user_id"], ["event_type"], [F.col("ts").asc(), F.col("event_id").asc()],
                          bucket=F.to_date("ts"))
    out = g.groupBy("user_id", "event_type", "grp").agg(
        F.min("ts").alias("island_start"), F.max("ts").alias("island_end"), F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"))
    return out.where(F.col("island_start") < F.col("island_end")).withColumn("grp", F.col("grp").cast("long"))


# ------------------------------------------------------------------ Q9 bill enrichment

BILL_MONTH = 199806


def _bill_views(spark, sf):
    o, c, l = _t(spark, sf, "orders"), _t(spark, sf, "customer"), _t(spark, sf, "lineitem")
    od = F.col("o_orderdate").cast("date")
    acct = F.concat(F.lit("A"), F.col("o_custkey").cast("string"))
    bdf = o.select(month_key("o_orderdate").alias("rltv_mo"), acct.alias("cust_acct_num"), F.col("o_custkey").alias("prem_num"),
                   F.date_sub(od, 30).alias("rdg_from_date"), od.alias("rdg_to_date"),
                   (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(Decimal("1.25"))).cast("decimal(18,4)").alias("total_kwh"),
                   F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("rate_schd_cd"),
                   F.col("o_custkey").cast("string").alias("cust_num"), F.date_add(od, 3).alias("bill_date"),
                   (F.dayofmonth(od) + 20).alias("service_days"),
                   F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("decimal(18,2)"))
                    .otherwise((F.col("o_totalprice") / 100).cast("decimal(18,2)")).alias("ev_on_peak_kwh"),
                   F.lit(1).cast("decimal(18,2)").alias("ev_off_peak_kwh"),
                   F.when(F.col("o_orderpriority") == "5-LOW", F.lit(1)).otherwise(F.lit(2)).alias("debit_stat_cd"),
                   F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("1091")).otherwise(F.lit("1000")).alias("bus_cd"))
    nm = o.select(
        F.col("o_custkey").alias("prem_num"), od.alias("stat_date"),
        F.when(F.col("o_orderstatus") == "F", F.lit("Completed")).otherwise(F.lit("Pending")).alias("stat_name"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(1500)).otherwise(F.lit(1600)).alias("cd_sub_cmpny"))
    prem = c.select(F.col("c_custkey").alias("prem_num"), F.col("c_nationkey").cast("string").alias("prem_zip_cd"),
                    F.lit("1900-01-01 00:00:00").cast("timestamp_ntz").alias("efct_strt_dttm"),
                    F.when(F.col("c_acctbal") < 0, F.lit("1998-01-01 00:00:00")).otherwise(F.lit("9999-12-31 00:00:00"))
                     .cast("timestamp_ntz").alias("efct_end_dttm"),
                    (F.col("c_mktsegment") == "HOUSEHOLD").alias("rmv_flag"))
    lo = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    bf = lo.groupBy("o_custkey", F.col("l_shipdate").cast("date").alias("bill_date")).agg(
        F.min("l_linestatus").alias("acct_stat_cd"), F.max("l_returnflag").alias("rate_schd_cd"),
        F.min("l_suppkey").alias("s"), F.max("l_linestatus").alias("n2"), F.count(F.lit(1)).alias("n"),
        F.max("l_partkey").alias("pk"))
    bf = bf.select(F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("cust_acct_num"), F.col("o_custkey").alias("prem_num"),
                   month_key("bill_date").alias("rltv_mo"), "bill_date", "acct_stat_cd", "rate_schd_cd",
                   F.concat(F.lit("N"), F.col("s").cast("string")).alias("cust_name_1"),
                   F.when(F.col("n2") == "O", F.lit(None).cast("string")).otherwise(F.col("n2")).alias("cust_name_2"),
                   F.col("n").cast("string").alias("dstr_cd"), F.concat(F.lit("P"), F.col("pk").cast("string")).alias("prem_addr"))
    return {"bill_detail_fact": bdf, "net_meter_application": nm, "premise": prem, "billing_fact": bf}


_BILL_SQL = f"""
WITH bill_detail_fact AS (
  SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS rltv_mo, 'A' || CAST(o_custkey AS VARCHAR) AS cust_acct_num,
         o_custkey AS prem_num, CAST(CAST(o_orderdate AS DATE) - INTERVAL 30 DAY AS DATE) AS rdg_from_date,
         CAST(o_orderdate AS DATE) AS rdg_to_date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 1.25 AS DECIMAL(18,4)) AS total_kwh,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS rate_schd_cd, CAST(o_custkey AS VARCHAR) AS cust_num,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 DAY AS DATE) AS bill_date, CAST(day(o_orderdate) + 20 AS INTEGER) AS service_days,
         CASE WHEN o_orderstatus = 'O' THEN NULL ELSE CAST(o_totalprice / 100 AS DECIMAL(18,2)) END AS ev_on_peak_kwh,
         CAST(1 AS DECIMAL(18,2)) AS ev_off_peak_kwh,
         CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END AS debit_stat_cd,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '1091' ELSE '1000' END AS bus_cd
  FROM orders),
net_meter_application AS (
  SELECT o_custkey AS prem_num, CAST(o_orderdate AS DATE) AS stat_date,
         CASE WHEN o_orderstatus = 'F' THEN 'Completed' ELSE 'Pending' END AS stat_name,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 1500 ELSE 1600 END AS cd_sub_cmpny
  FROM orders),
premise AS (
  SELECT c_custkey AS prem_num, CAST(c_nationkey AS VARCHAR) AS prem_zip_cd, TIMESTAMP '1900-01-01 00:00:00' AS efct_strt_dttm,
         CASE WHEN c_acctbal < 0 THEN TIMESTAMP '1998-01-01 00:00:00' ELSE TIMESTAMP '9999-12-31 00:00:00' END AS efct_end_dttm,
         c_mktsegment = 'HOUSEHOLD' AS rmv_flag
  FROM customer),
billing_fact AS (
  SELECT 'A' || CAST(o_custkey AS VARCHAR) AS cust_acct_num, o_custkey AS prem_num,
         CAST(year(bill_date) * 100 + month(bill_date) AS INTEGER) AS rltv_mo, bill_date, acct_stat_cd, rate_schd_cd,
         'N' || CAST(s AS VARCHAR) AS cust_name_1, CASE WHEN n2 = 'O' THEN NULL ELSE n2 END AS cust_name_2,
         CAST(n AS VARCHAR) AS dstr_cd, 'P' || CAST(pk AS VARCHAR) AS prem_addr
  FROM (SELECT o_custkey, CAST(l_shipdate AS DATE) AS bill_date, min(l_linestatus) AS acct_stat_cd, max(l_returnflag) AS rate_schd_cd,
               min(l_suppkey) AS s, max(l_linestatus) AS n2, count(*) AS n, max(l_partkey) AS pk
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, CAST(l_shipdate AS DATE)) g),
usable AS (SELECT * FROM bill_detail_fact WHERE debit_stat_cd = 2 AND service_days > 0 AND rdg_from_date IS NOT NULL
           AND rdg_to_date IS NOT NULL),
base AS (SELECT * FROM usable WHERE bill_date >= DATE '1998-06-01' AND bill_date < DATE '1998-07-15' AND rltv_mo = {BILL_MONTH}
         AND rdg_from_date >= DATE '1998-01-01' AND rdg_to_date < DATE '1998-12-31'
         AND bill_date < DATE '{AS_OF}' - INTERVAL 8 DAY AND bus_cd NOT IN ('1091', '1092', '1093')),
m AS (SELECT prem_num, rltv_mo, service_days, sum(total_kwh) AS total_kwh,
             dense_rank() OVER (PARTITION BY prem_num ORDER BY rltv_mo DESC NULLS FIRST) AS seq_num
      FROM usable WHERE bill_date >= DATE '1997-06-01' AND bill_date < DATE '1998-07-15' AND rltv_mo <= {BILL_MONTH}
      GROUP BY prem_num, rltv_mo, service_days),
amu AS (SELECT prem_num,
               CAST((2 * CAST(sum(total_kwh) * 10000 AS HUGEINT) * 30 + sum(service_days)) // (2 * sum(service_days)) AS DOUBLE)
                 / 10000 AS avgmonthlykwh,
               count(DISTINCT rltv_mo) AS num_months_monthlyavg
        FROM m WHERE seq_num <= 6 GROUP BY prem_num),
bf AS (SELECT * FROM (
         SELECT cust_acct_num, prem_num, rltv_mo, acct_stat_cd AS account_status, rate_schd_cd,
                CASE WHEN cust_name_2 IS NULL THEN cust_name_1 ELSE cust_name_1 || ' ' || cust_name_2 END AS customer,
                dstr_cd AS wc_dist, prem_addr AS streetaddress,
                row_number() OVER (PARTITION BY cust_acct_num, prem_num, rltv_mo ORDER BY bill_date DESC NULLS FIRST) AS rn
         FROM billing_fact) x WHERE rn = 1)
SELECT b.rltv_mo, b.cust_acct_num AS accountid, b.prem_num AS premiseid, b.rdg_from_date AS billstart, b.rdg_to_date AS billstop,
       CAST(b.total_kwh AS DOUBLE) AS billkwh, amu.avgmonthlykwh, amu.num_months_monthlyavg,
       coalesce(b.rate_schd_cd, bf.rate_schd_cd) AS ratecode, bf.wc_dist, bf.customer, bf.account_status, pr.zip_code AS zipcode,
       b.cust_num, b.bill_date, bf.streetaddress, b.service_days AS billdays, coalesce(nm.netmeter, 0) AS netmeter,
       CAST(coalesce(b.ev_on_peak_kwh + b.ev_off_peak_kwh, 0) AS DOUBLE) AS evkwh, b.prem_num AS uev_site
FROM base b
LEFT JOIN (SELECT prem_num, stat_date, 1 AS netmeter FROM net_meter_application WHERE stat_name = 'Completed' AND cd_sub_cmpny = 1500) nm
       ON nm.prem_num = b.prem_num AND nm.stat_date < b.rdg_to_date
LEFT JOIN (SELECT prem_num, prem_zip_cd AS zip_code, efct_strt_dttm, efct_end_dttm FROM premise WHERE rmv_flag = false) pr
       ON pr.prem_num = b.prem_num AND CAST(b.rdg_to_date AS TIMESTAMP) >= pr.efct_strt_dttm AND CAST(b.rdg_to_date AS TIMESTAMP) < pr.efct_end_dttm
LEFT JOIN bf ON bf.cust_acct_num = b.cust_acct_num AND bf.prem_num = b.prem_num AND bf.rltv_mo = b.rltv_mo
LEFT JOIN amu ON amu.prem_num = b.prem_num"""


@query("bill_enriched", _BILL_SQL)
def q_bill_enriched(spark, sf):
    p = RunParams(mode="backdate", month=BILL_MONTH, as_of=AS_OF, bill_start=dt.date(1998, 6, 1), bill_end=dt.date(1998, 7, 15),
                  bill_from_date=dt.date(1998, 1, 1), bill_to_date=dt.date(1998, 12, 31), min_bill_date=dt.date(1997, 6, 1),
                  avg_months=6)
    out = datasets.mada(_bill_views(spark, sf), p)
    return _dbl(out, "billkwh", "avgmonthlykwh", "evkwh")


# ------------------------------------------------------------------ the read datasets (Q10-Q14) over derived read tables

#: January 2024 moved to October 1998: the fall-back day is 1998-10-25 and the devices of lineitem are in service.
READ_SHIFT_DAYS = 9213
READ_FROM, READ_TO = dt.datetime(1990, 1, 1), dt.datetime(2010, 1, 1)
SST_CUTOFF = dt.date(1998, 10, 20)
READ_FALL_BACK = dt.date(1998, 10, 25)

_READ_SQL = f"""
ev AS (SELECT event_id, user_id, event_type, value, CAST(user_id % 50 + 1 AS VARCHAR) AS rid, CAST(event_id % 2 + 1 AS INTEGER) AS chnl,
              date_trunc('hour', ts - INTERVAL {READ_SHIFT_DAYS} DAY) + to_minutes(CAST(event_id % 4 * 15 AS INTEGER)) AS slot,
              CAST(floor(value / 5) AS DECIMAL(18,2)) AS reading FROM events),
iee_pb_duration_read_fact AS (
  SELECT user_id AS prem_num, 'AM' || rid AS ami_dvc_name, chnl AS phys_chnl_num,
         CASE event_id % 3 WHEN 0 THEN '622' WHEN 1 THEN '623' ELSE '1' END AS itvl_chnl_num, slot - INTERVAL 15 MINUTE AS read_start_time,
         slot AS read_end_time, reading AS mrdg, CAST(CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 2 END AS DECIMAL(18,2)) AS pulse_multp,
         CASE WHEN event_id % 11 = 0 THEN 'KVARH' ELSE 'KWH' END AS uom, CASE WHEN event_id % 13 = 0 THEN 'Register' ELSE 'Interval' END AS read_type,
         'Interval' AS channel_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN value > 300 THEN 'POWER_FAIL' WHEN value < 10 THEN 'IRREGULAR' ELSE 'OK' END AS stat_code,
         15 AS itvl_len FROM ev WHERE event_type = 'purchase'),
pb_tms_duration_read_fact AS (SELECT rid AS rcrdr_id, chnl AS phys_chnl_num, slot AS read_end_time, reading AS mrdg_raw_valu, 'kwh' AS uom FROM ev WHERE event_type = 'error'),
pb_duration_read_fact AS (
  SELECT 'SG' || rid AS ami_dvc_name, chnl AS uiq_chnl_num, slot AS read_end_time, reading AS mrdg_raw_valu,
         CASE event_id % 4 WHEN 0 THEN 'KWH (REC)' WHEN 1 THEN 'kwhreceive' WHEN 2 THEN 'KVA' ELSE 'KWH' END AS uom,
         CASE WHEN value > 300 THEN 'Skipped' WHEN value < 10 THEN 'Partial' ELSE NULL END AS read_chnl_flag FROM ev WHERE event_type = 'view'),
pb_app_duration_read_fact AS (SELECT rid AS rcrdr_id, 'M' || rid AS fpl_mtr_num, chnl AS phys_chnl_num, slot AS read_end_time, reading AS mrdg_raw_valu, 'KWH' AS uom
                              FROM ev WHERE event_type = 'click'),
pb_mv90_duration_read_fact AS (
  SELECT rid AS rcrdr_id, 'M' || rid AS fpl_mtr_num, chnl AS phys_chnl_num, slot AS read_end_time, reading AS mrdg_raw_valu, 'KWH' AS uom,
         CASE WHEN value > 300 THEN 'PO' WHEN value < 10 THEN 'E' ELSE NULL END AS itvl_stat FROM ev WHERE event_type = 'signup'),
meter_duration_read_fact AS (
  SELECT 'M' || CAST(user_id AS VARCHAR) AS ami_dvc_name, slot AS read_strt_time, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(value AS DECIMAL(18,4)) END AS mrdg,
         CAST(event_id % 4 + 1 AS INTEGER) AS uiq_chnl_num, CASE event_id % 3 WHEN 0 THEN 'KWH' WHEN 1 THEN 'mywh' ELSE 'KVARH' END AS uom, 900 AS mrdg_drtn_scnd,
         CASE WHEN event_id % 19 = 0 THEN 'Skipped' ELSE NULL END AS read_chnl_flag FROM ev),
ev_read_hist AS (
  SELECT l_suppkey AS site_pk, CASE WHEN l_linenumber = 3 THEN 3 ELSE 1 END AS prod_id, CAST(l_partkey AS VARCHAR) AS charge_box_id, l_linenumber AS connector_id,
         l_shipdate + to_hours(CAST(l_orderkey % 48 AS INTEGER)) AS read_strt_dttm, CAST(CAST(l_quantity AS DECIMAL(18,2)) * 0.1 AS DECIMAL(18,4)) AS mrdg,
         CASE l_returnflag WHEN 'R' THEN 'Wh' WHEN 'A' THEN 'kWh' ELSE 'KWH' END AS uom FROM lineitem),
mm_meter AS (
  SELECT c_custkey AS prem_num, 'M' || CAST(c_custkey AS VARCHAR) AS ami_dvc_name, CASE c_custkey % 3 WHEN 0 THEN 'ABCDEN' WHEN 1 THEN 'ABCDEFG' ELSE 'ABCDENX' END AS fpl_mtr_num,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey % 4 + 1 AS DECIMAL(18,2)) END AS kwh_csnt,
         CAST(DATE '1998-01-01' + CAST(c_custkey % 200 + 250 * k AS INTEGER) AS DATE) AS mtr_set_date, CAST(DATE '1998-01-01' + CAST(c_custkey % 200 + 250 * k AS INTEGER) AS DATE) AS efct_strt_date,
         CAST(DATE '1999-06-30' + CAST(k AS INTEGER) AS DATE) AS efct_end_date FROM customer, range(2) r(k) WHERE k = 0 OR c_custkey % 2 = 0)"""


def _read_views(spark, sf):
    e = _t(spark, sf, "events")
    n = F.col("event_id")
    slot = (F.date_trunc("hour", F.col("ts") - F.expr(f"INTERVAL {READ_SHIFT_DAYS} DAYS")) + F.make_dt_interval(mins=(n % 4 * 15).cast("int"))).alias("slot")
    e = e.select("event_id", "user_id", "event_type", "value", (F.col("user_id") % 50 + 1).cast("string").alias("rid"), (n % 2 + 1).cast("int").alias("chnl"), slot,
                 F.floor(F.col("value") / 5).cast("decimal(18,2)").alias("reading"))
    v = F.col("value")
    of = lambda kind: e.where(F.col("event_type") == kind)
    end, reading = F.col("slot").alias("read_end_time"), F.col("reading").alias("mrdg_raw_valu")
    rid, chnl, mtr = F.col("rid").alias("rcrdr_id"), F.col("chnl").alias("phys_chnl_num"), F.concat(F.lit("M"), F.col("rid")).alias("fpl_mtr_num")
    iee = of("purchase").select(
        F.col("user_id").alias("prem_num"), F.concat(F.lit("AM"), F.col("rid")).alias("ami_dvc_name"), chnl,
        F.when(n % 3 == 0, "622").when(n % 3 == 1, "623").otherwise("1").alias("itvl_chnl_num"), (F.col("slot") - F.expr("INTERVAL 15 MINUTES")).alias("read_start_time"), end,
        F.col("reading").alias("mrdg"), F.when(n % 5 == 0, 0).when(n % 5 == 1, 4).otherwise(2).cast("decimal(18,2)").alias("pulse_multp"),
        F.when(n % 11 == 0, "KVARH").otherwise("KWH").alias("uom"), F.when(n % 13 == 0, "Register").otherwise("Interval").alias("read_type"), F.lit("Interval").alias("channel_type"),
        F.when(n % 7 == 0, F.lit(None)).when(v > 300, "POWER_FAIL").when(v < 10, "IRREGULAR").otherwise("OK").alias("stat_code"), F.lit(15).alias("itvl_len"))
    tms = of("error").select(rid, chnl, end, reading, F.lit("kwh").alias("uom"))
    sg = of("view").select(F.concat(F.lit("SG"), F.col("rid")).alias("ami_dvc_name"), F.col("chnl").alias("uiq_chnl_num"), end, reading,
                           F.when(n % 4 == 0, "KWH (REC)").when(n % 4 == 1, "kwhreceive").when(n % 4 == 2, "KVA").otherwise("KWH").alias("uom"),
                           F.when(v > 300, "Skipped").when(v < 10, "Partial").alias("read_chnl_flag"))
    app = of("click").select(rid, mtr, chnl, end, reading, F.lit("KWH").alias("uom"))
    mv = of("signup").select(rid, mtr, chnl, end, reading, F.lit("KWH").alias("uom"), F.when(v > 300, "PO").when(v < 10, "E").alias("itvl_stat"))
    meter = e.select(F.concat(F.lit("M"), F.col("user_id").cast("string")).alias("ami_dvc_name"), F.col("slot").alias("read_strt_time"),
                     F.when(n % 17 != 0, v.cast("decimal(18,4)")).alias("mrdg"), (n % 4 + 1).cast("int").alias("uiq_chnl_num"),
                     F.when(n % 3 == 0, "KWH").when(n % 3 == 1, "mywh").otherwise("KVARH").alias("uom"), F.lit(900).alias("mrdg_drtn_scnd"),
                     F.when(n % 19 == 0, "Skipped").alias("read_chnl_flag"))
    l = _t(spark, sf, "lineitem")
    hist = l.select(F.col("l_suppkey").alias("site_pk"), F.when(F.col("l_linenumber") == 3, 3).otherwise(1).alias("prod_id"), F.col("l_partkey").cast("string").alias("charge_box_id"),
                    F.col("l_linenumber").alias("connector_id"), (F.col("l_shipdate") + F.make_dt_interval(hours=(F.col("l_orderkey") % 48).cast("int"))).alias("read_strt_dttm"),
                    (F.col("l_quantity").cast("decimal(18,2)") * F.lit(Decimal("0.1"))).cast("decimal(18,4)").alias("mrdg"),
                    F.when(F.col("l_returnflag") == "R", "Wh").when(F.col("l_returnflag") == "A", "kWh").otherwise("KWH").alias("uom"))
    c = _t(spark, sf, "customer").select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    k = F.col("c_custkey")
    c = c.where((F.col("k") == 0) | (k % 2 == 0))
    set_date = F.date_add(F.lit("1998-01-01").cast("date"), (k % 200 + 250 * F.col("k")).cast("int"))
    pm = c.select(k.alias("prem_num"), F.concat(F.lit("M"), k.cast("string")).alias("ami_dvc_name"),
                  F.when(k % 3 == 0, "ABCDEN").when(k % 3 == 1, "ABCDEFG").otherwise("ABCDENX").alias("fpl_mtr_num"),
                  F.when(k % 10 != 0, (k % 4 + 1).cast("decimal(18,2)")).alias("kwh_csnt"), set_date.alias("mtr_set_date"), set_date.alias("efct_strt_date"),
                  F.date_add(F.lit("1999-06-30").cast("date"), F.col("k").cast("int")).alias("efct_end_date"))
    return {**_views(spark, sf), "iee_pb_duration_read_fact": iee, "pb_tms_duration_read_fact": tms, "pb_duration_read_fact": sg, "pb_app_duration_read_fact": app,
            "pb_mv90_duration_read_fact": mv, "meter_duration_read_fact": meter, "ev_read_hist": hist, "premise_meter": pm}


def _read_params(**more) -> RunParams:
    return RunParams(mode="daily", run_date=RUN_DATE, device_cutoff=DEVICE_CUTOFF, sst_cutoff=SST_CUTOFF, fetch_from=READ_FROM, fetch_to=READ_TO, **more)


def _with_reads(sql: str) -> str:
    return "WITH " + VIEWS_SQL.strip() + ",\n" + _READ_SQL.strip() + ",\n" + sql.strip()


def _wall_sql(t: str) -> str:
    return f"(({t} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


_STRIP = "CASE WHEN regexp_matches({0}, '[A-Za-z]') THEN substring({0}, 3) ELSE {0} END"
_WINDOW = f"read_end_time BETWEEN TIMESTAMP '{READ_FROM}' AND TIMESTAMP '{READ_TO}'"
_STATUS = "stat_code NOT LIKE '%POWER_FAIL%' AND NOT (stat_code LIKE '%IRREGULAR%' AND mrdg = 0)"
_COMMERCIAL_SQL = f"""
reads AS (
  SELECT '1_IEE' AS src, {_STRIP.format('ami_dvc_name')} AS rcrdr_id, phys_chnl_num AS chnl_num, read_end_time,
         CAST(mrdg / nullif(pulse_multp, 0) AS DECIMAL(18,6)) AS mrdg, uom
  FROM iee_pb_duration_read_fact WHERE uom IN ('KWH') AND {_WINDOW} AND read_type = 'Interval' AND channel_type = 'Interval' AND {_STATUS}
  UNION ALL SELECT '5_TMS', {_STRIP.format('rcrdr_id')}, phys_chnl_num, read_end_time, mrdg_raw_valu, uom FROM pb_tms_duration_read_fact WHERE upper(uom) = 'KWH' AND {_WINDOW}
  UNION ALL SELECT '3_SG', {_STRIP.format('ami_dvc_name')}, uiq_chnl_num, read_end_time, mrdg_raw_valu, uom FROM pb_duration_read_fact
  WHERE upper(uom) IN ('KWH', 'KWH (RECEIVED)', 'KWH (REC)', 'KWHRECEIVE') AND {_WINDOW}
    AND coalesce(read_chnl_flag, '') NOT LIKE '%Skipped%' AND NOT (coalesce(read_chnl_flag, '') LIKE '%Partial%' AND mrdg_raw_valu = 0)
  UNION ALL SELECT '2_APP', {_STRIP.format('rcrdr_id')}, phys_chnl_num, read_end_time, mrdg_raw_valu, uom FROM pb_app_duration_read_fact WHERE upper(uom) = 'KWH' AND {_WINDOW}
  UNION ALL SELECT '4_MV90', {_STRIP.format('rcrdr_id')}, phys_chnl_num, read_end_time, mrdg_raw_valu, uom FROM pb_mv90_duration_read_fact
  WHERE upper(uom) = 'KWH' AND {_WINDOW} AND coalesce(itvl_stat, '') <> 'PO' AND NOT (itvl_stat IS NOT NULL AND mrdg_raw_valu = 0)),
timed AS (SELECT *, read_end_time - INTERVAL 15 MINUTE AS read_start_time FROM reads),
dated AS (SELECT *, CAST(CAST({_wall_sql('read_start_time')} AS DATE) AS TIMESTAMP) AS date_for FROM timed),
matched AS (SELECT d.prem_num, f.src, f.rcrdr_id, d.fpl_mtr_num, d.channel, round(f.mrdg * d.csnt, 6) AS kwh, f.read_start_time, f.uom
            FROM dated f JOIN recorders d ON d.rcrdr_id = f.rcrdr_id AND d.chnl_num = f.chnl_num AND d.end_date > f.date_for AND d.start_date <= f.date_for),
best AS (SELECT *, row_number() OVER (PARTITION BY rcrdr_id, fpl_mtr_num, channel, read_start_time
                                      ORDER BY src ASC NULLS LAST, kwh ASC NULLS LAST, prem_num ASC NULLS LAST, uom ASC NULLS LAST) AS rn FROM matched)"""
_SST_SQL = f"""SELECT CAST(prem_num AS VARCHAR), 'XXXXXXX', {_wall_sql('read_start_time')}, CAST(sum(mrdg) AS DOUBLE), 'SST', 629, 'kwh', CAST(itvl_len AS INTEGER), read_start_time
FROM iee_pb_duration_read_fact WHERE itvl_chnl_num IN ('622', '623') AND {_WINDOW} AND {_STATUS} GROUP BY prem_num, read_start_time, itvl_len"""


@query("power_billing", _with_reads(_RECORDER_SQL.format(csnt="ke_csnt", g_filter="") + "," + _COMMERCIAL_SQL + f"""
SELECT CAST(prem_num AS VARCHAR) AS premiseid, fpl_mtr_num AS metertype, {_wall_sql('read_start_time')} AS read_strt_time, CAST(kwh AS DOUBLE) AS kwh,
       rcrdr_id AS meterid, CAST(channel AS INTEGER) AS channel, uom, 15 AS spi, read_start_time AS read_ts_utc FROM best WHERE rn = 1
UNION ALL {_SST_SQL}"""))
def q_power_billing(spark, sf):
    return datasets.power_billing(_read_views(spark, sf), _read_params())


@query("meters_pb", _with_reads(_RECORDER_SQL.format(csnt="rgstr_csnt", g_filter="AND rcrdr_id NOT LIKE 'G%'") + f"""
SELECT prem_num AS premiseid, rcrdr_id AS meterid, fpl_mtr_num AS metertype, channel, chnl_num, CAST(csnt AS DOUBLE) AS metermtpl, CAST(grp AS BIGINT) AS grp,
       start_date AS meterstart, end_date AS meterstop FROM recorders
UNION ALL
SELECT prem_num, 'SST', 'XXXXXXX', 629, 1, CAST(1 AS DOUBLE), CAST(0 AS BIGINT), min(read_start_time), TIMESTAMP '9999-12-31 00:00:00'
FROM iee_pb_duration_read_fact WHERE itvl_chnl_num = '622' AND read_end_time >= TIMESTAMP '{SST_CUTOFF} 00:00:00' GROUP BY prem_num"""))
def q_meters_pb(spark, sf):
    return _dbl(datasets.meters_pb(_read_views(spark, sf), _read_params()), "metermtpl")


_EV_JOIN_SQL = f"""
evj AS (SELECT s.site_id, cb.connector_type, r.charge_box_id, r.read_strt_dttm, r.mrdg, r.uom, r.prod_id
        FROM ev_read_hist r JOIN ev_site s ON r.site_pk = s.site_pk AND r.prod_id = s.prod_id AND s.crnt_row_flag = true
        JOIN ev_charge_box cb ON r.charge_box_id = cb.charge_box_id AND cb.connector_id = r.connector_id AND cb.site_pk = r.site_pk
         AND r.read_strt_dttm >= cb.efct_strt_dttm AND r.read_strt_dttm <= cb.efct_end_dttm
        WHERE lower(r.uom) IN ('kwh', 'wh') AND r.read_strt_dttm >= TIMESTAMP '{READ_FROM}' AND r.read_strt_dttm < TIMESTAMP '{READ_TO}' AND r.mrdg >= 0)"""


def _mass_market_sql(channels: str, patterns: str, public: bool, legacy: bool = False, scope: tuple[str, str, str] = ("", "", "")) -> str:
    t = _wall_sql("read_strt_dttm") if legacy else "read_strt_dttm"
    wall = "t" if legacy else _wall_sql("t")
    chain = _CHAIN_SQL.replace("premise_meter", "mm_meter").format(extra=patterns)
    sql = chain + "," + _EV_JOIN_SQL + f""",
evg AS (SELECT site_id, connector_type, {t} AS t, charge_box_id, uom, min(read_strt_dttm) AS first_utc,
               CASE WHEN lower(uom) = 'wh' THEN round(sum(mrdg), 4) * 0.001 ELSE round(sum(mrdg), 4) END AS kwh
        FROM evj {scope[1]} GROUP BY site_id, connector_type, {t}, charge_box_id, uom),
uev AS (SELECT site_id, {t} AS t, min(read_strt_dttm) AS first_utc, sum(CASE WHEN lower(uom) = 'wh' THEN round(mrdg, 4) * 0.001 ELSE round(mrdg, 4) END) AS kwh
        FROM (SELECT * FROM evj {scope[2]}) e WHERE prod_id <> 3 GROUP BY site_id, {t}
        HAVING sum(CASE WHEN lower(uom) = 'wh' THEN round(mrdg, 4) * 0.001 ELSE round(mrdg, 4) END) < 150)
SELECT CAST(c.premiseid AS VARCHAR) AS premiseid, c.metertype, {_wall_sql('m.read_strt_time')} AS read_strt_time, CAST(round(m.mrdg * c.metermtpl, 4) AS DOUBLE) AS kwh,
       m.ami_dvc_name AS meterid, CAST(m.uiq_chnl_num AS INTEGER) AS channel, m.uom, CAST(m.mrdg_drtn_scnd AS INTEGER) AS spi, m.read_strt_time AS read_ts_utc
FROM meter_duration_read_fact m JOIN chain c ON m.ami_dvc_name = c.meterid
 AND c.meterstart <= CAST({_wall_sql('m.read_strt_time')} AS DATE) AND c.meterstop > CAST({_wall_sql('m.read_strt_time')} AS DATE)
WHERE m.read_strt_time >= TIMESTAMP '{READ_FROM}' AND m.read_strt_time < TIMESTAMP '{READ_TO}' AND m.read_chnl_flag IS NULL AND m.mrdg IS NOT NULL AND {channels} {scope[0]}
UNION ALL
SELECT site_id, 'evmeter', {wall}, CAST(kwh AS DOUBLE), charge_box_id, 1000, 'kwh', 15, first_utc FROM evg WHERE kwh < 6"""
    if public:
        sql += f"\nUNION ALL\nSELECT site_id, 'uevmeter', {wall}, CAST(kwh AS DOUBLE), 'uevmeterid', 2000, 'kwh', 15, first_utc FROM uev"
    return _with_reads(sql)


_NM = ("m.uiq_chnl_num IN (2, 4)", "AND (fpl_mtr_num LIKE '%N' OR fpl_mtr_num LIKE '_____N%')", False)
_NOT_NM = ("m.uiq_chnl_num = 1 AND upper(m.uom) IN ('MYWH', 'KWH')", "", True)


@query("mass_market_nm", _mass_market_sql(*_NM))
def q_mass_market_nm(spark, sf):
    return datasets.mass_market_nm(_read_views(spark, sf), _read_params())


@query("mass_market_nm_wall", _mass_market_sql(*_NM, legacy=True))
def q_mass_market_nm_wall(spark, sf):
    return datasets.mass_market_nm(_read_views(spark, sf), _read_params(legacy_wall_time=True))


@query("mass_market_not_nm", _mass_market_sql(*_NOT_NM))
def q_mass_market_not_nm(spark, sf):
    return datasets.mass_market_not_nm(_read_views(spark, sf), _read_params())


@query("ev_time_probe", _with_reads(f"""
p AS (SELECT r.read_strt_dttm, {_wall_sql('r.read_strt_dttm')} AS eastern_time, cb.charge_box_id
      FROM ev_read_hist r JOIN ev_site s ON r.site_pk = s.site_pk AND s.crnt_row_flag = true AND s.site_id = 'SITE91'
      JOIN ev_charge_box cb ON r.charge_box_id = cb.charge_box_id AND cb.connector_id = r.connector_id
      WHERE r.read_strt_dttm >= {_utc_sql(f"TIMESTAMP '{READ_FALL_BACK} 00:00:00'")}
        AND r.read_strt_dttm < {_utc_sql(f"TIMESTAMP '{READ_FALL_BACK + dt.timedelta(days=1)} 00:00:00'")})
SELECT * FROM p ORDER BY read_strt_dttm NULLS LAST, charge_box_id NULLS LAST LIMIT 20"""))
def q_ev_time_probe(spark, sf):
    return datasets.tz_probe(_read_views(spark, sf), "SITE91", READ_FALL_BACK, ZONE)


# ------------------------------------------------------------------ other run modes, scopes, diagnostics' arguments

@query("month_join_daily", _with(_UEVMADA_SQL.format(cal_filter="AND greg_date = DATE '1998-08-08'")))
def q_month_join_daily(spark, sf):
    out = datasets.uevmada(_views(spark, sf), RunParams(mode="daily", run_date=dt.date(1998, 8, 8)))
    return _dbl(out, "billkwh", "evkwh")


@query("latest_per_key_backdate", ORACLE["latest_per_key"])
def q_latest_per_key_backdate(spark, sf):
    return datasets.uevcust(_views(spark, sf), RunParams(mode="backdate", month=MONTH, as_of=AS_OF, bill_to_date=ACCOUNT_CUTOFF))


BILL_DAY = dt.date(1998, 7, 6)
_BASE_DAILY = f"base AS (SELECT * FROM usable WHERE rltv_mo BETWEEN 199806 AND 199808 AND bill_date = DATE '{BILL_DAY}' AND bus_cd NOT IN ('1091', '1092', '1093')),"
_BILL_DAILY_SQL = (_BILL_SQL[:_BILL_SQL.index("base AS (")] + _BASE_DAILY + "\n" + _BILL_SQL[_BILL_SQL.index("m AS (SELECT"):]).replace(
    f"FROM usable WHERE bill_date >= DATE '1997-06-01' AND bill_date < DATE '1998-07-15' AND rltv_mo <= {BILL_MONTH}",
    f"FROM usable WHERE bill_date >= DATE '{AS_OF}' - INTERVAL 60 MONTH")


def _daily_bills(**more) -> RunParams:
    return RunParams(mode="daily", run_date=BILL_DAY, as_of=AS_OF, month_from=199806, month_to=199808, interval_months=60, avg_months=6, **more)


@query("bill_enriched_daily", _BILL_DAILY_SQL)
def q_bill_enriched_daily(spark, sf):
    return _dbl(datasets.mada(_bill_views(spark, sf), _daily_bills()), "billkwh", "avgmonthlykwh", "evkwh")


def _scope(spark, sf, table: str, key: str, name: str, where) -> DataFrame:
    return _t(spark, sf, table).where(where).select(F.col(key).alias(name))


@query("scope_mada", _BILL_DAILY_SQL + "\nWHERE b.prem_num IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_scope_mada(spark, sf):
    keys = _scope(spark, sf, "customer", "c_custkey", "prem_num", F.col("c_mktsegment") == "BUILDING")
    return _dbl(datasets.mada(_bill_views(spark, sf), _daily_bills(scopes=Scopes(mada=keys))), "billkwh", "avgmonthlykwh", "evkwh")


@query("scope_uev", ORACLE["latest_per_key"] + " AND premiseid IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_scope_uev(spark, sf):
    keys = _scope(spark, sf, "customer", "c_custkey", "install_num", F.col("c_mktsegment") == "BUILDING")
    return datasets.uevcust(_views(spark, sf), RunParams(mode="daily", run_date=ACCOUNT_CUTOFF, scopes=Scopes(uev=keys)))


@query("scope_pb", (ORACLE["flag_rewrite"] + " WHERE prem_num IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"))
def q_scope_pb(spark, sf):
    keys = _scope(spark, sf, "supplier", "s_suppkey", "prem_num", F.col("s_acctbal") > 0)
    p = RunParams(mode="daily", run_date=RUN_DATE, device_cutoff=DEVICE_CUTOFF, scopes=Scopes(pb=keys))
    return datasets.app_device_rows(_views(spark, sf), p).select("prem_num", "rcrdr_id", "fpl_mtr_num", "efct_strt_date", "efct_end_date", "chnl_num")


@query("scope_reads", _mass_market_sql(*_NOT_NM, scope=(
    "AND m.ami_dvc_name IN (SELECT 'M' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)",
    "WHERE site_id IN (SELECT 'SITE' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey < 10)",
    "WHERE site_id IN (SELECT 'SITE' || CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey > 15)")))
def q_scope_reads(spark, sf):
    s = _t(spark, sf, "supplier").select("s_nationkey", F.concat(F.lit("SITE"), F.col("s_suppkey").cast("string")).alias("site_id"))
    meters = _t(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.concat(F.lit("M"), F.col("c_custkey").cast("string")).alias("ami_dvc_name"))
    scopes = Scopes(meter=meters, ev=s.where(F.col("s_nationkey") < 10).select("site_id"), uev_site=s.where(F.col("s_nationkey") > 15).select("site_id"))
    return datasets.mass_market_not_nm(_read_views(spark, sf), _read_params(scopes=scopes))


@query("variable", "SELECT r_name AS name, CAST(r_regionkey AS VARCHAR) AS value FROM region")
def q_variable(spark, sf):
    t = {"variable": _t(spark, sf, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("value"))}
    return datasets.variable(t)


@query("hour_histogram_day", f"""
WITH {_SHIFTED}
SELECT date_trunc('hour', {_WALL}) AS hour_local, date_trunc('hour', ts) AS utc_hour, count(*) AS record_count
FROM ev WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND CAST({_WALL} AS DATE) = DATE '{FALL_BACK_DAY}'
GROUP BY 1, 2 ORDER BY 1, 2""")
def q_hour_histogram_day(spark, sf):
    from loadgrid.operators.timeseries import hour_histogram
    c = _t(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    return hour_histogram(_shifted(spark, sf, FALL_BACK_DAY), "ts", ZONE, day=FALL_BACK_DAY, series=c, ordered=True)


@query("interp_share_range", ORACLE["interp_share"].replace("FROM f GROUP BY 1, 2", f"FROM f WHERE CAST({_WALL} AS DATE) BETWEEN DATE '{_DAY0}' AND DATE '{_DAY1}' GROUP BY 1, 2"))
def q_interp_share_range(spark, sf):
    from loadgrid.operators.timeseries import interval_shares_from_readings
    b = _buckets(spark, sf).withColumn("flag", F.when(F.col("bad"), F.lit("B")).otherwise(F.lit("A")))
    return interval_shares_from_readings(b, ["user_id"], "ts", "flag", 15, ZONE, first_day=_DAY0, last_day=_DAY1, ordered=True)


@query("epoch_round_trip", "SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS secs, date_trunc('second', ts) AS back FROM events")
def q_epoch_round_trip(spark, sf):
    from loadgrid.functions.columns import epoch_seconds, from_epoch_seconds
    return _t(spark, sf, "events").select("event_id", epoch_seconds("ts").alias("secs"), from_epoch_seconds(epoch_seconds("ts")).alias("back"))


@query("control_totals", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) AS declared_rows FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1),
l AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS loaded_rows FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1)
SELECT coalesce(d.d, l.d) AS file_date, CAST(declared_rows AS BIGINT) AS declared_rows, loaded_rows, coalesce(declared_rows = loaded_rows, false) AS matches
FROM d FULL JOIN l ON d.d = l.d""")
def q_control_totals(spark, sf):
    from loadgrid.operators.audit import control_totals
    o = _t(spark, sf, "orders").withColumn("file_date", F.col("o_orderdate").cast("date"))
    declared = o.where(F.col("o_orderpriority") != "5-LOW").select("file_date", F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).alias("number_rows"))
    return control_totals(declared, o.where(F.col("o_orderpriority") != "4-NOT SPECIFIED"), "file_date")


@query("positional_read", "SELECT n_nationkey AS c0, n_name AS c1, n_regionkey AS c2 FROM nation")
def q_positional_read(spark, sf):
    from pyspark.sql.types import StructType
    from loadgrid.sources.catalog import unloaded_files
    path = os.path.join(sf, "nation.parquet")
    kinds = {f.name: f for f in spark.read.parquet(path).schema.fields}
    schema = StructType([kinds[c] for c in ("n_nationkey", "n_name", "n_regionkey")])
    return unloaded_files(spark, path, schema, ["c0", "c1", "c2"])
