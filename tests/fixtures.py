"""Utility-schema fixture tables (FIXTURES.md) with the boundary rows each dataset needs."""

import datetime as dt
from decimal import Decimal as Dec

D, T = dt.date, dt.datetime


def tables(spark):
    c = spark.createDataFrame
    t = {}
    t["study"] = c([
        ("S1", True, True, True, None, "F", D(2024, 1, 1), None),            # open end, NULL deleted flag
        ("S2", True, True, True, False, "F", D(2024, 1, 1), D(2025, 11, 2)),  # ends on the run date
        ("S3", True, True, True, False, "F", D(2024, 1, 1), D(2025, 11, 1)),  # ended
        ("UEV4", True, True, True, False, "F", D(2024, 1, 1), None),          # already logged
        ("S5", False, True, True, False, "F", D(2024, 1, 1), None),           # no billing data
    ], "studyid string, billingdata boolean, active_flag boolean, backdated_flag boolean, deleted_flg boolean, "
       "fetchtype string, startdate date, enddate date")
    t["etl_log"] = c([("UEV4", D(2025, 11, 2)), ("S1", D(2025, 11, 1))], "studyid string, greg_date date")
    t["etl_backdated"] = c([("S1", 202510, False), ("S2", 202401, True)], "studyid string, rltv_mo int, complete_flg boolean")
    t["study_to_reprocess"] = c([("S1", 202510, None), ("S1", 202510, None), ("S2", 202510, D(2025, 11, 1))],
                                "studyid string, rltv_mo int, validation_run_date date")
    t["study_premise"] = c([("S1", 10, "FPL", None), ("S2", 11, "GULF", False), ("UEV4", 12, "GULF", False), ("S1", 13, "FPL", True)],
                           "studyid string, premiseid long, company string, deleted_flg boolean")
    t["variable"] = c([("k", "v")], "name string, value string")
    days = [D(2025, 9, 1) + dt.timedelta(days=i) for i in range(120)]
    t["day"] = c([(d, (d.day if d.day <= 21 else 0), d.year, d.month) for d in days],
                 "greg_date date, cycl_day_num int, cal_yr int, cal_mo int")
    # devices: recorder R1 on premise 1 with two islands of channel seq 1 split by seq 2
    t["pb_app_device"] = c([
        (1, "R1", "M1", D(2022, 1, 1), D(2022, 6, 1), 1, D(2022, 1, 1), D(2022, 1, 1), 1, Dec("1.5"), Dec("2.0")),
        (1, "R1", "M1", D(2022, 6, 1), D(2022, 9, 1), 2, D(2022, 6, 1), D(2022, 6, 1), 1, Dec("1.5"), Dec("2.0")),
        (1, "R1", "M1", D(2022, 9, 1), D(2023, 12, 1), 1, D(2022, 9, 1), D(2022, 9, 1), 1, Dec("1.5"), Dec("2.0")),
        (2, "R2", "M2", D(2019, 1, 1), D(2020, 1, 1), 1, D(2019, 1, 1), D(2019, 1, 1), 1, Dec("1"), Dec("1")),   # old premise
        (3, "R9", "M9", D(2022, 1, 1), D(2023, 1, 1), 1, D(2022, 1, 1), D(2022, 1, 1), 1, Dec("1"), Dec("1")),   # recorder in IEE
    ], "prem_num long, rcrdr_id string, fpl_mtr_num string, efct_strt_date date, efct_end_date date, rcrdr_seq_num int, "
       "rcrdr_id_efct_strt_date date, mtr_efct_strt_date date, chnl_num int, rgstr_csnt decimal(18,6), ke_csnt decimal(18,6)")
    t["iee_pb_device"] = c([
        (4, "R9", "Q7", T(2022, 1, 1), T(2023, 6, 1), 1, 1, Dec("3"), Dec("3"), 5),
        (4, "R9", "Q7", T(2022, 2, 1), T(2023, 6, 1), 1, 1, Dec("3"), Dec("3"), 6),   # later start: dropped by W11
        (4, "G5", "Q7", T(2022, 1, 1), T(2023, 6, 1), 1, 1, Dec("3"), Dec("3"), 7),   # G recorder
        (5, "R8", "Q8", T(2022, 1, 1), T(2023, 6, 1), None, 1, Dec("3"), Dec("3"), 8),  # no sequence
    ], "prem_num long, rcrdr_id string, fpl_mtr_num string, rcrdr_strt_date timestamp_ntz, rcrdr_end_date timestamp_ntz, "
       "rcrdr_seq_num int, chnl_num int, rgstr_csnt decimal(18,6), ke_csnt decimal(18,6), etl_batch_id long")
    rd = "prem_num long, ami_dvc_name string, phys_chnl_num int, itvl_chnl_num string, read_start_time timestamp_ntz, " \
         "read_end_time timestamp_ntz, mrdg decimal(18,4), pulse_multp decimal(18,4), uom string, read_type string, " \
         "channel_type string, stat_code string, itvl_len int"
    t["iee_pb_duration_read_fact"] = c([
        (1, "XXR1", 1, "1", T(2022, 10, 1, 0, 0), T(2022, 10, 1, 0, 15), Dec("4"), Dec("2"), "KWH", "Interval", "Interval", "OK", 15),
        (6, "S6", 1, "622", T(2022, 10, 1, 0, 0), T(2022, 10, 1, 0, 15), Dec("1.25"), Dec("1"), "KWH", "Interval", "Interval", "OK", 15),
        (6, "S6", 1, "623", T(2022, 10, 1, 0, 0), T(2022, 10, 1, 0, 15), Dec("2.5"), Dec("1"), "KWH", "Interval", "Interval", "OK", 15),
    ], rd)
    t["pb_tms_duration_read_fact"] = c([("R1", 1, T(2022, 10, 1, 0, 15), Dec("9"), "kwh")],
                                       "rcrdr_id string, phys_chnl_num int, read_end_time timestamp_ntz, mrdg_raw_valu decimal(18,4), uom string")
    t["pb_duration_read_fact"] = c([("ABR1", 1, T(2022, 10, 1, 0, 30), Dec("3"), "KWH (REC)", None)],
                                   "ami_dvc_name string, uiq_chnl_num int, read_end_time timestamp_ntz, mrdg_raw_valu decimal(18,4), "
                                   "uom string, read_chnl_flag string")
    t["pb_app_duration_read_fact"] = c([("R1", "M1", 1, T(2022, 10, 1, 0, 15), Dec("5"), "KWH")],
                                       "rcrdr_id string, fpl_mtr_num string, phys_chnl_num int, read_end_time timestamp_ntz, "
                                       "mrdg_raw_valu decimal(18,4), uom string")
    t["pb_mv90_duration_read_fact"] = c([("R1", "M1", 1, T(2022, 10, 1, 0, 30), Dec("0"), "KWH", "E")],
                                        "rcrdr_id string, fpl_mtr_num string, phys_chnl_num int, read_end_time timestamp_ntz, "
                                        "mrdg_raw_valu decimal(18,4), uom string, itvl_stat string")
    t["premise_meter"] = c([
        (100, "MA", "ABCDEN", Dec("2"), D(2025, 1, 1), D(2025, 1, 1), D(2026, 1, 1)),
        (101, "MB", "PLAIN", Dec("1"), D(2025, 1, 1), D(2025, 1, 1), D(2026, 1, 1)),
        (373190907, "MX", "PLAIN", Dec("1"), D(2025, 1, 1), D(2025, 1, 1), D(2026, 1, 1)),
    ], "prem_num long, ami_dvc_name string, fpl_mtr_num string, kwh_csnt decimal(18,6), mtr_set_date date, "
       "efct_strt_date date, efct_end_date date")
    fall = [T(2025, 11, 2, 4, 0) + dt.timedelta(minutes=15 * i) for i in range(100)]   # the local fall-back day
    t["meter_duration_read_fact"] = c(
        [("MA", ts, Dec("0.5"), 2, "KWH", 900, None) for ts in fall]
        + [("MB", ts, Dec("1.0"), 1, "kwh", 900, None) for ts in fall[:4]],
        "ami_dvc_name string, read_strt_time timestamp_ntz, mrdg decimal(18,4), uiq_chnl_num int, uom string, "
        "mrdg_drtn_scnd int, read_chnl_flag string")
    t["ev_site"] = c([(1, "5730", 1, True, "33101", "1 Main"), (2, "6000", 2, True, "33102", "2 Main")],
                     "site_pk long, site_id string, prod_id int, crnt_row_flag boolean, zip string, addr string")
    t["ev_charge_box"] = c([
        ("CB1", 1, "J1772", "SER1", 1, 1, T(2024, 1, 1), T(2024, 1, 1), T(2026, 1, 1), "Asset In-Service", 1500),
        ("CB2", 1, "J1772", "SER2", 2, 2, T(2024, 1, 1), T(2024, 1, 1), T(2026, 1, 1), None, None),
    ], "charge_box_id string, connector_id int, connector_type string, charge_point_serial_number string, site_pk long, "
       "prod_id int, chrgr_instl_dt timestamp_ntz, efct_strt_dttm timestamp_ntz, efct_end_dttm timestamp_ntz, "
       "asset_status string, sub_comp_cd int")
    # two reads in the two 01:00 wall hours of the fall-back day (05:00 and 06:00 UTC)
    t["ev_read_hist"] = c([
        (1, 1, "CB1", 1, T(2025, 11, 2, 5, 0), Dec("2"), "kWh"), (1, 1, "CB1", 1, T(2025, 11, 2, 6, 0), Dec("3"), "kWh"),
        (2, 2, "CB2", 1, T(2025, 11, 2, 5, 0), Dec("2000"), "Wh"),
    ], "site_pk long, prod_id int, charge_box_id string, connector_id int, read_strt_dttm timestamp_ntz, mrdg decimal(18,4), uom string")
    t["ev_trans_detail_fact"] = c([(1, 1, "A1", T(2025, 10, 15, 10), Dec("1500"), "Wh"), (1, 1, "A1", T(2025, 10, 20), Dec("2"), "kWh"),
                                   (1, 3, "A1", T(2025, 10, 20), Dec("7"), "kWh")],
                                  "site_pk long, prod_id int, acct_num string, trans_end_dttm timestamp_ntz, energy decimal(18,4), energy_unit string")
    t["mv_acct_prem_cust"] = c([(7, "A1", None, "Ann", "AC", "C1", D(2020, 1, 1)), (7, "A2", "RS", "Ann", "AC", "C1", D(2021, 1, 1))],
                               "install_num long, acct_num string, rate_schd_cd string, full_name string, acct_stat_cd string, "
                               "cust_num string, acct_open_date date")
    t["account_installation"] = c([(7, "A2", "WC9", True)], "install_num long, acct_num string, prem_dstr_cd string, crnt_row_flag boolean")
    t["bill_detail_fact"] = c([
        (202510, "A1", 7, D(2025, 9, 15), D(2025, 10, 15), Dec("300"), None, "C1", D(2025, 11, 2), 30, Dec("5"), None, 2, "1000"),
        (202509, "A1", 7, D(2025, 8, 15), D(2025, 9, 15), Dec("600"), "RS", "C1", D(2025, 10, 2), 30, Dec("1"), Dec("2"), 2, "1000"),
    ], "rltv_mo int, cust_acct_num string, prem_num long, rdg_from_date date, rdg_to_date date, total_kwh decimal(18,4), "
       "rate_schd_cd string, cust_num string, bill_date date, service_days int, ev_on_peak_kwh decimal(18,4), "
       "ev_off_peak_kwh decimal(18,4), debit_stat_cd int, bus_cd string")
    t["net_meter_application"] = c([(7, D(2025, 1, 1), "Completed", 1500), (7, D(2025, 2, 1), "Completed", 1500)],
                                   "prem_num long, stat_date date, stat_name string, cd_sub_cmpny int")
    t["premise"] = c([(7, "33101", 1, T(2020, 1, 1), T(9999, 12, 31), False)],
                     "prem_num long, prem_zip_cd string, cycl_day int, efct_strt_dttm timestamp_ntz, efct_end_dttm timestamp_ntz, rmv_flag boolean")
    t["billing_fact"] = c([("A1", 7, 202510, D(2025, 11, 1), "AC", "RS", "Ann", None, "WC1", "1 Elm"),
                           ("A1", 7, 202510, D(2025, 11, 2), "AC", "RS", "Ann", "Lee", "WC1", "1 Elm")],
                          "cust_acct_num string, prem_num long, rltv_mo int, bill_date date, acct_stat_cd string, rate_schd_cd string, "
                          "cust_name_1 string, cust_name_2 string, dstr_cd string, prem_addr string")
    return t
