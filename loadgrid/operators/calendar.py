"""Billing-cycle calendar operators (the ``day`` table: one row per date with a cycle day)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.functions.columns import lit_date, month_key

READ_LAG_DAYS = 8  # fixed value of the reference: meter reads are taken for the date 8 days back


def cycle_day_gaps(day: DataFrame, date: str = "greg_date", cycle: str = "cycl_day_num") -> DataFrame:
    """Add ``rltv_greg_mo`` (YYYYMM) and ``greg_days`` = days since the previous date of the same
    cycle day (``datediff(d, lag(d))``). Window partitions are cycle days of a calendar."""
    w = Window.partitionBy(cycle).orderBy(F.col(date).asc_nulls_last())
    return (day.withColumn("rltv_greg_mo", month_key(date))
               .withColumn("greg_days", F.datediff(F.col(date), F.lag(F.col(date)).over(w))))


def read_cycle_day(day: DataFrame, run_date: dt.date | str | None, date: str = "greg_date",
                   cycle: str = "cycl_day_num", lag_days: int = READ_LAG_DAYS) -> DataFrame:
    """Cycle-day row of ``run_date - lag_days``; the date filter applies *after* the window, so the
    gap is measured against the whole calendar. ``run_date=None`` keeps every billing date."""
    g = cycle_day_gaps(day, date, cycle)
    g = g.where((F.col(cycle) != 0) & F.col(cycle).isNotNull())
    if run_date is not None:
        g = g.where(F.col(date) == F.date_sub(lit_date(run_date), lag_days))
    return g.select(date, cycle, "rltv_greg_mo", "greg_days")
