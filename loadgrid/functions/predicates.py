"""Row predicates of the datasets, as ``Column`` booleans with the reference's NULL behaviour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadgrid.functions.columns import OPEN_END_DATE, col, lit_date


def active_on(start: str | Column, end: str | Column, day) -> Column:
    """Validity window with open end: ``start <= d and coalesce(end, '9999-12-31') >= d``."""
    d = day if isinstance(day, Column) else lit_date(day)
    return (col(start) <= d) & (F.coalesce(col(end), lit_date(OPEN_END_DATE)) >= d)


def months_overlap(start: str | Column, end: str | Column, month: int, as_of) -> Column:
    """Month-granular overlap; an open end counts up to the ``as_of`` date (the run date). Compares
    the plain dates with the month's first day and the next month's, so that the bounds reach the scan."""
    year, mon = divmod(int(month), 100)
    first = dt.date(year, mon, 1)
    following = dt.date(year + mon // 12, mon % 12 + 1, 1)
    open_end = col(end).isNull() & (lit_date(as_of) >= lit_date(first))
    return (col(start) < lit_date(following)) & ((col(end) >= lit_date(first)) | open_end)


def is_true(c: str | Column) -> Column:
    return col(c) == F.lit(True)


def not_deleted(c: str | Column) -> Column:
    """``coalesce(flag, false) = false`` — a NULL flag counts as not deleted."""
    return F.coalesce(col(c), F.lit(False)) == F.lit(False)


def half_open(c: str | Column, lo, hi) -> Column:
    """``lo <= c < hi``."""
    return (col(c) >= lo) & (col(c) < hi)


def closed(c: str | Column, lo, hi) -> Column:
    """``lo <= c <= hi``."""
    return (col(c) >= lo) & (col(c) <= hi)


# Bad-reading filters, one per source. Each keeps the reference's NULL handling exactly.

def status_ok(stat_code: str | Column, reading: str | Column) -> Column:
    """Keeps readings without a power failure; an irregular reading is kept unless it is zero.
    A NULL status is dropped (the first comparison is NULL)."""
    s = col(stat_code)
    return (~s.like("%POWER_FAIL%")) & ~(s.like("%IRREGULAR%") & (col(reading) == 0))


def channel_flag_ok(flag: str | Column, reading: str | Column) -> Column:
    """Keeps readings that were not skipped; a partial reading is kept unless it is zero. A NULL flag is kept."""
    f = F.coalesce(col(flag), F.lit(""))
    return (~f.like("%Skipped%")) & ~(f.like("%Partial%") & (col(reading) == 0))


def interval_status_ok(stat: str | Column, reading: str | Column) -> Column:
    """Drops power outages, and zero readings that carry any status. A NULL status is kept."""
    s = col(stat)
    return (F.coalesce(s, F.lit("")) != "PO") & ~(s.isNotNull() & (col(reading) == 0))


def good_reading(flag: str | Column, reading: str | Column) -> Column:
    """``flag is null and reading is not null``."""
    return col(flag).isNull() & col(reading).isNotNull()


def bill_usable(debit_stat: str | Column, service_days: str | Column, frm: str | Column, to: str | Column) -> Column:
    """``debit_stat_cd = 2 and service_days > 0 and both reading dates present``."""
    return (col(debit_stat) == 2) & (col(service_days) > 0) & col(frm).isNotNull() & col(to).isNotNull()


def non_empty(start: str | Column, end: str | Column) -> Column:
    return col(start) < col(end)


def charger_in_service(status: str | Column, sub_company: str | Column, public: bool) -> Column:
    """Charger branch filters: private (``status = in service and sub-company 1500``) or
    public (``status in service or NULL, and no sub-company``)."""
    s = col(status)
    if public:
        return ((s == "Asset In-Service") | s.isNull()) & col(sub_company).isNull()
    return (s == "Asset In-Service") & (col(sub_company) == 1500)
