"""Scalar expressions used by the datasets. Every function returns a JVM-side ``Column``.

Time convention: instants are carried as ``TIMESTAMP_NTZ`` holding UTC; wall time is derived with the
three-argument ``convert_timezone``, so no result depends on the session time zone.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's.
OPEN_END_DATE = "9999-12-31"            # open validity end
OPEN_END_TS = "9999-12-31 00:00:00"     # open validity end as a timestamp
DEFAULT_RATECODE = "68"                 # rate code when none is known
LOCAL_ZONE = "America/New_York"         # zone of wall-clock outputs
READ_MINUTES = 15                       # reading interval length
WH_PER_KWH = Decimal("0.001")           # Wh -> kWh factor


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(d: str | Column) -> Column:
    """``YYYYMM`` as an integer (``to_char(d,'YYYYMM')::int``, ``year || lpad(month,2,0)``)."""
    d = col(d)
    return (F.year(d) * 100 + F.month(d)).cast("int")


def month_key_str(d: str | Column) -> Column:
    """``YYYYMM`` as a string (``to_char(d,'YYYYMM')``)."""
    return F.date_format(col(d), "yyyyMM")


def first_of_month(year: str | Column, month: str | Column) -> Column:
    """Date assembled from calendar year and month parts."""
    return F.make_date(col(year).cast("int"), col(month).cast("int"), F.lit(1))


def later_of(x: str | Column, y: str | Column) -> Column:
    """``case when x <= y then y else x`` — a NULL on either side yields ``x`` (not ``greatest``)."""
    x, y = col(x), col(y)
    return F.when(x <= y, y).otherwise(x)


def earlier_of(x: str | Column, y: str | Column) -> Column:
    """``case when x >= y then y else x`` — a NULL on either side yields ``x`` (not ``least``)."""
    x, y = col(x), col(y)
    return F.when(x >= y, y).otherwise(x)


def strip_id_prefix(c: str | Column) -> Column:
    """Drop the two leading characters of an id that contains a letter."""
    c = col(c)
    return F.when(c.rlike("[A-Za-z]"), c.substr(F.lit(3), F.length(c))).otherwise(c)


def channel_number(meter_type: str | Column, chnl_num: str | Column, seq: str | Column) -> Column:
    """Logical channel from recorder sequence: ``seq*3-1`` for Q-meters or channel 2, else ``seq*3-2``."""
    seq = col(seq)
    return F.when(col(meter_type).like("Q%") | (col(chnl_num) == 2), seq * 3 - 1).otherwise(seq * 3 - 2)


def join_names(first: str | Column, second: str | Column) -> Column:
    """``first`` alone when ``second`` is NULL, else ``first || ' ' || second``."""
    return F.when(col(second).isNull(), col(first)).otherwise(F.concat(col(first), F.lit(" "), col(second)))


def sum_or_zero(a: str | Column, b: str | Column) -> Column:
    """``coalesce(a + b, 0)``: zero when either term is NULL."""
    return F.coalesce(col(a) + col(b), F.lit(0))


def dec(c: str | Column, precision: int = 18, scale: int = 4) -> Column:
    return col(c).cast(f"decimal({precision},{scale})")


def scaled(reading: str | Column, factor: str | Column, digits: int) -> Column:
    """``round(reading * factor, digits)`` in decimal arithmetic (exact, no binary halves)."""
    return F.round(col(reading) * col(factor), digits)


def to_kwh(energy: str | Column, unit: str | Column, case_insensitive: bool = False) -> Column:
    """Normalise one reading to kWh before summing (``Wh`` divided by 1000)."""
    u = F.lower(col(unit)) if case_insensitive else col(unit)
    wh = "wh" if case_insensitive else "Wh"
    return F.when(u == wh, col(energy) * F.lit(WH_PER_KWH)).otherwise(col(energy))


def kwh_after_sum(total: str | Column, unit: str | Column, digits: int = 4) -> Column:
    """Unit conversion applied to an already summed, rounded value (unit is part of the key)."""
    r = F.round(col(total), digits)
    return F.when(F.lower(col(unit)) == "wh", r * F.lit(WH_PER_KWH)).otherwise(r)


def wall_time(ts_utc: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Instant (UTC, NTZ) -> wall-clock time in ``zone`` (``AT TIME ZONE``)."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts_utc))


def utc_of_wall(wall: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time in ``zone`` -> instant (UTC, NTZ). Ambiguous fall-back times take one offset."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), col(wall))


def minutes_before(ts: str | Column, minutes: int = READ_MINUTES) -> Column:
    """``ts - INTERVAL 'n min'``; read start from read end."""
    return col(ts) - F.expr(f"INTERVAL {int(minutes)} MINUTES")


def epoch_seconds(ts_utc: str | Column) -> Column:
    """Seconds since 1970-01-01 of a UTC NTZ instant, without the session zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts_utc))


def from_epoch_seconds(secs: str | Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=col(secs).cast("decimal(18,6)"))


def lit_date(d) -> Column:
    return F.lit(str(d)).cast("date")


def lit_ts(ts) -> Column:
    return F.lit(str(ts)).cast("timestamp_ntz")
