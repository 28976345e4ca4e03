"""Energy sums with unit normalisation before or after aggregation (decimal arithmetic)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadgrid.functions.columns import col, kwh_after_sum, to_kwh


def sum_kwh_before(df: DataFrame, keys: Sequence[str | Column], energy: str, unit: str, name: str = "kwh",
                   round_each: int | None = None, case_insensitive: bool = False,
                   below: float | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """``sum(case when unit = 'Wh' then e/1000 else e end)`` per key; optional per-reading
    ``round(e, n)`` first, and a ``having sum < below`` cap."""
    e = F.round(col(energy), round_each) if round_each is not None else col(energy)
    out = df.groupBy(*keys).agg(F.sum(to_kwh(e, unit, case_insensitive)).alias(name), *also)
    return out.where(F.col(name) < below) if below is not None else out


def sum_kwh_after(df: DataFrame, keys: Sequence[str | Column], energy: str, unit: str, name: str = "kwh",
                  digits: int = 4, below: float | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """Sum per key *and unit*, then ``round(sum, 4)`` and divide Wh sums by 1000; a group with
    mixed units yields one row per unit. Optional ``kwh < below`` cap after conversion."""
    keys = list(keys)
    unit_key = unit if any(isinstance(k, str) and k == unit for k in keys) else None
    gkeys = keys if unit_key else [*keys, unit]
    out = df.groupBy(*gkeys).agg(F.sum(col(energy)).alias("__sum"), *also)
    out = out.withColumn(name, kwh_after_sum("__sum", unit, digits)).drop("__sum")
    return out.where(F.col(name) < below) if below is not None else out
