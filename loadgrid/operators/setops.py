"""Existence tests, work queues, SQL ``IN``/``NOT IN`` with exact NULL semantics, and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def exclude_done(df: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """``NOT EXISTS (select 1 from done where keys match)`` -> left anti join."""
    return df.join(done.select(*on), on=list(on), how="left_anti")


def keep_listed(df: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """``inner join (select distinct key ...)`` used only as a filter -> left semi join."""
    return df.join(listed.select(*on), on=list(on), how="left_semi")


def sql_in(df: DataFrame, x: str, keys: DataFrame, key: str, name: str) -> DataFrame:
    """Add boolean column ``name`` = ``x IN (select key from keys)`` with SQL three-valued logic.

    TRUE on a match; otherwise NULL when ``x`` is NULL or the key list holds a NULL (and is not
    empty); otherwise FALSE. ``NOT IN`` is ``~F.col(name)``. Plan: a hash left join on the distinct
    non-NULL keys (size-checked broadcast or shuffle join, AQE decides), plus two uncorrelated scalar
    subqueries (row count and NULL count of the key list), each computed once with partial aggregation.
    """
    k = f"__k_{name}"
    hit = f"__hit_{name}"
    distinct = keys.where(F.col(key).isNotNull()).select(F.col(key).alias(k)).distinct().withColumn(hit, F.lit(True))
    n_all = keys.agg(F.count(F.lit(1))).scalar()
    n_null = keys.agg(F.count_if(F.col(key).isNull())).scalar()
    out = df.join(distinct, df[x] == distinct[k], "left").drop(k)
    value = (F.when(F.col(hit), F.lit(True))
              .when(n_all == 0, F.lit(False))
              .when(F.col(x).isNull() | (n_null > 0), F.lit(None).cast("boolean"))
              .otherwise(F.lit(False)))
    return out.withColumn(name, value).drop(hit)


def union_all(*dfs: DataFrame) -> DataFrame:
    """``UNION ALL`` by position (duplicates kept)."""
    return reduce(DataFrame.union, dfs)
