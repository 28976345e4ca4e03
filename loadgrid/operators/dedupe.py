"""Keep-the-best-row-per-key operators (``row_number``/``dense_rank`` filters).

A ``row_number() <= n`` filter is planned by Spark as a partial ``WindowGroupLimit`` before the
shuffle and a final one after it, so a hot key sends at most ``n`` rows per map partition through
the exchange — the pre-aggregation that keeps a key holding a third of the rows from landing whole
in one task. ``dense_rank`` filters get the same partial limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.functions.columns import col


def _cols(cs) -> list[Column]:
    return [col(c) for c in ([cs] if isinstance(cs, (str, Column)) else cs)]


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                rank: str = "row_number", keep_rank: str | None = None) -> DataFrame:
    """Rows whose ``row_number``/``dense_rank`` over ``keys`` by ``order`` is at most ``n``.

    ``order`` must carry explicit null ordering; add a unique tie-breaker for a deterministic pick.
    """
    fn = {"row_number": F.row_number, "dense_rank": F.dense_rank, "rank": F.rank}[rank]
    name = keep_rank or "__rank"
    out = df.withColumn(name, fn().over(Window.partitionBy(*_cols(keys)).orderBy(*order))).where(F.col(name) <= n)
    return out if keep_rank else out.drop(name)


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: str | Column,
                   tiebreak: Sequence[Column] = ()) -> DataFrame:
    """Newest row per key (``row_number() over (partition by keys order by t desc) = 1``).
    ``DESC`` sorts NULLs first, as in the reference's dialect."""
    return top_per_key(df, keys, [col(newest_first).desc_nulls_first(), *tiebreak])


def priority_dedupe(df: DataFrame, keys: Sequence[str], source: str | Column, value: str | Column,
                    tiebreak: Sequence[Column] = ()) -> DataFrame:
    """One reading per key: lowest source tag wins, then the smallest value."""
    return top_per_key(df, keys, [col(source).asc_nulls_last(), col(value).asc_nulls_last(), *tiebreak])


def earliest_then_newest_load(df: DataFrame, keys: Sequence[str], start: str | Column, load: str | Column,
                              tiebreak: Sequence[Column] = ()) -> DataFrame:
    """Device de-duplication: earliest start, then the newest load batch."""
    return top_per_key(df, keys, [col(start).asc_nulls_last(), col(load).desc_nulls_first(), *tiebreak])


def last_n_periods(df: DataFrame, keys: Sequence[str], period: str | Column, n: int) -> DataFrame:
    """Rows of the ``n`` most recent distinct periods per key (``dense_rank ... desc <= n``)."""
    return top_per_key(df, keys, [col(period).desc_nulls_first()], n=n, rank="dense_rank")
