"""Effective-dated intervals: envelopes, chaining, islands, and joins of facts to intervals.

Every join of a fact to an interval has an equality key (meter, recorder+channel, site+charger),
so Spark plans a hash or sort-merge join with the range as a residual condition; AQE splits a
skewed key. Where a key has many intervals, :func:`interval_index_join` cuts them into time bins and joins by (key, bin).
The one pure range join (a transaction against the calendar month before a cycle
date) is rewritten into an equi-join on the month key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadgrid.functions.columns import col, later_of, month_key


def envelope(df: DataFrame, keys: Sequence[str], start: str | Column, stop: str | Column,
             start_name: str = "meterstart", stop_name: str = "meterstop") -> DataFrame:
    """``min(start), max(stop)`` per key (partial aggregation before the shuffle)."""
    return df.groupBy(*keys).agg(F.min(col(start)).alias(start_name), F.max(col(stop)).alias(stop_name))


def interval_join(facts: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]],
                  at: str | Column, start: str, stop: str, closed: bool = False,
                  how: str = "inner") -> DataFrame:
    """Join each fact to the intervals of its key that contain ``at``.

    ``closed=False``: ``start <= at < stop`` (a fact on a shared edge matches the later interval
    only). ``closed=True``: ``start <= at <= stop`` (``BETWEEN``; a fact on a shared edge matches
    both). ``on`` pairs fact columns with interval columns.
    """
    cond = [facts[f] == intervals[i] for f, i in on]
    a = at if isinstance(at, Column) else facts[at]
    upper = (a <= intervals[stop]) if closed else (a < intervals[stop])
    cond += [intervals[start] <= a, upper]
    return facts.join(intervals, on=cond, how=how)


def _seconds(df: DataFrame, c: str | Column) -> Column:
    """Whole seconds of a date, wall-clock or instant column; never decreasing along it."""
    if isinstance(df.select(c).schema[0].dataType, T.TimestampType):
        return F.unix_seconds(col(c))
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(c).cast("timestamp_ntz"))


def index_bin_width(lengths: DataFrame, span: int, least_bins: int) -> int:
    """Bin width in seconds from the intervals' lengths (column ``len``) inside a span of ``span`` seconds: their median or, if larger, a
    quarter of their mean, at most ``span / least_bins``. n intervals are so cut into (5 + least_bins) n pieces at most, and into 2 n or so where they are alike."""
    r = lengths.agg(F.percentile_approx("len", 0.5).alias("median"), F.avg("len").alias("mean")).first()
    return max(1, min(-(-span // least_bins), max(int(r["median"] or 0), -(-int(r["mean"] or 0) // 4))))


def interval_index_join(facts: DataFrame, intervals: DataFrame, on: Sequence[tuple[str, str]], at: str | Column,
                        start: str, stop: str, closed: bool = False, how: str = "inner",
                        bounds: tuple | None = None, width: int | None = None, least_bins: int = 32) -> DataFrame:
    """:func:`interval_join` for keys with many intervals or very many facts: equal rows, another plan.

    Time is cut into bins of ``width`` seconds (default: from the intervals, :func:`index_bin_width`). Each interval gives a row per bin it
    reaches into, each fact lies in one bin, and both join by (key, bin); the edges are then compared exactly, so a fact meets an
    interval once. A key's facts spread over its bins and meet only intervals of their own bin. Intervals are first clipped to
    ``bounds`` (first and last time of the facts; default: found by one aggregation of the facts), so that open ends cost nothing.
    ``how``: inner or left; facts with a null key or time match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError("interval_index_join: how must be inner or left")
    a = at if isinstance(at, Column) else facts[at]
    fs = _seconds(facts, a)
    if bounds is None:
        r = facts.agg(F.min(fs).alias("lo"), F.max(fs).alias("hi")).first()
        lo, hi = r["lo"], r["hi"]
    else:
        ends = facts.sparkSession.range(1).select(*[F.lit(str(b)).cast("timestamp_ntz").alias(n) for b, n in zip(bounds, ("lo", "hi"), strict=True)])
        lo, hi = ends.select(_seconds(ends, "lo"), _seconds(ends, "hi")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    first, last = _seconds(intervals, start), _seconds(intervals, stop)
    iv = intervals.withColumn("__first", F.greatest(first, F.lit(lo))).withColumn("__last", F.least(last, F.lit(hi)))
    # What has no edge or lies outside the facts' times matches nothing.
    iv = iv.where(first.isNotNull() & last.isNotNull() & (F.col("__first") <= F.col("__last")))
    if width is None:
        width = index_bin_width(iv.select((F.col("__last") - F.col("__first")).alias("len")), hi - lo + 1, least_bins)
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    pieces = iv.withColumn("__ibin", F.explode(F.sequence(bin_of(F.col("__first")), bin_of(F.col("__last"))))).drop("__first", "__last")
    f = facts.withColumn("__fbin", bin_of(fs))
    upper = (a <= pieces[stop]) if closed else (a < pieces[stop])
    cond = [*[f[x] == pieces[y] for x, y in on], f["__fbin"] == pieces["__ibin"], pieces[start] <= a, upper]
    return f.join(pieces, cond, how).drop("__fbin", "__ibin")


def month_before_join(facts: DataFrame, fact_date: str | Column, calendar: DataFrame,
                      month_start: str | Column, how: str = "inner") -> DataFrame:
    """Facts dated in the calendar month *before* ``month_start``:
    ``month_start > d and add_months(month_start, -1) <= d`` for dates ``d``, rewritten as the
    equi-join ``yyyymm(d) = yyyymm(add_months(month_start, -1))``."""
    k = "__month_before"
    f = facts.withColumn(k, month_key(col(fact_date).cast("date")))
    c = calendar.withColumn(k, month_key(F.add_months(col(month_start), -1)))
    return f.join(c, on=k, how=how).drop(k)


def chain_meter_intervals(rows: DataFrame, premise: str = "prem_num", meter: str = "ami_dvc_name",
                          meter_type: str = "fpl_mtr_num", mult: str = "kwh_csnt", set_date: str = "mtr_set_date",
                          start: str = "efct_strt_date", end: str = "efct_end_date", spread: str | None = None) -> DataFrame:
    """Meter installations -> effective intervals ``[meterstart, meterstop)`` per premise.

    1. one row per (premise, meter, type, multiplier, set date): first start, last end;
    2. start = set date for the first row of its (premise, set date) by last end, else first start;
    3. stop = set date of the next installation of the premise by last end, else last end;
    4. meterstart = the later of start and set date.
    Ties of the last end are broken by set date, meter, type, multiplier (the reference leaves them open).
    ``spread`` ("year", "month", ...) looks for neighbours per (premise, such a stretch of last ends) with one boundary row a stretch, so
    that a premise with very many rows is not chained in one task; the result is the same.
    Output: premiseid, meterid, metermtpl, metertype, meterstart, meterstop.
    """
    g = rows.groupBy(premise, meter, meter_type, mult, set_date).agg(
        F.min(start).alias("__min_start"), F.max(end).alias("__max_end"))
    tie = [F.col(meter).asc_nulls_last(), F.col(meter_type).asc_nulls_last(), F.col(mult).asc_nulls_last()]
    by_end = F.col("__max_end").asc_nulls_last()
    by_set = [by_end, F.col(set_date).asc_nulls_last(), *tie]
    if spread is None:
        prev = F.lag(F.col(set_date)).over(Window.partitionBy(premise, set_date).orderBy(by_end, *tie))
        nxt = F.lead(F.col(set_date)).over(Window.partitionBy(premise).orderBy(*by_set))
    else:
        stretch = F.date_trunc(spread, F.col("__max_end").cast("timestamp_ntz"))
        g = ordered_neighbour(g, [premise, set_date], [by_end, *tie], [set_date], stretch, ["__prev_set"], ahead=False)
        g = ordered_neighbour(g, [premise], by_set, [set_date], stretch, ["__next_set"])
        prev, nxt = F.col("__prev_set"), F.col("__next_set")
    strt = F.when(prev.isNull(), F.col(set_date)).otherwise(F.col("__min_start"))
    stop = F.when(nxt.isNull(), F.col("__max_end")).otherwise(nxt)
    return g.select(
        F.col(premise).alias("premiseid"), F.col(meter).alias("meterid"), F.col(mult).alias("metermtpl"),
        F.col(meter_type).alias("metertype"), later_of(strt, F.col(set_date)).alias("meterstart"),
        stop.alias("meterstop"))


def bucketed_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: str | Column,
                        name: str) -> DataFrame:
    """Exact ``row_number() over (partition by keys order by order)`` computed per (keys, bucket).

    ``bucket`` must be non-decreasing along ``order`` (e.g. the day of the first order column).
    Each task then numbers one bucket of one key; the offset of a bucket is the running row count
    of the key's earlier buckets, computed on one row per (key, bucket). A key holding a third of
    all rows is spread over its buckets instead of one task. Rows with a null key are numbered among themselves.
    """
    b = "__bucket"
    # Explicit distribution on (keys, bucket): a partitioning on the keys alone would satisfy the
    # window and keep a hot key in one task.
    d = df.withColumn(b, col(bucket)).repartition(*keys, b)
    local = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order))
    counts = d.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*[F.col(c).alias(f"__k_{c}") for c in (*keys, b)], F.coalesce(F.sum("__n").over(
        Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, b)]
    out = d.withColumn("__local", local).join(offsets, same, "inner").drop(*[f"__k_{c}" for c in (*keys, b)])
    return out.withColumn(name, F.col("__off") + F.col("__local")).drop(b, "__local", "__off")


def ordered_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Sequence[str],
                      bucket: str | Column, names: Sequence[str], ahead: bool = True, descending: bool = False) -> DataFrame:
    """Exact ``lead`` (``ahead``) or ``lag`` of ``values`` over (keys) by ``order``, computed per (keys, bucket).

    ``bucket`` must be monotone along ``order``: non-decreasing with nulls last, or non-increasing
    with nulls first if ``descending``. Inside a bucket a plain window; across buckets the first (last) row
    of the next (previous) bucket of the key comes from one boundary row per (keys, bucket). A key with a
    third of all rows is spread over its buckets; rows with a null key form a key of their own, as in a window.
    """
    b, keys = "__bucket", list(keys)
    # Explicit distribution on (keys, bucket): a partitioning on the keys alone would satisfy the window.
    d = df.withColumn(b, col(bucket)).repartition(*keys, b).withColumn("__row", F.struct(*values))
    w = Window.partitionBy(*keys, b).orderBy(*order)
    near = (F.lead if ahead else F.lag)("__row").over(w)
    # What the neighbouring bucket needs of this one: its first row for lead, its last one for lag.
    edge = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("__near", near).withColumn("__edge", (F.first if ahead else F.last)("__row").over(edge))
    edges = d.groupBy(*keys, b).agg(F.first("__edge").alias("__edge"))
    along = Window.partitionBy(*keys).orderBy(F.col(b).desc_nulls_first() if descending else F.col(b).asc_nulls_last())
    edges = edges.select((F.lead if ahead else F.lag)("__edge").over(along).alias("__next"), *[F.col(c).alias(f"__k_{c}") for c in (*keys, b)])
    cond = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, b)]
    found = F.coalesce("__near", "__next")
    return d.join(edges, cond, "inner").select(*df.columns, *[found[v].alias(n) for v, n in zip(values, names, strict=True)])


def islands(df: DataFrame, keys: Sequence[str], run_keys: Sequence[str], order: Sequence[Column],
            name: str = "grp", bucket: str | Column | None = None) -> DataFrame:
    """Gaps and islands: ``row_number over (keys) - row_number over (keys + run_keys)``, both by
    ``order``. Rows of one unbroken run of equal ``run_keys`` share the value; ``order`` must be a
    total order. With ``bucket`` the row numbers are computed per bucket (skew-safe, exact)."""
    if bucket is None:
        rn_all = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        rn_run = F.row_number().over(Window.partitionBy(*keys, *run_keys).orderBy(*order))
        return df.withColumn(name, rn_all - rn_run)
    # One distribution by (keys, bucket) serves both numberings; the offsets of earlier buckets come
    # from one row per (keys, run keys, bucket).
    b, keys, run_keys = "__bucket", list(keys), list(run_keys)
    d = df.withColumn(b, col(bucket)).repartition(*keys, b)
    runs = d.groupBy(*keys, *run_keys, b).agg(F.count(F.lit(1)).alias("__n"))

    def before(partition):
        w = Window.partitionBy(*partition).orderBy(F.col(b).asc_nulls_first())
        return F.coalesce(F.sum("__n").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))

    same = Window.partitionBy(*keys, b)
    runs = runs.select(*keys, *run_keys, b, (before(keys) - F.sum("__n").over(same)
                                             - before([*keys, *run_keys]) + F.col("__n")).alias("__off"))
    rn_all = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order))
    rn_run = F.row_number().over(Window.partitionBy(*keys, *run_keys, b).orderBy(*order))
    out = d.withColumn("__local", rn_all - rn_run)
    runs = runs.select("__off", *[F.col(c).alias(f"__k_{c}") for c in (*keys, *run_keys, b)])
    cond = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, *run_keys, b)]
    return out.join(runs, cond, "inner").select(*df.columns, (F.col("__local") + F.col("__off")).alias(name))
