"""Interval time-series quality and daylight-saving-safe operators.

Instants are UTC ``TIMESTAMP_NTZ``; local days and wall times are derived with explicit zones.
Grids are generated per (series, UTC day) and gap fill looks up neighbours with a two-level scan
(inside a day, then across one-row-per-day summaries), so no series is processed whole by one task.

A step is a number of minutes for all series, or the name of a column with the minutes of each reading: series may
have different steps, and the step of a series may change. A run of readings of one step is a segment;
its grid starts at its first reading and ends before the next segment's first one (the last segment's: with its last reading).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.functions.columns import LOCAL_ZONE, READ_MINUTES, col, lit_date, utc_of_wall, wall_time
from loadgrid.operators.intervals import islands, ordered_neighbour

W = Window


def local_day(ts_utc: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar date of an instant in ``zone``."""
    return wall_time(ts_utc, zone).cast("date")


def day_start_utc(day: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Instant of local midnight (midnights are never ambiguous in zones that shift at 02:00)."""
    return utc_of_wall(col(day).cast("timestamp_ntz"), zone)


def local_day_filter(df: DataFrame, ts_utc: str, day: dt.date | str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Rows of one local day, bounded by instants: ``[midnight, next midnight)`` in UTC."""
    d = lit_date(day)
    return df.where((F.col(ts_utc) >= day_start_utc(d, zone)) & (F.col(ts_utc) < day_start_utc(F.date_add(d, 1), zone)))


def step_seconds(step: int | str | Column) -> Column:
    """Seconds of a step given in minutes: a number for all rows, or a column."""
    return F.lit(int(step) * 60) if isinstance(step, int) else (col(step) * 60).cast("long")


def expected_intervals(day: str | Column, zone: str = LOCAL_ZONE, minutes: int | str | Column = READ_MINUTES) -> Column:
    """Intervals in a local day: 96 normally, 100 on fall-back, 92 on spring-forward (15 min)."""
    d = col(day)
    span = F.timestamp_diff("SECOND", day_start_utc(d, zone), day_start_utc(F.date_add(d, 1), zone))
    return (span / step_seconds(minutes)).cast("int")


def expected_hours(day: str | Column, zone: str = LOCAL_ZONE) -> Column:
    d = col(day)
    return F.timestamp_diff("HOUR", day_start_utc(d, zone), day_start_utc(F.date_add(d, 1), zone)).cast("int")


def offset_hours(ts_utc: str | Column, zone: str = LOCAL_ZONE) -> Column:
    """Hours between UTC and wall time (4 in EDT, 5 in EST)."""
    return F.timestamp_diff("HOUR", wall_time(ts_utc, zone), col(ts_utc)).cast("int")


def floor_minutes(ts: str | Column, minutes: int | str | Column = READ_MINUTES) -> Column:
    """Start of the ``minutes`` bucket containing ``ts``; buckets are counted from UTC midnight, also above an hour."""
    t, m = col(ts), F.lit(minutes) if isinstance(minutes, int) else col(minutes)
    within = F.floor((F.hour(t) * 60 + F.minute(t)) / m) * m
    return F.date_trunc("day", t) + F.make_dt_interval(mins=within.cast("int"))


def step_segments(readings: DataFrame, keys: Sequence[str], ts: str, step: str) -> DataFrame:
    """One row per (series, run of equal ``step``): ``seg_start``, ``seg_last`` (its first and last reading) and
    ``seg_stop``, the next segment's start (null for the last one). Numbered and chained per (series, day)."""
    r = readings.select(*keys, F.col(ts).alias("__t"), step)
    r = islands(r, keys, [step], [F.col("__t").asc(), F.col(step).asc()], name="__run", bucket=F.to_date("__t"))
    seg = r.groupBy(*keys, step, "__run").agg(F.min("__t").alias("seg_start"), F.max("__t").alias("seg_last")).drop("__run")
    return ordered_neighbour(seg, keys, [F.col("seg_start"), F.col("seg_last"), F.col(step)], ["seg_start"], F.to_date("seg_start"), ["seg_stop"])


def split_to_grid(readings: DataFrame, keys: Sequence[str], ts: str, value: str, minutes: int | str, step: int | str,
                  name: str = "value", digits: int = 6) -> DataFrame:
    """Readings over ``[ts, ts + minutes)`` that do not lie on the grid, split over the grid intervals of ``step`` that they
    overlap, in proportion to the time shared, and summed per (series, interval).

    Shares are differences of a running floor in units of ``10**-digits``, so the parts of a reading add up to it exactly.
    A null value gives no part; a reading of no length belongs to the interval that holds its start. ``step`` must not exceed a day or divide one unevenly.
    """
    step_s, length = step_seconds(step), step_seconds(minutes)
    start = F.col(ts)
    units = F.round(F.col(value).cast(f"decimal(28,{digits})") * F.lit(10 ** digits)).cast("long")
    first = floor_minutes(F.date_trunc("minute", start), (step_s / 60).cast("int"))
    d = readings.select(*keys, start.alias("__t"), units.alias("__u"), F.greatest(length, F.lit(0)).cast("long").alias("__len"),
                        step_s.cast("long").alias("__s"), first.alias("__first")).where(F.col("__u").isNotNull())
    d = d.withColumn("__off", F.timestamp_diff("SECOND", "__first", "__t"))
    last = F.greatest(F.lit(0), F.ceil((F.col("__off") + F.col("__len")) / F.col("__s")) - 1).cast("long")
    d = d.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # Seconds of the reading before the end of interval k, and before its start.
    until = F.least(F.col("__len"), (F.col("__k") + 1) * F.col("__s") - F.col("__off"))
    since = F.greatest(F.lit(0), F.col("__k") * F.col("__s") - F.col("__off"))
    run = lambda c: F.call_function("div", F.col("__u") * c, F.greatest(F.col("__len"), F.lit(1)))
    part = F.when(F.col("__len") == 0, F.col("__u")).otherwise(run(until) - run(since))
    t = F.col("__first") + F.make_dt_interval(secs=(F.col("__k") * F.col("__s")).cast("decimal(18,6)"))
    out = d.select(*keys, t.alias(ts), part.alias("__p")).groupBy(*keys, ts).agg(F.sum("__p").alias("__p"))
    return out.select(*keys, ts, (F.col("__p") / F.lit(10 ** digits).cast("decimal(18,0)")).cast(f"decimal(28,{digits})").alias(name))


def _bounds(readings: DataFrame, keys: Sequence[str], ts: str, step: int | str) -> DataFrame:
    """Per segment (a series, where one step holds for all) ``__lo`` and the last instant ``__hi`` of its grid, and its ``__step`` in seconds."""
    if isinstance(step, int):
        b = readings.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    else:
        before = F.col("seg_stop") - F.expr("INTERVAL 1 SECOND")
        b = step_segments(readings, keys, ts, step).select(*keys, step, F.col("seg_start").alias("__lo"), F.coalesce(before, "seg_last").alias("__hi"))
    return b.withColumn("__step", step_seconds(step))


def time_grid(series: DataFrame, keys: Sequence[str], ts: str, step_minutes: int | str = READ_MINUTES,
              name: str | None = None) -> DataFrame:
    """Regular grid per series from its first to its last reading (``lo, lo+step, ... <= hi``); with the name of a step
    column a grid per segment, and the step as a column.

    Generated per (series, UTC day): each day explodes at most ``1440/step`` points, so the work
    follows the time span and spreads over tasks. Points keep the alignment of the first reading.
    """
    name = name or ts
    step = F.col("__step")
    b = _bounds(series, keys, ts, step_minutes)
    more = [] if isinstance(step_minutes, int) else [step_minutes]
    days = b.withColumn("__day", F.explode(F.sequence(F.to_date("__lo"), F.to_date("__hi"))))
    # Spread the (series, day) rows before generating points; otherwise every point of a series
    # is generated in the task that aggregated its bounds.
    days = days.repartition(*keys, "__day")
    ds = F.col("__day").cast("timestamp_ntz")
    off_start = F.timestamp_diff("SECOND", F.col("__lo"), ds)                     # day start - lo
    off_end = F.timestamp_diff("SECOND", F.col("__lo"), ds + F.expr("INTERVAL 1 DAY"))
    span = F.timestamp_diff("SECOND", F.col("__lo"), F.col("__hi"))
    k_first = F.greatest(F.lit(0), F.ceil(off_start / step))
    k_last = F.least(F.floor(span / step), F.ceil(off_end / step) - 1)
    days = days.withColumn("__k0", k_first.cast("long")).withColumn("__k1", k_last.cast("long"))
    pts = days.where(F.col("__k0") <= F.col("__k1")).withColumn("__k", F.explode(F.sequence("__k0", "__k1")))
    return pts.select(*keys, *more, (F.col("__lo") + F.make_dt_interval(secs=(F.col("__k") * step).cast("decimal(18,6)")))
                      .alias(name))


def flag_gaps(grid: DataFrame, actual: DataFrame, keys: Sequence[str], ts: str, flag: str = "flag") -> DataFrame:
    """Grid left-joined with the actual readings; grid points without a reading get ``'I'``,
    the others ``'A'``. Join keys are (series, instant) — a hot series spreads over many partitions."""
    a = actual.withColumn("__present", F.lit(True))
    out = grid.join(a, on=[*keys, ts], how="left")
    return out.withColumn(flag, F.when(F.col("__present").isNull(), F.lit("I")).otherwise(F.lit("A"))).drop("__present")


def fill_linear(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str = "filled") -> DataFrame:
    """Linear interpolation in time for NULL ``value`` rows between the previous and next non-NULL
    readings of the same series: ``v0 + (v1 - v0) * (t - t0) / (t1 - t0)`` in double precision.
    Rows with a value keep it; rows without a neighbour on one side stay NULL.

    Two levels: neighbours inside the (series, UTC day) first; otherwise the last/first known
    reading of earlier/later days from one-row-per-(series, day) summaries.
    """
    day = "__day"
    # Explicit (series, day) distribution: an upstream partitioning on the series alone would
    # satisfy the window and keep a hot series in one task.
    d = df.withColumn(day, F.to_date(ts)).repartition(*keys, day)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    wd = W.partitionBy(*keys, day).orderBy(F.col(ts))
    d = (d.withColumn("__prev", F.last(known, ignorenulls=True).over(wd.rowsBetween(W.unboundedPreceding, 0)))
          .withColumn("__next", F.first(known, ignorenulls=True).over(wd.rowsBetween(0, W.unboundedFollowing))))
    days = d.groupBy(*keys, day).agg(F.max(known).alias("__last"), F.min(known).alias("__first"))
    wk = W.partitionBy(*keys).orderBy(F.col(day))
    days = days.select(*keys, day,
                       F.last("__last", ignorenulls=True).over(wk.rowsBetween(W.unboundedPreceding, -1)).alias("__carry_prev"),
                       F.first("__first", ignorenulls=True).over(wk.rowsBetween(1, W.unboundedFollowing)).alias("__carry_next"))
    d = d.join(days, on=[*keys, day], how="inner")
    p = F.coalesce(F.col("__prev"), F.col("__carry_prev"))
    n = F.coalesce(F.col("__next"), F.col("__carry_next"))
    dt_s = F.timestamp_diff("SECOND", p["t"], F.col(ts)).cast("double")
    span = F.timestamp_diff("SECOND", p["t"], n["t"]).cast("double")
    interp = p["v"] + (n["v"] - p["v"]) * dt_s / span
    out = d.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(interp))
    return out.drop(day, "__prev", "__next", "__carry_prev", "__carry_next")


def completeness(df: DataFrame, keys: Sequence[str], ts_utc: str, zone: str = LOCAL_ZONE,
                 minutes: int | str = READ_MINUTES, first_day: dt.date | str | None = None,
                 last_day: dt.date | str | None = None) -> DataFrame:
    """Per (local day, series): readings, distinct hours (of the instant, so both fall-back 01:00
    hours count), distinct wall hours (where that hour collapses), expected intervals and deficit.

    Every day of a series has a row, also one without readings: from ``first_day`` to ``last_day``
    where given, else from the series' first to its last reading. Without ``keys`` the rows are per
    date. One shuffle of hourly counts; hours are counted after grouping by them.

    With the name of a step column, the expected intervals of a day are the points of the grids of its segments; the first
    segment is carried back and the last one on to the ends of the days asked for.
    """
    keys = list(keys)
    d = df.withColumn("day", local_day(ts_utc, zone))
    if first_day is not None:
        d = d.where(F.col(ts_utc) >= day_start_utc(lit_date(first_day), zone))
    if last_day is not None:
        d = d.where(F.col(ts_utc) < day_start_utc(F.date_add(lit_date(last_day), 1), zone))
    hours = d.groupBy(*keys, "day", F.date_trunc("hour", F.col(ts_utc)).alias("__h")).agg(F.count(F.lit(1)).alias("__n"))
    counts = hours.groupBy(*keys, "day").agg(
        F.sum("__n").alias("interval_count"), F.count(F.lit(1)).alias("hour_count"),
        F.size(F.collect_set(F.date_trunc("hour", wall_time("__h", zone)))).cast("long").alias("wall_hour_count"))
    lo = lit_date(first_day) if first_day is not None else F.min("day")
    hi = lit_date(last_day) if last_day is not None else F.max("day")
    days = counts.groupBy(*keys).agg(lo.alias("__lo"), hi.alias("__hi")).where(F.col("__lo").isNotNull()).select(
        *keys, F.explode(F.sequence("__lo", "__hi")).alias("day"))
    names = ("interval_count", "hour_count", "wall_hour_count")
    counts = counts.select(*names, *[F.col(c).alias(f"__k_{c}") for c in (*keys, "day")])
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*keys, "day")]
    out = days.join(counts, same, "left").select("day", *keys, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    if isinstance(minutes, int):
        out = out.withColumn("expected_intervals", expected_intervals("day", zone, minutes))
    else:
        # The segments of all readings, also outside the days asked for.
        want = _expected_by_segment(days, step_segments(df, keys, ts_utc, minutes), keys, minutes, zone)
        want = want.select("expected_intervals", *[F.col(c).alias(f"__e_{c}") for c in (*keys, "day")])
        out = out.join(want, [F.col(c).eqNullSafe(F.col(f"__e_{c}")) for c in (*keys, "day")], "left").drop(*[f"__e_{c}" for c in (*keys, "day")])
    return out.withColumn("deficit", F.col("expected_intervals") - F.col("interval_count"))


def _expected_by_segment(days: DataFrame, segments: DataFrame, keys: Sequence[str], step: str, zone: str) -> DataFrame:
    """Grid points per (series, local day) of ``days``: those of every segment that reaches into the day."""
    first = F.col("seg_start") == F.min("seg_start").over(W.partitionBy(*keys))
    s = segments.select(*[F.col(c).alias(f"__s_{c}") for c in keys], "seg_start", "seg_stop", step_seconds(step).alias("__step"), first.alias("__first"))
    d = days.withColumn("__lo", day_start_utc("day", zone)).withColumn("__hi", day_start_utc(F.date_add("day", 1), zone))
    on = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in keys]
    reaches = (F.col("__first") | (F.col("seg_start") < F.col("__hi"))) & (F.col("seg_stop").isNull() | (F.col("seg_stop") > F.col("__lo")))
    j = d.join(s, [*on, reaches])
    lo = F.when(F.col("__first"), F.col("__lo")).otherwise(F.greatest("__lo", "seg_start"))
    hi = F.least(F.col("__hi"), F.coalesce("seg_stop", "__hi"))
    # Points seg_start + k * step in [lo, hi), k of any sign.
    point = lambda t: F.ceil(F.timestamp_diff("SECOND", F.col("seg_start"), t) / F.col("__step"))
    return j.groupBy(*keys, "day").agg(F.sum(F.greatest(F.lit(0), point(hi) - point(lo))).cast("int").alias("expected_intervals"))


def hour_histogram(df: DataFrame, ts_utc: str, zone: str = LOCAL_ZONE, day: dt.date | str | None = None,
                   series: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Readings per (wall hour, UTC hour): the repeated fall-back hour shows as two rows. ``day``
    restricts to one local day, ``series`` (one key column) to a list of meters; ``ordered`` sorts by both hours."""
    if day is not None:
        df = local_day_filter(df, ts_utc, day, zone)
    if series is not None:
        df = df.join(series, series.columns[0], "left_semi")
    out = df.groupBy(F.date_trunc("hour", wall_time(ts_utc, zone)).alias("hour_local"),
                     F.date_trunc("hour", F.col(ts_utc)).alias("utc_hour")).agg(
        F.count(F.lit(1)).alias("record_count"))
    return out.orderBy("hour_local", "utc_hour") if ordered else out


def ambiguous_wall_times(df: DataFrame, ts_utc: str, zone: str = LOCAL_ZONE, minutes: int = READ_MINUTES) -> DataFrame:
    """Wall-time buckets that map to more than one instant bucket (the repeated fall-back hour)."""
    b = floor_minutes(ts_utc, minutes)
    g = df.groupBy(floor_minutes(wall_time(ts_utc, zone), minutes).alias("wall_bucket")).agg(
        F.count_distinct(b).alias("n_instants"), F.min(b).alias("first_utc"), F.max(b).alias("last_utc"),
        F.count(F.lit(1)).alias("n_rows"))
    return g.where(F.col("n_instants") > 1)


def interval_shares(flagged: DataFrame, keys: Sequence[str], ts_utc: str, flag: str, zone: str = LOCAL_ZONE) -> DataFrame:
    """Per (local day, series): percentages of good (``A``), bad (``B``) and interpolated (``I``)
    intervals, rounded to 4 decimals (``goodintvper``, ``badintvper``, ``interpolper``)."""
    d = flagged.withColumn("greg_date", local_day(ts_utc, zone))
    n = F.count(F.lit(1))

    def pct(code: str) -> Column:
        return F.round(F.count_if(F.col(flag) == code).cast("decimal(18,0)") * 100 / n.cast("decimal(18,0)"), 4).cast("double")

    return d.groupBy("greg_date", *keys).agg(pct("A").alias("goodintvper"), pct("B").alias("badintvper"),
                                             pct("I").alias("interpolper"), n.alias("n_intervals"))


def stage_triage(source: DataFrame, processed: DataFrame, output: DataFrame, ts_utc: str,
                 zone: str = LOCAL_ZONE, keys: Sequence[str] = (), output_wall: str | None = None) -> DataFrame:
    """Per local day (and series), distinct hours seen at each stage and the first stage that loses
    hours: ``upstream`` (source below the expected hours), ``processing``, ``output`` or ``ok``.

    Stages are counted in hours of the instant, 25 on a fall-back day. An output that only has wall
    time (column ``output_wall``) shows that day's repeated hour once; it is compared with the wall
    hours of the processed stage. The stages are unioned and aggregated once.
    """
    keys = list(keys)
    inst = F.date_trunc("hour", F.col(ts_utc))

    def rows(df: DataFrame, stage: int, day, hour):
        return df.select(*keys, day.alias("day"), hour.alias("__h"), F.lit(stage).alias("__stage"))

    r = rows(source, 0, local_day(ts_utc, zone), inst).unionByName(rows(processed, 1, local_day(ts_utc, zone), inst))
    if output_wall is None:
        r = r.unionByName(rows(output, 2, local_day(ts_utc, zone), inst))
    else:
        r = r.unionByName(rows(processed, 3, local_day(ts_utc, zone), F.date_trunc("hour", wall_time(ts_utc, zone))))
        r = r.unionByName(rows(output, 2, F.col(output_wall).cast("date"), F.date_trunc("hour", F.col(output_wall))))
    hours = r.groupBy(*keys, "day", "__stage", "__h").agg(F.count(F.lit(1)).alias("__n"))
    names = ("source_hours", "processed_hours", "output_hours", "__wall")
    t = hours.groupBy(*keys, "day").agg(*[F.count_if(F.col("__stage") == i).alias(n) for i, n in enumerate(names)])
    t = t.withColumn("expected_hours", expected_hours("day", zone))
    before = F.col("__wall") if output_wall else F.col("processed_hours")
    verdict = (F.when(F.col("source_hours") < F.col("expected_hours"), "upstream")
                .when(F.col("processed_hours") < F.col("source_hours"), "processing")
                .when(F.col("output_hours") < before, "output")
                .otherwise("ok"))
    return t.select(*keys, "day", *names[:3], "expected_hours", verdict.alias("verdict"))


def fill_between_readings(actual: DataFrame, keys: Sequence[str], ts: str, value: str, step_minutes: int | str = READ_MINUTES,
                          flag: str = "flag", name: str = "filled", flag_col: str | None = None) -> DataFrame:
    """Grid, gap flags and linear fill in one pass over the *readings* instead of the grid.

    For readings aligned to the step (e.g. 15-minute buckets) the result equals
    ``fill_linear(flag_gaps(time_grid(...), ...))``. Inside a (series, UTC day) windows find the next
    reading and the known (non-NULL) readings around; across days they come from one row per (series, day). A
    reading with a NULL value keeps its flag (``flag_col`` or ``'A'``) and is filled like a gap point. Each
    reading emits itself and the missing points before the next one, ``flag = 'I'``, a day of points at a time;
    with the name of a step column, at the reading's own step, which becomes a column of the result.
    """
    step = step_seconds(step_minutes)
    more = [] if isinstance(step_minutes, int) else [step_minutes]
    keys, day = list(keys), "__day"
    d = actual.withColumn(day, F.to_date(ts)).repartition(*keys, day)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(value).alias("v")))
    wd = W.partitionBy(*keys, day).orderBy(F.col(ts))
    r = (d.withColumn("__p", F.last(known, ignorenulls=True).over(wd.rowsBetween(W.unboundedPreceding, 0)))
          .withColumn("__n", F.first(known, ignorenulls=True).over(wd.rowsBetween(1, W.unboundedFollowing)))
          .withColumn("__nt", F.lead(ts).over(wd)))
    days = d.groupBy(*keys, day).agg(F.max(known).alias("__last"), F.min(known).alias("__first"), F.min(ts).alias("__ts"))
    wk = W.partitionBy(*keys).orderBy(F.col(day))
    days = days.select(*keys, day,
                       F.last("__last", ignorenulls=True).over(wk.rowsBetween(W.unboundedPreceding, -1)).alias("__cp"),
                       F.first("__first", ignorenulls=True).over(wk.rowsBetween(1, W.unboundedFollowing)).alias("__cn"),
                       F.lead("__ts").over(wk).alias("__cnt"))
    r = r.join(days, on=[*keys, day], how="inner")
    p, n, nt = F.coalesce("__p", "__cp"), F.coalesce("__n", "__cn"), F.coalesce("__nt", "__cnt")
    # Points after this reading and before the next one; none after the last reading.
    points = F.greatest(F.lit(0), F.coalesce(F.ceil(F.timestamp_diff("SECOND", F.col(ts), nt) / step) - 1, F.lit(0))).cast("long")
    f = F.col(flag_col) if flag_col else F.lit("A")
    r = r.select(*keys, *more, F.col(ts).alias("__t0"), F.col(value).alias("__v0"), f.alias("__f"), p.alias("__p"), n.alias("__n"), points.alias("__m"))
    per_day = F.greatest(F.lit(1), F.floor(F.lit(86400) / step)).cast("long")
    r = r.withColumn("__k0", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m"), per_day)))
    r = r.withColumn("__k", F.explode(F.sequence("__k0", F.least(F.col("__m"), F.col("__k0") + per_day - 1))))
    t = F.col("__t0") + F.make_dt_interval(secs=(F.col("__k") * step).cast("decimal(18,6)"))
    own = F.col("__k") == 0
    r = r.select(*keys, *more, t.alias(ts), F.when(own, F.col("__v0")).alias(value), F.when(own, F.col("__f")).otherwise(F.lit("I")).alias(flag), "__p", "__n")
    dt_s = F.timestamp_diff("SECOND", F.col("__p.t"), F.col(ts)).cast("double")
    span = F.timestamp_diff("SECOND", F.col("__p.t"), F.col("__n.t")).cast("double")
    between = F.col("__p.v") + (F.col("__n.v") - F.col("__p.v")) * dt_s / span
    return r.withColumn(name, F.when(F.col(value).isNotNull(), F.col(value)).otherwise(between)).drop("__p", "__n")


def interval_shares_from_readings(actual: DataFrame, keys: Sequence[str], ts: str, flag: str,
                                  step_minutes: int | str = READ_MINUTES, zone: str = LOCAL_ZONE,
                                  first_day: dt.date | str | None = None, last_day: dt.date | str | None = None,
                                  ordered: bool = False) -> DataFrame:
    """``interval_shares`` of the flagged grid without generating the grid, for the local days from
    ``first_day`` to ``last_day`` where given; ``ordered`` sorts by day and series.

    Grid points per (series, local day) are counted arithmetically from the series bounds
    (points ``lo + k*step``, ``k = 0..floor((hi-lo)/step)``, inside the day's UTC bounds); readings
    are counted per flag. Work is one row per (series, local day) plus one pass over the readings.
    ``actual`` holds readings aligned to the step, with ``flag`` ``'A'`` or ``'B'``. With the name of a step
    column the points of a day are those of all segments in it.
    """
    step = F.col("__step")
    b = _bounds(actual, keys, ts, step_minutes)
    lo, hi = local_day("__lo", zone), local_day("__hi", zone)
    days = b.withColumn("greg_date", F.explode(F.sequence(lo, hi)))
    if first_day is not None:
        days = days.where(F.col("greg_date") >= lit_date(first_day))
    if last_day is not None:
        days = days.where(F.col("greg_date") <= lit_date(last_day))
    secs = lambda a, z: F.timestamp_diff("SECOND", a, z)
    k_max = F.floor(secs(F.col("__lo"), F.col("__hi")) / step)
    k0 = F.greatest(F.lit(0), F.ceil(secs(F.col("__lo"), day_start_utc("greg_date", zone)) / step))
    k1 = F.least(k_max, F.ceil(secs(F.col("__lo"), day_start_utc(F.date_add("greg_date", 1), zone)) / step) - 1)
    days = days.select(*keys, "greg_date", (k1 - k0 + 1).cast("long").alias("n_intervals")).where(F.col("n_intervals") > 0)
    if not isinstance(step_minutes, int):
        days = days.groupBy(*keys, "greg_date").agg(F.sum("n_intervals").alias("n_intervals"))
    counts = actual.groupBy(*keys, local_day(ts, zone).alias("greg_date")).agg(
        F.count_if(F.col(flag) == "A").alias("__a"), F.count_if(F.col(flag) == "B").alias("__b"))
    j = days.join(counts, on=[*keys, "greg_date"], how="left")
    a, bad = F.coalesce("__a", F.lit(0)), F.coalesce("__b", F.lit(0))
    n = F.col("n_intervals")

    def pct(c: Column) -> Column:
        return F.round(c.cast("decimal(18,0)") * 100 / n.cast("decimal(18,0)"), 4).cast("double")

    out = j.select("greg_date", *keys, pct(a).alias("goodintvper"), pct(bad).alias("badintvper"),
                   pct(n - a - bad).alias("interpolper"), "n_intervals")
    return out.orderBy("greg_date", *keys) if ordered else out
