"""Wall clocks: back from wall time to the instant by the order of a series, and the offset between two stored clocks.

A wall time of the repeated hour of a fall-back day has two instants. They are told apart by evidence only: the
order of the readings of that day, or their place in it; a row without such evidence is flagged, not guessed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadgrid.functions.columns import LOCAL_ZONE, READ_MINUTES, utc_of_wall, wall_time
from loadgrid.operators.timeseries import day_start_utc, expected_intervals, local_day, step_seconds

PLAIN, FIRST, SECOND, UNRESOLVED, NONEXISTENT = "plain", "first", "second", "unresolved", "nonexistent"


def wall_candidates(wall: Column, zone: str = LOCAL_ZONE, shift_minutes: int = 60) -> tuple[Column, Column]:
    """The instants that show ``wall``: the earlier and the later one, equal where there is one, null where there is none
    (skipped in spring). ``shift_minutes``: how far the zone's clock is set."""
    shift = F.make_dt_interval(mins=F.lit(shift_minutes))
    at = utc_of_wall(wall, zone)
    shows = lambda t: wall_time(t, zone).eqNullSafe(wall)
    early = F.when(shows(at - shift), at - shift).when(shows(at), at)
    late = F.when(shows(at + shift), at + shift).when(shows(at), at)
    return early, late


def instants_by_order(df: DataFrame, keys: Sequence[str], wall: str, order: Sequence[str], zone: str = LOCAL_ZONE,
                      step_minutes: int | str = READ_MINUTES, position: str | None = None, name: str = "ts_utc",
                      status: str = "wall_status") -> DataFrame:
    """``df`` with the instant of each wall time and how it was found.

    ``order`` gives the sequence in which a series was recorded (a sequence number, an arrival time). Rows whose wall time has one
    instant are ``plain``. Inside the repeated hour, in this order of evidence:

    * place: ``position`` is the number of the reading in its local day, from 1, where given; else a row's number in the order
      serves, where the day has exactly its expected readings and all of them in place. The instant is day start plus place times step.
    * sequence: if the wall clock steps back (or stands still) exactly once in the day and within the repeated hour, rows before that are the
      ``first`` pass, the others the ``second``.
    * else ``unresolved``, instant null. Wall times that do not exist (spring) are ``nonexistent``, null.

    A null wall time has a null instant and is ``unresolved``. The work is per (series, wall day): one exchange, no series in one task.
    """
    keys, day = list(keys), "__day"
    early, late = wall_candidates(F.col(wall), zone)
    d = df.withColumn(day, F.to_date(wall)).withColumn("__a", early).withColumn("__b", late).repartition(*keys, day)
    w = Window.partitionBy(*keys, day).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    whole = Window.partitionBy(*keys, day)
    twice = F.col("__a") < F.col("__b")
    prev = F.lag(F.struct(F.col(wall).alias("wall"), twice.alias("twice"))).over(w)
    d = d.withColumn("__prev", prev)
    back = F.coalesce(F.col("__prev.wall") >= F.col(wall), F.lit(False))
    inside = back & F.col("__prev.twice") & twice
    d = d.withColumn("__back", back.cast("int")).withColumn("__inside", F.coalesce(inside, F.lit(False)).cast("int")).withColumn("__n", F.row_number().over(w))
    d = (d.withColumn("__before", F.sum("__back").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
          .withColumn("__backs", F.sum("__back").over(whole)).withColumn("__insides", F.sum("__inside").over(whole)))
    step = step_seconds(step_minutes)
    place = F.col(position) if position else F.col("__n")
    at = day_start_utc(day, zone) + F.make_dt_interval(secs=((place - 1) * step).cast("decimal(18,6)"))
    d = d.withColumn("__at", at)
    fits = (F.col("__at") == F.col("__a")) | (F.col("__at") == F.col("__b"))
    if position is None:
        full = (F.count(F.lit(1)).over(whole) == expected_intervals(day, zone, step_minutes)) & (F.count_if(F.coalesce(fits, F.lit(False))).over(whole) == F.count(F.lit(1)).over(whole))
        d = d.withColumn("__full", full)
        fits = fits & F.col("__full")
    once = (F.col("__backs") == 1) & (F.col("__insides") == 1)
    second = F.when(fits, F.col("__at") == F.col("__b")).when(once, F.col("__before") == 1)
    d = d.withColumn("__second", second)
    how = (F.when(F.col(wall).isNull(), UNRESOLVED).when(F.col("__a").isNull(), NONEXISTENT).when(~twice, PLAIN)
           .when(F.col("__second").isNull(), UNRESOLVED).when(F.col("__second"), SECOND).otherwise(FIRST))
    instant = F.when(~twice, F.col("__a")).when(F.col("__second"), F.col("__b")).when(~F.col("__second"), F.col("__a"))
    return d.select(*df.columns, instant.alias(name), how.alias(status))


# Verdicts of clock_offsets.
OK, OTHER_SEASON, SAME_CLOCK, TWICE, WRONG_ZONE, MIXED = "ok", "other_season", "same_clock", "converted_twice", "wrong_zone", "mixed"


def clock_offsets(df: DataFrame, site: Sequence[str], utc: str, local: str, zone: str = LOCAL_ZONE, least_share: float = 0.5) -> DataFrame:
    """Per (site, local day) the distance ``utc - local`` of two stored clock columns: ``n_rows``, ``n_offsets`` (distinct distances, in minutes),
    ``offset_minutes`` (the most frequent; of equally frequent ones the smallest), ``mode_share``, the zone's ``expected_first`` and ``expected_last``
    minutes that day (they differ on the days when clocks are set), and a ``verdict``:

    ``ok`` the mode is the zone's that day; ``other_season`` the zone's at the other end of the year (a clock that is not set); ``same_clock`` both
    columns hold the same clock; ``converted_twice`` twice the zone's; ``wrong_zone`` any other; ``mixed`` the mode has less than ``least_share``
    of the rows. Rows with a null clock are not counted. Two partial aggregations, the second on one row per distance.
    """
    site = list(site)
    far = F.timestamp_diff("MINUTE", F.col(local), F.col(utc)).cast("int")
    d = df.where(F.col(utc).isNotNull() & F.col(local).isNotNull()).select(*site, local_day(utc, zone).alias("day"), far.alias("__m"))
    per = d.groupBy(*site, "day", "__m").agg(F.count(F.lit(1)).alias("__n"))
    g = per.groupBy(*site, "day").agg(F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("n_offsets"),
                                      F.max(F.struct(F.col("__n"), (-F.col("__m")).alias("m"))).alias("__best"))
    offset = lambda t: F.timestamp_diff("MINUTE", wall_time(t, zone), t).cast("int")
    start, end = day_start_utc("day", zone), day_start_utc(F.date_add("day", 1), zone) - F.expr("INTERVAL 1 SECOND")
    g = g.withColumn("offset_minutes", -F.col("__best.m")).withColumn("mode_share", F.col("__best.__n") / F.col("n_rows"))
    g = g.withColumn("expected_first", offset(start)).withColumn("expected_last", offset(end))
    # The zone's offsets of that year: at its first of January and of July.
    season = [offset(day_start_utc(F.make_date(F.year("day"), F.lit(m), F.lit(1)), zone)) for m in (1, 7)]
    m = F.col("offset_minutes")
    now = (m == F.col("expected_first")) | (m == F.col("expected_last"))
    verdict = (F.when(F.col("mode_share") < least_share, MIXED).when(now, OK).when((m == season[0]) | (m == season[1]), OTHER_SEASON).when(m == 0, SAME_CLOCK)
               .when((m == 2 * F.col("expected_first")) | (m == 2 * F.col("expected_last")), TWICE).otherwise(WRONG_ZONE))
    return g.select(*site, "day", "n_rows", "n_offsets", "offset_minutes", "mode_share", "expected_first", "expected_last", verdict.alias("verdict"))
