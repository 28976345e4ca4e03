"""Queries on interval series with steps of their own, on wall clocks, on many intervals a key and on stored control and audit rows.

They register beside those of ``driver_queries``, with the same kind of DuckDB SQL. Events are readings: those of even users
are moved to the fall-back day of 2024, those of odd users to its spring day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loadgrid.plans import datasets
from loadgrid.plans.driver_queries import ORACLE, ZONE, _dbl, _read_params, _read_views, _t, _utc_sql, _views, query

_DAYS = {0: 300, 1: 60}
_SWITCH = {0: "2024-11-03 12:00:00", 1: "2024-03-10 12:00:00"}
_MOVED_SQL = f"""mv AS (SELECT event_id, user_id, event_type, value, ts + CASE WHEN user_id % 2 = 0 THEN INTERVAL {_DAYS[0]} DAY ELSE INTERVAL {_DAYS[1]} DAY END AS ts FROM events),
st AS (SELECT *, CAST(CASE WHEN user_id % 5 = 0 AND ts < CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '{_SWITCH[0]}' ELSE TIMESTAMP '{_SWITCH[1]}' END THEN 60
                           WHEN user_id % 3 = 0 THEN 15 WHEN user_id % 3 = 1 THEN 30 ELSE 60 END AS INTEGER) AS spi FROM mv)"""
_WALL = f"((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')"


def _floor_sql(t: str, m: str) -> str:
    return f"(date_trunc('day', {t}) + to_minutes(CAST(floor((hour({t}) * 60 + minute({t})) / {m}) * {m} AS INTEGER)))"


def _moved(spark, sf) -> DataFrame:
    """Events on both days when clocks are set, with the step (minutes) of their series; every fifth user's changes on that day."""
    e, even = _t(spark, sf, "events"), F.col("user_id") % 2 == 0
    at = F.when(even, F.col("ts") + F.expr(f"INTERVAL {_DAYS[0]} DAYS")).otherwise(F.col("ts") + F.expr(f"INTERVAL {_DAYS[1]} DAYS"))
    e = e.select("event_id", "user_id", "event_type", "value", at.alias("ts"))
    switch = F.when(even, F.lit(_SWITCH[0]).cast("timestamp_ntz")).otherwise(F.lit(_SWITCH[1]).cast("timestamp_ntz"))
    u = F.col("user_id")
    return e.withColumn("spi", F.when((u % 5 == 0) & (F.col("ts") < switch), 60).when(u % 3 == 0, 15).when(u % 3 == 1, 30).otherwise(60))


_SPI_SQL = f"""
WITH {_MOVED_SQL},
b AS (SELECT user_id, spi, {_floor_sql('ts', 'spi')} AS ts,
             CASE WHEN bool_or(event_type = 'error') AND user_id % 4 = 1 THEN NULL ELSE CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) END AS value,
             bool_or(event_type = 'error') AS bad FROM st GROUP BY user_id, spi, {_floor_sql('ts', 'spi')}),
runs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, spi) - row_number() OVER (PARTITION BY user_id, spi ORDER BY ts) AS run FROM b),
seg AS (SELECT user_id, spi, run, min(ts) AS lo, max(ts) AS last FROM runs GROUP BY user_id, spi, run),
seg2 AS (SELECT *, lead(lo) OVER (PARTITION BY user_id ORDER BY lo, last, spi) AS stop FROM seg),
g AS (SELECT user_id, spi, unnest(generate_series(lo, coalesce(stop - INTERVAL 1 SECOND, last), to_minutes(spi))) AS ts FROM seg2),
f AS (SELECT g.user_id, g.spi, g.ts, b.value, CASE WHEN b.user_id IS NULL THEN 'I' WHEN b.bad THEN 'B' ELSE 'A' END AS flag
      FROM g LEFT JOIN b ON g.user_id = b.user_id AND g.ts = b.ts AND g.spi = b.spi)"""


def _spi_readings(spark, sf) -> DataFrame:
    from loadgrid.operators.timeseries import floor_minutes
    b = _moved(spark, sf).groupBy("user_id", "spi", floor_minutes("ts", "spi").alias("ts")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"), F.max(F.col("event_type") == "error").alias("bad"))
    return b.withColumn("value", F.when(~(F.col("bad") & (F.col("user_id") % 4 == 1)), F.col("value"))).withColumn("f", F.when(F.col("bad"), "B").otherwise("A"))


@query("grid_gapfill_spi", _SPI_SQL + """,
n AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w1 AS pt, last_value(value IGNORE NULLS) OVER w1 AS pv,
             first_value(CASE WHEN value IS NOT NULL THEN ts END IGNORE NULLS) OVER w2 AS nt, first_value(value IGNORE NULLS) OVER w2 AS nv
      FROM f WINDOW w1 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    w2 AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, spi, ts, value, flag, CASE WHEN value IS NOT NULL THEN value
       ELSE pv + (nv - pv) * CAST(datediff('second', pt, ts) AS DOUBLE) / CAST(datediff('second', pt, nt) AS DOUBLE) END AS filled FROM n""")
def q_grid_gapfill_spi(spark, sf):
    from loadgrid.operators.timeseries import fill_between_readings
    return fill_between_readings(_spi_readings(spark, sf), ["user_id"], "ts", "value", "spi", flag="flag", name="filled", flag_col="f")


@query("time_grid_spi", _SPI_SQL + "\nSELECT user_id, spi, ts FROM g")
def q_time_grid_spi(spark, sf):
    from loadgrid.operators.timeseries import time_grid
    return time_grid(_spi_readings(spark, sf), ["user_id"], "ts", "spi")


@query("interp_share_spi", _SPI_SQL + f"""
SELECT CAST({_WALL} AS DATE) AS greg_date, user_id, round(100.0 * count(*) FILTER (WHERE flag = 'A') / count(*), 4) AS goodintvper,
       round(100.0 * count(*) FILTER (WHERE flag = 'B') / count(*), 4) AS badintvper, round(100.0 * count(*) FILTER (WHERE flag = 'I') / count(*), 4) AS interpolper,
       count(*) AS n_intervals
FROM f GROUP BY 1, 2""")
def q_interp_share_spi(spark, sf):
    from loadgrid.operators.timeseries import interval_shares_from_readings
    return interval_shares_from_readings(_spi_readings(spark, sf), ["user_id"], "ts", "f", "spi", ZONE)


_MIDNIGHT = _utc_sql("CAST({0} AS TIMESTAMP)")


@query("day_completeness_spi", _SPI_SQL + f""",
d AS (SELECT user_id, CAST({_WALL} AS DATE) AS day, ts FROM b),
c AS (SELECT user_id, day, count(*) AS interval_count, count(DISTINCT date_trunc('hour', ts)) AS hour_count, count(DISTINCT date_trunc('hour', {_WALL})) AS wall_hour_count
      FROM d GROUP BY user_id, day),
span AS (SELECT user_id, {_MIDNIGHT.format('min(day)')} AS a, {_MIDNIGHT.format('max(day) + INTERVAL 1 DAY')} AS z, min(day) AS d0, max(day) AS d1 FROM d GROUP BY user_id),
days AS (SELECT user_id, CAST(unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM span),
wide AS (SELECT s.user_id, s.spi, s.lo, CASE WHEN s.lo = min(s.lo) OVER (PARTITION BY s.user_id) THEN span.a ELSE s.lo END AS a, coalesce(s.stop, span.z) AS z
         FROM seg2 s JOIN span ON s.user_id = span.user_id),
pts AS (SELECT user_id, a, z, unnest(generate_series(lo - to_minutes(spi * CAST(floor((epoch(lo) - epoch(a)) / (60 * spi)) AS INTEGER)), z, to_minutes(spi))) AS ts FROM wide),
want AS (SELECT user_id, CAST({_WALL} AS DATE) AS day, count(*) AS n FROM pts WHERE ts >= a AND ts < z GROUP BY 1, 2)
SELECT days.day, days.user_id, coalesce(interval_count, 0) AS interval_count, coalesce(hour_count, 0) AS hour_count, coalesce(wall_hour_count, 0) AS wall_hour_count,
       CAST(want.n AS INTEGER) AS expected_intervals, want.n - coalesce(interval_count, 0) AS deficit
FROM days LEFT JOIN c ON days.user_id = c.user_id AND days.day = c.day LEFT JOIN want ON days.user_id = want.user_id AND days.day = want.day""")
def q_day_completeness_spi(spark, sf):
    from loadgrid.operators.timeseries import completeness
    return completeness(_spi_readings(spark, sf), ["user_id"], "ts", ZONE, "spi")


@query("reads_to_grid", f"""
WITH {_MOVED_SQL},
r AS (SELECT user_id, date_trunc('second', ts) AS ts, CAST(round(CAST(value AS DECIMAL(28,6)) * 1000000) AS BIGINT) AS u, CAST(spi * 60 AS BIGINT) AS len,
             CAST(CASE user_id % 4 WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 240 END AS INTEGER) AS step FROM st),
a AS (SELECT *, {_floor_sql('ts', 'step')} AS first, datediff('second', {_floor_sql('ts', 'step')}, ts) AS off, step * 60 AS s FROM r),
k AS (SELECT *, unnest(range(0, CAST(ceil((off + len) / s) AS BIGINT))) AS k FROM a),
p AS (SELECT user_id, step, first + to_seconds(k * s) AS ts, u * least(len, (k + 1) * s - off) // len - u * greatest(0, k * s - off) // len AS part FROM k)
SELECT user_id, step, ts, CAST(CAST(sum(part) AS DECIMAL(28,6)) / 1000000 AS DOUBLE) AS value FROM p GROUP BY user_id, step, ts""")
def q_reads_to_grid(spark, sf):
    from loadgrid.operators.timeseries import split_to_grid
    u = F.col("user_id") % 4
    r = _moved(spark, sf).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz")).withColumn("step", F.when(u == 0, 15).when(u == 1, 30).when(u == 2, 60).otherwise(240))
    return split_to_grid(r, ["user_id", "step"], "ts", "value", "spi", "step").withColumn("value", F.col("value").cast("double"))


# ------------------------------------------------------------------ wall clocks

_SLOTS_SQL = f"""
WITH {_MOVED_SQL},
s0 AS (SELECT user_id % 40 AS site, {_floor_sql('ts', '15')} AS ts FROM st GROUP BY 1, 2),
s AS (SELECT * FROM s0 WHERE site >= 20 UNION ALL
      SELECT site, unnest(generate_series(min(ts), max(ts), INTERVAL 15 MINUTE)) FROM s0 WHERE site < 20 GROUP BY site),
q AS (SELECT *, {_WALL} AS wall, row_number() OVER (PARTITION BY site ORDER BY ts) AS seq FROM s)"""


def _slots(spark, sf) -> DataFrame:
    """15-minute slots of 40 sites with their wall time and a running number, as a recorder without an offset stores them: all slots from
    the first to the last reading for half of the sites, for the others those with a reading."""
    from pyspark.sql import Window
    from loadgrid.functions.columns import wall_time
    from loadgrid.operators.timeseries import floor_minutes, time_grid
    s = _moved(spark, sf).select((F.col("user_id") % 40).alias("site"), floor_minutes("ts", 15).alias("ts")).distinct()
    s = s.where("site >= 20").unionByName(time_grid(s.where("site < 20"), ["site"], "ts", 15))
    return s.withColumn("wall", wall_time("ts", ZONE)).withColumn("seq", F.row_number().over(Window.partitionBy("site").orderBy("ts")).cast("long"))


@query("wall_round_trip", _SLOTS_SQL + f""",
c AS (SELECT *, CAST(wall AS DATE) AS day FROM q),
m AS (SELECT *, CASE WHEN ((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}') = (((ts - INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}') THEN ts - INTERVAL 1 HOUR ELSE ts END AS early,
             CASE WHEN ((ts AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}') = (((ts + INTERVAL 1 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}') THEN ts + INTERVAL 1 HOUR ELSE ts END AS late FROM c),
l AS (SELECT *, early < late AS twice, lag(wall) OVER w AS pw, lag(early < late) OVER w AS ptw, row_number() OVER w AS rn, count(*) OVER (PARTITION BY site, day) AS cnt
      FROM m WINDOW w AS (PARTITION BY site, day ORDER BY seq)),
e AS (SELECT *, coalesce(pw >= wall, false) AS back, coalesce(pw >= wall AND ptw AND twice, false) AS inside, {_MIDNIGHT.format('day')} + to_minutes(15 * CAST(rn - 1 AS INTEGER)) AS place,
             CAST((epoch({_MIDNIGHT.format('day + INTERVAL 1 DAY')}) - epoch({_MIDNIGHT.format('day')})) / 900 AS INTEGER) AS want FROM l),
z AS (SELECT *, sum(CAST(back AS INTEGER)) OVER (PARTITION BY site, day ORDER BY seq) AS before, sum(CAST(back AS INTEGER)) OVER (PARTITION BY site, day) AS backs,
             sum(CAST(inside AS INTEGER)) OVER (PARTITION BY site, day) AS insides,
             cnt = want AND count(*) FILTER (WHERE place = early OR place = late) OVER (PARTITION BY site, day) = cnt AS full_day FROM e),
v AS (SELECT *, CASE WHEN full_day THEN place = late WHEN backs = 1 AND insides = 1 THEN before = 1 END AS second FROM z)
SELECT site, ts, wall, CASE WHEN NOT twice THEN 'plain' WHEN second IS NULL THEN 'unresolved' WHEN second THEN 'second' ELSE 'first' END AS wall_status,
       CASE WHEN NOT twice THEN early WHEN second THEN late WHEN NOT second THEN early END AS ts_utc,
       coalesce(CASE WHEN NOT twice THEN early WHEN second THEN late WHEN NOT second THEN early END = ts, false) AS same FROM v""")
def q_wall_round_trip(spark, sf):
    from loadgrid.operators.clocks import instants_by_order
    out = instants_by_order(_slots(spark, sf), ["site"], "wall", ["seq"], ZONE, 15)
    return out.select("site", "ts", "wall", "wall_status", "ts_utc", F.coalesce(F.col("ts_utc") == F.col("ts"), F.lit(False)).alias("same"))


def _at(zone: str, t: str) -> str:
    return f"(({t} AT TIME ZONE 'UTC') AT TIME ZONE '{zone}')"


_OFF = "CAST((epoch({1}) - epoch({0})) / 60 AS INTEGER)"
_YEAR = [_OFF.format(_at(ZONE, t), t) for t in (_MIDNIGHT.format(f"make_date(CAST(year(day) AS INTEGER), {m}, 1)") for m in (1, 7))]


@query("clock_offsets", f"""
WITH {_MOVED_SQL},
r AS (SELECT user_id % 20 AS site, ts, CASE WHEN user_id % 20 % 5 = 1 THEN {_at('America/Chicago', 'ts')} WHEN user_id % 20 % 5 = 2 THEN ts
                  WHEN user_id % 20 % 5 = 3 THEN {_at(ZONE, _at(ZONE, 'ts'))} WHEN user_id % 20 % 5 = 4 THEN ts - INTERVAL 5 HOUR ELSE {_at(ZONE, 'ts')} END AS local,
             CAST({_WALL} AS DATE) AS day FROM st),
o AS (SELECT site, day, CAST(trunc((epoch(ts) - epoch(local)) / 60) AS INTEGER) AS m, count(*) AS n FROM r GROUP BY 1, 2, 3),
g AS (SELECT site, day, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_offsets, arg_max(m, n * 100000 - m) AS offset_minutes, max(n) AS most FROM o GROUP BY 1, 2),
x AS (SELECT *, CAST(most AS DOUBLE) / n_rows AS mode_share, {_OFF.format(_at(ZONE, _MIDNIGHT.format('day')), _MIDNIGHT.format('day'))} AS expected_first,
             {_OFF.format(_at(ZONE, "(" + _MIDNIGHT.format('day + INTERVAL 1 DAY') + " - INTERVAL 1 SECOND)"), "(" + _MIDNIGHT.format('day + INTERVAL 1 DAY') + " - INTERVAL 1 SECOND)")} AS expected_last FROM g)
SELECT site, day, n_rows, n_offsets, offset_minutes, mode_share, expected_first, expected_last,
       CASE WHEN mode_share < 0.5 THEN 'mixed' WHEN offset_minutes IN (expected_first, expected_last) THEN 'ok' WHEN offset_minutes IN ({_YEAR[0]}, {_YEAR[1]}) THEN 'other_season'
            WHEN offset_minutes = 0 THEN 'same_clock' WHEN offset_minutes IN (2 * expected_first, 2 * expected_last) THEN 'converted_twice' ELSE 'wrong_zone' END AS verdict FROM x""")
def q_clock_offsets(spark, sf):
    from loadgrid.functions.columns import wall_time
    from loadgrid.operators.clocks import clock_offsets
    s = F.col("site") % 5
    r = _moved(spark, sf).withColumn("site", F.col("user_id") % 20)
    local = (F.when(s == 1, wall_time("ts", "America/Chicago")).when(s == 2, F.col("ts")).when(s == 3, wall_time(wall_time("ts", ZONE), ZONE))
             .when(s == 4, F.col("ts") - F.expr("INTERVAL 5 HOURS")).otherwise(wall_time("ts", ZONE)))
    return clock_offsets(r.withColumn("local", local), ["site"], "ts", "local", ZONE)


# ------------------------------------------------------------------ many intervals a key

_HOURS_SQL = """
WITH h AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY 1, 2),
iv AS (SELECT event_type AS kind, h AS start, CASE WHEN n % 7 = 0 THEN NULL WHEN n % 5 = 0 THEN TIMESTAMP '9999-12-31 00:00:00' ELSE h + to_minutes(CAST(15 * (n % 9) AS INTEGER)) END AS stop FROM h),
f AS (SELECT event_id, event_type, date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 15) * 15 AS INTEGER)) AS at FROM events)
SELECT f.event_id, f.event_type, count(iv.start) AS n_intervals, min(iv.start) AS first_start, max(iv.start) AS last_start
FROM f {how} JOIN iv ON f.event_type = iv.kind AND iv.start <= f.at AND f.at {upper} iv.stop GROUP BY f.event_id, f.event_type"""


def _indexed(spark, sf, **options) -> DataFrame:
    """Events against an interval for every hour of their type, short, empty, open and endless ones: some hundred intervals a key."""
    from loadgrid.operators.intervals import interval_index_join
    from loadgrid.operators.timeseries import floor_minutes
    e = _t(spark, sf, "events")
    n, h = F.col("n"), F.col("start")
    stop = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).otherwise(h + F.make_dt_interval(mins=(15 * (n % 9)).cast("int")))
    iv = e.groupBy(F.col("event_type").alias("kind"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n")).select("kind", "start", stop.alias("stop"))
    f = e.select("event_id", "event_type", floor_minutes("ts", 15).alias("at"))
    j = interval_index_join(f, iv, [("event_type", "kind")], "at", "start", "stop", **options)
    return j.groupBy("event_id", "event_type").agg(F.count("start").alias("n_intervals"), F.min("start").alias("first_start"), F.max("start").alias("last_start"))


@query("interval_index_halfopen", _HOURS_SQL.format(how="", upper="<"))
def q_interval_index_halfopen(spark, sf):
    return _indexed(spark, sf)


@query("interval_index_closed", _HOURS_SQL.format(how="", upper="<="))
def q_interval_index_closed(spark, sf):
    return _indexed(spark, sf, closed=True)


@query("interval_index_left", _HOURS_SQL.format(how="LEFT", upper="<"))
def q_interval_index_left(spark, sf):
    return _indexed(spark, sf, how="left")


@query("power_billing_indexed", ORACLE["power_billing"])
def q_power_billing_indexed(spark, sf):
    return datasets.power_billing(_read_views(spark, sf), _read_params(interval_index=True))


@query("mass_market_not_nm_indexed", ORACLE["mass_market_not_nm"])
def q_mass_market_not_nm_indexed(spark, sf):
    return datasets.mass_market_not_nm(_read_views(spark, sf), _read_params(interval_index=True))


# ------------------------------------------------------------------ chains of premises with very many rows

@query("interval_chain_spread", ORACLE["interval_chain"])
def q_interval_chain_spread(spark, sf):
    return _dbl(datasets.utility_meter_intervals(_views(spark, sf), exclude_premises=(1,), spread="month"), "metermtpl")


@query("meters_pb_spread", ORACLE["meters_pb"])
def q_meters_pb_spread(spark, sf):
    return _dbl(datasets.meters_pb(_read_views(spark, sf), _read_params(spread_chains="month")), "metermtpl")


# ------------------------------------------------------------------ control files, audit table and specified runs, in files of the shared folder

def _folder(spark, name: str) -> str:
    import uuid
    from loadgrid.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


@query("control_totals_files", ORACLE["control_totals"])
def q_control_totals_files(spark, sf):
    """The declared side goes through hidden control files, one a day, and is read back from them."""
    from loadgrid.operators.audit import control_totals
    from loadgrid.sources.files import read_control_files
    from loadgrid.sources.named_files import write_named
    o = _t(spark, sf, "orders").withColumn("file_date", F.col("o_orderdate").cast("date"))
    declared = o.where(F.col("o_orderpriority") != "5-LOW").groupBy("file_date").agg(F.sum(F.when(F.col("o_orderstatus") == "P", 2).otherwise(1)).alias("n"))
    path = _folder(spark, "control")
    write_named(declared.select(F.concat(F.lit("_SUCCESS_"), F.date_format("file_date", "yyyyMMdd")).alias("name"), F.concat(F.col("n").cast("string"), F.lit("\n")).alias("body")), path)
    read = read_control_files(spark, path, r"_SUCCESS_(\d{8})$", name_regex=r"^_SUCCESS_\d{8}$", hidden=True).withColumn("file_date", F.to_date("file_date", "yyyyMMdd"))
    return control_totals(read, o.where(F.col("o_orderpriority") != "4-NOT SPECIFIED"), "file_date")


@query("audit_gate_published", ORACLE["audit_gate"])
def q_audit_gate_published(spark, sf):
    """Two appends, the first one tried twice, then the gate over the table."""
    from loadgrid.operators.audit import audit_gate
    from loadgrid.sources.audit_store import publish_audit, published_audit
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    none = F.lit(None).cast("string")
    a = o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_custkey").cast("string"), F.col("c_mktsegment"), F.col("o_orderdate").cast("date"), F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz"),
        F.when(F.col("o_orderstatus") == "P", "error").otherwise("success"), F.lit(1).cast("long"), F.col("o_orderkey").cast("string"), none,
        F.when(F.col("o_orderpriority") == "1-URGENT", "target-write").otherwise("transform")).toDF(*[f"c{i}" for i in range(10)])
    path = _folder(spark, "audit-table")
    writes = F.col("c9") == "target-write"
    for part, append_id in ((a.where(writes), "run-1/target-write"), (a.where(~writes), "run-1/transform"), (a.where(writes), "run-1/target-write")):
        publish_audit(spark, part, path, append_id)
    runs = c.select(F.col("c_custkey").cast("string").alias("audit_id"), F.col("c_mktsegment").alias("etl_process_detail_id"), (F.col("c_custkey") % 4 + 1).cast("int").alias("expected_steps"))
    return audit_gate(runs, published_audit(spark, path), expected_steps="expected_steps")


_SPEC = ("study", "study_premise", "uevcust", "meters")


@query("spec_run", "SELECT t.* FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS target, CAST({i} AS INTEGER) AS process_order, count(*) AS rows FROM ({ORACLE[q]})"
    for n, i, q in (("study", 2, "study_active"), ("study_premise", 3, "scope_premises"), ("meters", 6, "envelope_3branch"), ("uevcust", 8, "latest_per_key"))) + ") t")
def q_spec_run(spark, sf):
    """Four datasets from a specification, the run started again after two: the manifest has each once."""
    import uuid
    from loadgrid.plans.driver_queries import ACCOUNT_CUTOFF, RUN_DATE
    from loadgrid.plans.spec import RunSpec, parse_spec, run_manifest, run_spec, spec_text
    spec = parse_spec(spec_text("daily", {"run_date": RUN_DATE, "company": "FPL", "exclude_premises": (1,)}, list(_SPEC)))
    own = {"uevcust": (("run_date", ACCOUNT_CUTOFF),)}
    spec = RunSpec(spec.mode, tuple(type(s)(s.dataset, s.process_order, s.target, own.get(s.dataset, ())) for s in spec.steps), spec.parameters)
    tables, run_id = _views(spark, sf), uuid.uuid4().hex
    run_spec(spark, tables, RunSpec(spec.mode, spec.steps[:2], spec.parameters), run_id)
    run_spec(spark, tables, spec, run_id)
    return run_manifest(spark, "daily", run_id).select("target", "process_order", "rows")
