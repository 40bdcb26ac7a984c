"""Whole plans: recipes, audited steps, split/join runs, streamed averaging, evidence."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridwright.catalog.averaging import HOURLY_SQL, period_sql
from gridwright.catalog.base import DIRTY_SQL, dirty, hourly, query, table
from gridwright.catalog.splitjoin import PAIR_SQL, prepared
from gridwright.config import (
    MonthPeriod,
    WeekPeriod,
    Action,
    AveragingConfig,
    Completeness,
    FieldRule,
    SplitJoinSpec,
    Stage,
    Statistic,
    day,
)
from gridwright.operators import cells, columns, moments
from gridwright.operators.averaging import average
from gridwright.operators.diagnostics import Diagnostics
from gridwright.plans.recipe import run_recipe, run_recipe_each
from gridwright.plans.split import publish_split_join, run_split_join
from gridwright.plans.steps import run_steps, step
from gridwright.session import materialize, shared_folder
from gridwright.sources import sinks, verify
from gridwright.streaming import periods


def monitoring(spark, folder):
    """Hourly text readings per event type as a logger would deliver them: UTC wall clock,
    markers and rubbish in the cells, a constant station name."""
    e = table(spark, folder, "events")
    h = e.groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("at")).agg(
        F.sum(F.col("value").cast("decimal(12,2)")).alias("v"), F.count("*").alias("n"),
        F.min("event_id").alias("_ord"),
    )
    text = (
        F.when(F.col("n") % 7 == 0, "N/A").when(F.col("n") % 5 == 0, "broken")
        .otherwise(F.col("v").cast("string"))
    )
    return h.select(
        "event_type", "_ord", F.date_format("at", "yyyy-MM-dd HH:mm").alias("When"),
        text.alias("NO2_ppm"), F.concat(F.lit("Site "), F.col("event_type")).alias("Station"),
        F.lit("x").alias("Unused"),
    )


LOGGER_SQL = """logger AS (
  SELECT event_type, ts, CASE WHEN n % 7 = 0 OR n % 5 = 0 THEN NULL ELSE v END AS v FROM (
    SELECT event_type, date_trunc('hour', ts) AS ts, sum(CAST(value AS DECIMAL(12,2))) AS v, count(*) AS n
    FROM events GROUP BY 1, 2))"""

REFORMAT = {
    "schema_version": 1,
    "mode": "reformat",
    "keys": ["event_type"],
    "source": {
        "file_type": "csv",
        "expected_columns": ["When", "NO2_ppm", "Station", "Unused"],
        "missing_markers": ["N/A", "-999"],
    },
    "columns": [
        {
            "source_name": "When", "output_name": "Local time",
            "transformations": [
                {"kind": "parse_datetime", "parameters": {"profile_id": "iso_minute"}},
                {"kind": "timezone_conversion", "parameters": {
                    "source_mode": "fixed_iana", "source_value": "UTC",
                    "target_zone": "Asia/Colombo"}},
                {"kind": "derive_interval_fields", "parameters": {
                    "start": False, "midpoint": False, "end": True, "role": "start"}},
                {"kind": "format_datetime", "parameters": {"profile_id": "iso_offset"}},
            ],
        },
        {
            "source_name": "NO2_ppm", "output_name": "NO2_ppb", "semantic_type": "Decimal",
            "transformations": [{"kind": "ppm_to_ppb"}],
        },
        {"source_name": "Station", "output_name": "Station"},
        {"source_name": "Unused", "output_name": "Unused", "export": False},
    ],
    "timestamp": {"column": "Local time", "role": "start", "duration_seconds": 3600},
    "missing_data": {"numeric_columns": ["NO2_ppb"]},
    "gap_policy": {
        "timestamp_column": "Local time", "interval_seconds": 3600,
        "measurement_columns": ["NO2_ppb"],
        "field_policies": [{"column": "Station", "behavior": "carry_stable"}],
        "allow_reorder": True,
    },
    "output": {"formats": ["csv"], "missing_policy": "true_null"},
}

REFORMATTED_SQL = f"""{LOGGER_SQL},
e AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM logger GROUP BY 1),
g AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e),
j AS (SELECT g.event_type, g.ts, l.v, l.ts AS seen FROM g LEFT JOIN logger l
      ON g.event_type = l.event_type AND g.ts = l.ts)"""


@query(
    "recipe_reformat",
    f"""WITH {REFORMATTED_SQL}
SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS "Local time",
       CAST(v * 1000 AS DOUBLE) AS "NO2_ppb", 'Site ' || event_type AS "Station",
       CASE WHEN seen IS NOT NULL THEN ts + INTERVAL 1 HOUR END AS "Local time End" FROM j""",
)
def recipe_reformat(spark, folder):
    return run_recipe(monitoring(spark, folder), REFORMAT).table


REMOVE = {
    **REFORMAT,
    "missing_data": {
        "numeric_columns": ["NO2_ppb"],
        "remove_null_rule": {"mode": "all_measurements_missing", "columns": ["NO2_ppb"]},
    },
    "output": {"formats": ["csv"], "missing_policy": "custom", "custom_missing_sentinel": "gone"},
}


@query(
    "recipe_reformat_removing_empty_rows",
    f"""WITH {REFORMATTED_SQL}
SELECT strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30' AS "Local time",
       'Site ' || event_type AS "Station" FROM j WHERE v IS NOT NULL""",
)
def recipe_removing(spark, folder):
    return run_recipe(monitoring(spark, folder), REMOVE).table.select("Local time", "Station")


AVERAGE = {
    "mode": "average",
    "keys": ["event_type"],
    "source": {
        "file_type": "csv",
        "expected_columns": ["When", "NO2_ppm", "Station", "Unused"],
        "missing_markers": ["N/A"],
    },
    "columns": [{"source_name": n, "output_name": n} for n in ("When", "NO2_ppm")],
    "timestamp": {
        "column": "When", "role": "start", "input_profile": "iso_minute",
        "source_timezone": "fixed_iana:UTC",
    },
    "aggregation": {
        "timestamp_column": "When", "input_interval_seconds": 3600, "reporting_timezone": "UTC",
        "fields": [{"column": "NO2_ppm", "output_name": "reading"}],
        "stages": [{"period": {"kind": "day"}, "completeness": {"threshold": 0.5}}],
    },
    "output": {"formats": ["csv"]},
}


@query(
    "recipe_average",
    period_sql(
        (LOGGER_SQL + ", s AS (SELECT event_type, ts, v AS reading FROM logger)", "s"),
        "date_trunc('day', ts)", "INTERVAL 1 DAY", threshold=0.5, digits=6,
    ),
)
def recipe_average(spark, folder):
    found = run_recipe(monitoring(spark, folder), AVERAGE).table
    return found.withColumn("reading", F.round("reading", 6))


STAGED = {
    **AVERAGE,
    "aggregation": {
        **AVERAGE["aggregation"],
        "approach": "incremental",
        "stages": [
            {"period": {"kind": "fixed_clock", "duration_seconds": 28800},
             "completeness": {"threshold": 0.5}},
            {"period": {"kind": "day"},
             "completeness": {"threshold": 0.75, "allow_two_of_three": True}},
        ],
    },
}


@query(
    "recipe_average_incremental",
    f"""WITH {LOGGER_SQL},
p AS (SELECT event_type, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01') AS ps, v FROM logger),
r AS (SELECT event_type, min(ps) AS lo, max(ps) AS hi FROM p GROUP BY 1),
c AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 8 HOUR)) AS ps FROM r),
a AS (SELECT event_type, ps, count(v) AS n, CAST(sum(v) AS DOUBLE) / count(v) AS v FROM p GROUP BY 1, 2),
e AS (SELECT c.event_type, c.ps, CASE WHEN coalesce(n, 0) >= 4 THEN v END AS v
      FROM c LEFT JOIN a ON c.event_type = a.event_type AND c.ps = a.ps)
SELECT event_type, date_trunc('day', ps) AS "Period_Start", date_trunc('day', ps) + INTERVAL 1 DAY AS "Period_End",
       round(CASE WHEN count(v) >= 2 THEN sum(v) / count(v) END, 6) AS reading
FROM e GROUP BY 1, 2, 3""",
)
def recipe_incremental(spark, folder):
    found = run_recipe(monitoring(spark, folder), STAGED).table
    return found.withColumn("reading", F.round("reading", 6))


@query(
    "clean_convert_average_daily",
    f"""WITH {DIRTY_SQL},
c AS (SELECT date_trunc('day', ts) AS ps, CASE WHEN regexp_matches(trim(reading), '^[0-9.]+$')
        THEN CAST(trim(reading) AS DECIMAL(18,2)) END AS pm FROM dirty),
r AS (SELECT unnest(generate_series(min(ps), max(ps), INTERVAL 1 DAY)) AS ps FROM c),
a AS (SELECT ps, count(*) AS n, count(pm) AS valid, CAST(sum(pm) AS DOUBLE) / count(pm) AS pm,
             CAST(sum(pm * 1000) AS DOUBLE) / count(pm) AS no2_ppb FROM c GROUP BY 1)
SELECT ps AS "Period_Start", valid, round(pm, 6) AS pm, round(no2_ppb, 6) AS no2_ppb FROM r LEFT JOIN a USING (ps)""",
)
def baseline_job(spark, folder):
    """Raw text rows: markers to null, ppm to ppb, daily means. Raw events are irregular, so
    the input interval is one microsecond, completeness is reported, not enforced, and events of
    one instant all count. A day without any row has no count, a day of invalid rows has 0."""
    df = dirty(spark, folder).select(F.col("ts").cast("timestamp").alias("ts"), "reading")
    df = cells.normalize_nulls(df, ["N/A", "-999", ""], ["reading"])
    df = cells.resolve_invalid_numbers(df, ["reading"], typed=True)
    df = cells.convert_concentration(df, "reading", "ppm_to_ppb", output="no2_ppb")
    cfg = AveragingConfig(
        "ts", timedelta(microseconds=1), "UTC",
        (FieldRule("reading", output_name="pm"), FieldRule("no2_ppb"),
         FieldRule("row", Statistic.COUNT, output_name="rows")),
        (Stage(day(), Completeness(1e-12)),),
    )
    stage = average(df.withColumn("row", F.lit(1)), cfg, strict=False).stages[0]
    return stage.frame.select(
        F.col("_start").alias("Period_Start"), F.when(F.col("rows") > 0, F.col("_n0")).alias("valid"),
        F.round("pm", 6).alias("pm"), F.round("no2_ppb", 6).alias("no2_ppb"),
    )


@query(
    "audited_steps",
    f"""WITH {DIRTY_SQL}
SELECT event_id AS id, date_trunc('minute', ts) AS utc_start, date_trunc('minute', ts) + INTERVAL 1 HOUR AS utc_end,
 CASE WHEN regexp_matches(trim(reading), '^[0-9.]+$') THEN CAST(CAST(trim(reading) AS DECIMAL(18,2)) * 1000 AS DOUBLE) END
   AS reading_ppb FROM dirty""",
)
def audited(spark, folder):
    df = dirty(spark, folder).select(
        "event_id", F.date_format(F.col("ts").cast("timestamp"), "MM/dd/yyyy").alias("date"),
        F.date_format(F.col("ts").cast("timestamp"), "HH:mm").alias("time"), "reading",
    )
    out, _ = run_steps(
        df,
        [
            step(cells.normalize_nulls, ["-999", "N/A"], ["reading"]),
            step(moments.parse_datetime, "date", "mdy_slash_date"),
            step(moments.parse_datetime, "time", "time_minute"),
            step(moments.combine_date_time, "date", "time", "utc_start"),
            step(moments.derive_intervals, "utc_start", "start", timedelta(hours=1),
                 start=None, midpoint=None, end="utc_end"),
            step(cells.convert_concentration, "reading", "ppm_to_ppb", output="reading_ppb"),
            step(cells.round_column, "reading_ppb", 2),
            step(columns.rename_column, "event_id", "id"),
            step(columns.select_columns, ["id", "utc_start", "utc_end", "reading_ppb"]),
        ],
    )
    return out


@query(
    "split_join_run_manifest",
    f"""WITH {PAIR_SQL}, j AS (SELECT ts FROM c FULL JOIN p USING (ts)),
m AS (SELECT date_trunc('week', ts) AS ps, count(*) AS "rows", min(ts) AS lo, max(ts) AS hi FROM j GROUP BY 1)
SELECT 'Joined_2files_Week ' || strftime(ps, '%Y-%m-%d') AS output,
 strftime(ps, '%Y-%m-%dT%H:%M:%S+00:00') AS period_start,
 strftime(ps + INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%S+00:00') AS period_end, "rows",
 strftime(lo, '%Y-%m-%dT%H:%M:%S+00:00') AS first_timestamp,
 strftime(hi, '%Y-%m-%dT%H:%M:%S+00:00') AS last_timestamp FROM m""",
)
def split_join_manifest(spark, folder):
    spec = SplitJoinSpec(Action.JOIN_FIELDS, period=WeekPeriod(), regroup=True)
    run = run_split_join(
        prepared(spark, folder, "click"), ["click", "others"], spec
    )
    target = f"{shared_folder(spark, 'split-join')}/run"
    return publish_split_join(spark, run, spec, target)


@query(
    "stream_average_by_day",
    period_sql(
        (HOURLY_SQL, "hourly"), "date_trunc('day', ts)", "INTERVAL 1 DAY", threshold=0.9, digits=6
    ),
)
def streamed(spark, folder):
    """A file stream over the hourly series, folded into partial windows, then averaged."""
    source, target = shared_folder(spark, "stream-in"), shared_folder(spark, "stream-out")
    hourly(spark, folder).repartition(4).write.parquet(source)
    schema = "event_type string, ts timestamp, reading decimal(22,2), peak double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    cfg = AveragingConfig(
        "ts", timedelta(hours=1), "UTC", (FieldRule("reading", Statistic.ARITHMETIC_MEAN),),
        (Stage(day(), Completeness(0.9)),), keys=("event_type",),
    )
    parts = periods.partial_windows(stream, cfg, base=timedelta(hours=3), delay="60 days")
    periods.start_partials(parts, target, shared_folder(spark, "stream-log")).awaitTermination()
    found = periods.average_partials(periods.latest_partials(spark, target, cfg.keys), cfg).table
    return found.withColumn("reading", F.round("reading", 6))


def refused(frame, words):
    """Whether working a frame out is refused with these words."""
    try:
        frame().write.format("noop").mode("overwrite").save()
    except Exception as error:  # the refusal is what is asked for
        return "refused" if words in str(error) else f"failed: {error}"
    return "accepted"


def stream_partials(spark, frame, schema, cfg, base):
    """Partial windows of a file stream over a frame written in four files."""
    source, target = shared_folder(spark, "stream-in"), shared_folder(spark, "stream-out")
    frame.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    parts = periods.partial_windows(stream, cfg, base=base, delay="3650 days")
    periods.start_partials(parts, target, shared_folder(spark, "stream-log")).awaitTermination()
    return periods.latest_partials(spark, target, cfg.keys)


@query(
    "stream_median_by_day",
    f"""WITH {HOURLY_SQL}, g AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n,
 median(CAST(reading AS DOUBLE)) AS reading, median(peak) AS peak FROM hourly GROUP BY 1, 2),
k AS (SELECT event_type, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM g GROUP BY 1)
SELECT k.event_type, d AS "Period_Start", d + INTERVAL 1 DAY AS "Period_End",
 CASE WHEN n >= 18 THEN reading END AS reading, CASE WHEN n >= 18 THEN peak END AS peak
FROM k LEFT JOIN g USING (event_type, d)""",
)
def streamed_median(spark, folder):
    """Exact medians of two fields from the values that streamed windows keep."""
    cfg = AveragingConfig(
        "ts", timedelta(hours=1), "UTC",
        (FieldRule("reading", Statistic.MEDIAN), FieldRule("peak", Statistic.MEDIAN)),
        (Stage(day(), Completeness(0.75)),), keys=("event_type",))
    schema = "event_type string, ts timestamp, reading decimal(22,2), peak double"
    parts = stream_partials(spark, hourly(spark, folder), schema, cfg, timedelta(hours=3))
    return periods.average_partials(parts, cfg).table


@query(
    "stream_refresh_of_late_rows",
    f"""WITH {HOURLY_SQL}, g AS (SELECT event_type, date_trunc('day', ts) AS d, count(*) AS n,
 sum(reading) AS reading FROM hourly GROUP BY 1, 2),
k AS (SELECT event_type, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM g GROUP BY 1),
late AS (SELECT DISTINCT event_type, date_trunc('day', ts) AS d FROM hourly WHERE dayofmonth(ts) = 9 AND extract(hour FROM ts) > 12)
SELECT k.event_type, d AS "Period_Start", d + INTERVAL 1 DAY AS "Period_End",
 CASE WHEN n >= 18 THEN round(CAST(reading AS DOUBLE), 6) END AS reading, late.d IS NOT NULL AS again
FROM k LEFT JOIN g USING (event_type, d) LEFT JOIN late USING (event_type, d)""",
)
def refreshed_by_late_rows(spark, folder):
    """Late rows of some days: only these days are worked out again; the result is that of all rows."""
    cfg = AveragingConfig(
        "ts", timedelta(hours=1), "UTC", (FieldRule("reading", Statistic.SUM),),
        (Stage(day(), Completeness(0.75)),), keys=("event_type",))
    source, target, log = (shared_folder(spark, f"stream-{x}") for x in ("in", "out", "log"))
    rows = hourly(spark, folder)
    late = (F.dayofmonth("ts") == 9) & (F.hour("ts") > 12)
    schema = "event_type string, ts timestamp, reading decimal(22,2), peak double"

    def arrive(frame):
        frame.repartition(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
        parts = periods.partial_windows(stream, cfg, base=timedelta(hours=3), delay="3650 days")
        periods.start_partials(parts, target, log).awaitTermination()
        return spark.read.parquet(target).agg(F.max("batch_id")).first()[0]

    seen = arrive(rows.where(~late))
    state = materialize(periods.refreshed(spark, target, cfg, None, -1), "state")
    arrive(rows.where(late))
    again = periods.dirty_periods(spark, target, cfg, seen)
    state = materialize(periods.refreshed(spark, target, cfg, state, seen), "state")
    found = periods.average_grouped(state, cfg).stages[0].frame.join(
        again.withColumn("again", F.lit(True)), ["event_type", "_slot"], "left")
    return found.select(
        "event_type", F.col("_start").alias("Period_Start"), F.col("_end").alias("Period_End"),
        F.round("reading", 6).alias("reading"), F.coalesce("again", F.lit(False)).alias("again"))


@query(
    "stream_refuses_repeated_instants",
    """SELECT 'daily' AS series, CASE WHEN count(*) > count(DISTINCT l_shipdate) THEN 'refused' ELSE 'accepted' END AS outcome
FROM lineitem UNION ALL SELECT 'distinct', 'accepted' FROM (SELECT DISTINCT l_shipdate FROM lineitem) HAVING count(*) > 0""",
)
def streamed_repeats(spark, folder):
    """A stream refuses what a batch refuses, wherever the second reading arrives."""
    rows = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").cast("double").alias("q"))
    cfg = AveragingConfig(
        "ts", timedelta(days=1), "UTC", (FieldRule("q"),), (Stage(MonthPeriod(), Completeness(0.1)),))
    once = rows.groupBy("ts").agg(F.sum("q").alias("q"))
    found = []
    for name, df in (("daily", rows), ("distinct", once)):
        parts = stream_partials(spark, df, "ts timestamp, q double", cfg, timedelta(days=1))
        found.append((name, refused(lambda p=parts: periods.average_partials(p, cfg).table, "repeated")))
    return spark.createDataFrame(found, "series string, outcome string")


RUNS = {
    "schema_version": 1, "recipe_name": "r", "mode": "average",
    "source": {"file_type": "csv", "expected_columns": ["At", "V"]},
    "columns": [{"source_name": n, "output_name": n} for n in ("At", "V")],
    "timestamp": {"column": "At", "role": "start", "input_profile": "iso_minute"},
    "aggregation": {
        "timestamp_column": "At", "input_interval_seconds": 3600, "reporting_timezone": "UTC",
        "allow_reorder": True, "fields": [{"column": "V"}], "stages": [{"period": {"kind": "day"}}]},
    "output": {"formats": ["csv"]},
}


@query(
    "batch_runs_isolated",
    """WITH h AS (SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY 1)
SELECT 'hourly' AS source, count(*) = count(DISTINCT t) AS passed, '' AS problem FROM h
UNION ALL SELECT 'repeated', max(n) < 2, 'repeated' FROM h
UNION ALL SELECT 'off_grid', count(*) = 0, 'grid' FROM h
UNION ALL SELECT 'unreadable', count(*) FILTER (extract(hour FROM t) = 5) = 0, '2024-' FROM h
UNION ALL SELECT 'other_columns', count(*) = 0, 'same source columns' FROM h""",
)
def isolated_runs(spark, folder):
    """One recipe over files of five kinds at once; each failing one has its own problem."""
    hour = F.date_trunc("hour", F.col("ts"))
    events = table(spark, folder, "events").select(hour.alias("t"), F.col("value").alias("V"))
    hours = events.groupBy("t").agg(F.sum("V").alias("V"))
    at = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    half = F.col("t") + F.expr("INTERVAL 30 MINUTE")
    broken = F.when(F.hour("t") == 5, F.concat(at(F.col("t")), F.lit("?"))).otherwise(at(F.col("t")))
    frames = {
        "hourly": hours.select(at(F.col("t")).alias("At"), "V"),
        "repeated": events.select(at(F.col("t")).alias("At"), "V"),
        "off_grid": hours.select(at(half).alias("At"), "V"),
        "unreadable": hours.select(broken.alias("At"), "V"),
        "other_columns": hours.select(at(F.col("t")).alias("At"), F.col("V").alias("W"))}
    words = {"hourly": "", "repeated": "repeated", "off_grid": "grid", "unreadable": "2024-",
             "other_columns": "same source columns"}
    base, sources = shared_folder(spark, "runs"), {}
    for name, frame in frames.items():
        sources[name] = f"{base}/in/{name}"
        sinks.write_delimited(frame, sources[name])
    found = run_recipe_each(spark, sources, RUNS, f"{base}/out")
    word = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])[F.col("source")]
    problem = F.coalesce("problem", F.lit(""))
    return found.select(
        "source", "passed", F.when(problem.contains(word), word).otherwise(problem).alias("problem"))


@query(
    "averaging_refuses_repeated_instants",
    """SELECT 'daily' AS series, CASE WHEN count(*) > count(DISTINCT l_shipdate) THEN 'refused' ELSE 'accepted' END AS outcome
FROM lineitem UNION ALL SELECT 'distinct', 'accepted' FROM (SELECT DISTINCT l_shipdate FROM lineitem) HAVING count(*) > 0""",
)
def repeated(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").cast("double").alias("q")
    )
    cfg = AveragingConfig(
        "ts", timedelta(days=1), "UTC", (FieldRule("q"),), (Stage(MonthPeriod(), Completeness(0.1)),)
    )
    once = rows.groupBy("ts").agg(F.sum("q").alias("q"))
    found = [
        (name, refused(lambda df=df: average(df, cfg).table, "repeated"))
        for name, df in (("daily", rows), ("distinct", once))
    ]
    return spark.createDataFrame(found, "series string, outcome string")


@query(
    "stream_deviation_in_colombo",
    f"""WITH {HOURLY_SQL}, big AS (SELECT event_type, ts, 1000000000 + CAST(reading AS DOUBLE) AS reading FROM hourly),
g AS (SELECT event_type, date_trunc('day', ts + INTERVAL 330 MINUTE) AS d, count(*) AS n, stddev_pop(reading) AS s FROM big GROUP BY 1, 2),
k AS (SELECT event_type, unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM g GROUP BY 1)
SELECT k.event_type, d - INTERVAL 330 MINUTE AS "Period_Start", d + INTERVAL 1110 MINUTE AS "Period_End",
 CASE WHEN n >= 12 THEN round(s, 3) END AS reading FROM k LEFT JOIN g USING (event_type, d)""",
)
def streamed_deviation(spark, folder):
    """Deviations of values around 10^9 over days that start at half an hour."""
    source, target = shared_folder(spark, "stream-in"), shared_folder(spark, "stream-out")
    big = F.col("reading").cast("double") + 1e9
    hourly(spark, folder).withColumn("reading", big).repartition(4).write.parquet(source)
    schema = "event_type string, ts timestamp, reading double, peak double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    cfg = AveragingConfig(
        "ts", timedelta(minutes=30), "Asia/Colombo",
        (FieldRule("reading", Statistic.STANDARD_DEVIATION),),
        (Stage(day(), Completeness(0.25)),), keys=("event_type",),
    )
    parts = periods.partial_windows(stream, cfg, base=timedelta(minutes=30), delay="60 days")
    periods.start_partials(parts, target, shared_folder(spark, "stream-log")).awaitTermination()
    found = periods.average_partials(periods.latest_partials(spark, target, cfg.keys), cfg).table
    return found.withColumn("reading", F.round("reading", 3))


@query(
    "processing_evidence",
    f"""WITH {REFORMATTED_SQL}
SELECT (SELECT count(*) FROM logger) AS input_rows, count(*) FILTER (WHERE v IS NOT NULL) AS output_rows,
 count(*) FILTER (WHERE seen IS NULL) AS generated_gap_rows, count(*) FILTER (WHERE v IS NULL) AS removed_rows,
 (SELECT count(*) FROM (SELECT count(*) AS n FROM events GROUP BY event_type, date_trunc('hour', ts))
  WHERE n % 7 <> 0 AND n % 5 = 0) AS invalid_values FROM j""",
)
def evidence(spark, folder):
    df = monitoring(spark, folder)
    notes = Diagnostics()
    result = run_recipe(df, REMOVE, notes=notes)
    path = shared_folder(spark, "evidence")
    text = sinks.apply_missing(result.table, "custom", "gone")
    text.write.option("header", "true").csv(path)
    counts = notes.counts()
    found = verify.processing_evidence(
        spark, input_rows=counts["input_rows"], input_columns=df.columns,
        output_rows=counts["output_rows"], output_columns=result.table.columns, counts=counts,
    )
    return found.select(
        "input_rows", "output_rows", "generated_gap_rows", "removed_rows", "invalid_values"
    )
