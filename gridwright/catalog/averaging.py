"""Averaging queries: every period kind, statistic and stage rule."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import functions as F

from gridwright.catalog.base import (
    table,
    DAYS_SQL,
    HOURLY_SQL,
    YEARS_SQL,
    days,
    hourly,
    query,
    register,
    years,
)
from gridwright.config import (
    AnchoredDays, AnchoredYear, MonthPeriod, QuarterPeriod, SeasonPeriod, WeekPeriod, YearPeriod,
    AveragingConfig,
    Completeness,
    FieldRule,
    Season,
    Stage,
    Statistic,
    clock,
    day,
)
from gridwright.functions.periods import slot_of, with_bounds
from gridwright.operators.averaging import (
    average,
    exact_median,
    off_grid_rows,
    period_calendar,
    series_violations,
    with_tiling,
)

HOUR = timedelta(hours=1)
DAY = timedelta(days=1)


def config(period, *, field="reading", stat=Statistic.ARITHMETIC_MEAN, threshold=0.75,
           keys=("event_type",), zone="UTC", interval=HOUR, duration=None):
    return AveragingConfig(
        "ts", interval, zone, (FieldRule(field, stat, weight_column=duration),),
        (Stage(period, Completeness(threshold)),), keys=keys,
    )


def period_sql(source, start, step, *, stat="CAST(sum(reading) AS DOUBLE) / count(reading)",
               threshold=0.75, key="event_type", seconds=3600, digits=None):
    """Calendar + left join + completeness, for periods on a UTC clock."""
    k = f"{key}, " if key else ""
    on = f"c.{key} = a.{key} AND " if key else ""
    group = "GROUP BY 1" if key else ""
    by = "GROUP BY 1, 2" if key else "GROUP BY 1"
    shown = f"c.{key}, " if key else ""
    value = f"CASE WHEN coalesce(a.n, 0) / (epoch(c.ps + {step}) - epoch(c.ps)) * {seconds} >= {threshold} THEN a.v END"
    if digits is not None:
        value = f"round({value}, {digits})"
    return f"""WITH {source[0]},
p AS (SELECT {k}{start} AS ps, reading FROM {source[1]}),
r AS (SELECT {k}min(ps) AS lo, max(ps) AS hi FROM p {group}),
c AS (SELECT {k}unnest(generate_series(lo, hi, {step})) AS ps FROM r),
a AS (SELECT {k}ps, count(reading) AS n, {stat} AS v FROM p {by})
SELECT {shown}c.ps AS "Period_Start", c.ps + {step} AS "Period_End", {value} AS reading
FROM c LEFT JOIN a ON {on}c.ps = a.ps"""


HOURLY = (HOURLY_SQL, "hourly")
DAYS = (DAYS_SQL, "days")


def averaged(source, cfg):
    return lambda spark, folder: average(source(spark, folder), cfg).table


@query(
    "average_millions_of_periods",
    """WITH r AS (SELECT epoch(min(o_orderdate)) AS lo, epoch(max(o_orderdate)) AS hi, count(DISTINCT o_orderdate) AS n FROM orders)
SELECT CAST((hi - lo) / 60 + 1 AS BIGINT) AS periods_evaluated, n AS values_accepted,
 CAST((hi - lo) / 60 + 1 AS BIGINT) - n AS values_rejected FROM r""",
)
def minutes(spark, folder):
    """One-minute periods over all order dates: more than three million."""
    cfg = AveragingConfig(
        "ts", timedelta(minutes=1), "UTC", (FieldRule("reading"),), (Stage(clock(minutes=1)),))
    return average(days(spark, folder), cfg).report.select(
        "periods_evaluated", "values_accepted", "values_rejected")


@query(
    "statistic_median_with_outlier",
    """WITH v AS (SELECT o_orderpriority, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 1e300 ELSE o_totalprice END AS x FROM orders)
SELECT o_orderpriority, median(x) AS m FROM v GROUP BY 1""",
)
def outlier(spark, folder):
    o = table(spark, folder, "orders")
    least = o.agg(F.min("o_orderkey")).scalar()
    x = F.when(F.col("o_orderkey") == least, F.lit(1e300)).otherwise(F.col("o_totalprice"))
    return exact_median(o.select("o_orderpriority", x.alias("x")), ["o_orderpriority"], "x", "m")


# Threshold 23 of 24 hours, so that some days are refused.
NEAR_FULL = 0.95

register(
    "flagship_daily_mean",
    averaged(
        lambda spark, folder: hourly(spark, folder).groupBy("ts").agg(
            F.sum("reading").alias("reading")
        ),
        config(day(), keys=()),
    ),
    period_sql(
        (HOURLY_SQL + ", total AS (SELECT ts, sum(reading) AS reading FROM hourly GROUP BY 1)",
         "total"),
        "date_trunc('day', ts)", "INTERVAL 1 DAY", key="",
    ),
)
register(
    "average_day_completeness",
    averaged(hourly, config(day(), threshold=NEAR_FULL)),
    period_sql(HOURLY, "date_trunc('day', ts)", "INTERVAL 1 DAY", threshold=NEAR_FULL),
)
register(
    "average_day_from_six",
    averaged(hourly, config(day(time(6, 0)), threshold=NEAR_FULL)),
    period_sql(
        HOURLY, "date_trunc('day', ts - INTERVAL 6 HOUR) + INTERVAL 6 HOUR", "INTERVAL 1 DAY",
        threshold=NEAR_FULL,
    ),
)
register(
    "average_clock_8h",
    averaged(hourly, config(clock(hours=8), threshold=0.9)),
    period_sql(
        HOURLY, "time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01')", "INTERVAL 8 HOUR",
        threshold=0.9,
    ),
)
register(
    "average_clock_6h_from_seven",
    averaged(hourly, config(clock(hours=6, day_start=time(7, 0)), threshold=0.9)),
    period_sql(
        HOURLY, "time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01 07:00:00')",
        "INTERVAL 6 HOUR", threshold=0.9,
    ),
)
register(
    "average_week_from_sunday",
    averaged(hourly, config(WeekPeriod(first_weekday=6))),
    period_sql(
        HOURLY, "date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY", "INTERVAL 7 DAY"
    ),
)
register(
    "average_month",
    averaged(days, config(MonthPeriod(), keys=(), interval=DAY)),
    period_sql(DAYS, "date_trunc('month', ts)", "INTERVAL 1 MONTH", key="", seconds=86400),
)
register(
    "average_quarter_from_february",
    averaged(
        days,
        config(QuarterPeriod(first_month=2), keys=(), interval=DAY),
    ),
    period_sql(
        DAYS, "date_trunc('quarter', ts - INTERVAL 1 MONTH) + INTERVAL 1 MONTH",
        "INTERVAL 3 MONTH", key="", seconds=86400,
    ),
)
register(
    "average_year_from_april",
    averaged(
        days, config(YearPeriod(first_month=4), keys=(), interval=DAY)
    ),
    period_sql(
        DAYS, "date_trunc('year', ts - INTERVAL 3 MONTH) + INTERVAL 3 MONTH", "INTERVAL 1 YEAR",
        key="", seconds=86400,
    ),
)
register(
    "average_fixed_30_days",
    averaged(
        days,
        config(
            AnchoredDays(length=timedelta(days=30), anchor=datetime(1996, 2, 10)
            ),
            keys=(), interval=DAY,
        ),
    ),
    period_sql(
        DAYS, "time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1996-02-10')", "INTERVAL 30 DAY",
        key="", seconds=86400,
    ),
)
register(
    "average_fixed_year",
    averaged(
        days,
        config(
            AnchoredYear(anchor=datetime(1996, 3, 1)), keys=(), interval=DAY
        ),
    ),
    period_sql(
        DAYS, "time_bucket(INTERVAL 365 DAY, ts, TIMESTAMP '1996-03-01')", "INTERVAL 365 DAY",
        key="", seconds=86400,
    ),
)

SEASONS = (
    Season("Northeast Monsoon", 12), Season("First Inter-monsoon", 3),
    Season("Southwest Monsoon", 5, 15), Season("Second Inter-monsoon", 10),
)
SEASON_SPEC = SeasonPeriod(seasons=SEASONS)
SEASON_SQL = """edges AS (
  SELECT make_date(y, m, d) + INTERVAL 0 HOUR AS ps,
         name || ' ' || y AS label
  FROM generate_series(1990, 2030) AS g(y),
       (VALUES ('Northeast Monsoon', 12, 1), ('First Inter-monsoon', 3, 1),
               ('Southwest Monsoon', 5, 15), ('Second Inter-monsoon', 10, 1)) AS s(name, m, d)),
seasons AS (SELECT ps, lead(ps) OVER (ORDER BY ps) AS pe, label FROM edges)"""

register(
    "average_season",
    averaged(days, config(SEASON_SPEC, keys=(), interval=DAY)),
    f"""WITH {DAYS_SQL}, {SEASON_SQL},
a AS (SELECT ps, pe, count(reading) AS n, CAST(sum(reading) AS DOUBLE) / count(reading) AS v
      FROM days JOIN seasons ON ts >= ps AND ts < pe GROUP BY 1, 2)
SELECT s.ps AS "Period_Start", s.pe AS "Period_End",
       CASE WHEN coalesce(n, 0) / (epoch(s.pe) - epoch(s.ps)) * 86400 >= 0.75 THEN v END AS reading
FROM seasons s LEFT JOIN a USING (ps)
WHERE s.ps BETWEEN (SELECT min(ps) FROM a) AND (SELECT max(ps) FROM a)""",
)


# Zones with daylight saving: 23- and 25-hour days.
def zone_day_sql(zone, threshold):
    wall = f"date_trunc('day', ts AT TIME ZONE 'UTC' AT TIME ZONE '{zone}')"


    def place(d):
        # A repeated midnight takes its earliest reading.
        x = f"(({d}) AT TIME ZONE '{zone}')"
        tries = " ".join(
            f"WHEN ({x} - INTERVAL {m} MINUTE) AT TIME ZONE '{zone}' = ({d}) "
            f"THEN ({x} - INTERVAL {m} MINUTE) AT TIME ZONE 'UTC'"
            for m in (60, 30)
        )
        return f"CASE {tries} ELSE {x} AT TIME ZONE 'UTC' END"

    return f"""WITH {YEARS_SQL},
p AS (SELECT {wall} AS d, reading FROM years),
c AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS d FROM p),
a AS (SELECT d, count(*) AS n, CAST(sum(reading) AS DOUBLE) / count(*) AS v FROM p GROUP BY 1),
b AS (SELECT d, {place('d')} AS ps, {place('d + INTERVAL 1 DAY')} AS pe FROM c)
SELECT b.ps AS "Period_Start", b.pe AS "Period_End",
       CASE WHEN coalesce(n, 0) / ((epoch(pe) - epoch(ps)) / 3600) >= {threshold} THEN v END AS reading
FROM b LEFT JOIN a USING (d)"""


for zone in ("America/New_York", "Asia/Colombo", "+05:30"):
    # An hour count from zones off by half an hour does not start on the UTC hour grid, so
    # those use half-hour input slots.
    half = zone != "America/New_York"
    name = {"+05:30": "offset_0530"}.get(zone, zone.split("/")[-1].lower())
    sql = zone_day_sql({"+05:30": "Asia/Kolkata"}.get(zone, zone), 0.05)
    register(
        f"average_day_zone_{name}",
        averaged(
            years,
            config(day(), threshold=0.05, keys=(), zone=zone,
                   interval=timedelta(minutes=30) if half else HOUR),
        ),
        sql.replace("/ 3600)", "/ 1800)") if half else sql,
    )


# Statistics.
STATISTICS = {
    Statistic.ARITHMETIC_MEAN: "CAST(sum(reading) AS DOUBLE) / count(reading)",
    Statistic.MINIMUM: "CAST(min(reading) AS DOUBLE)",
    Statistic.MAXIMUM: "CAST(max(reading) AS DOUBLE)",
    Statistic.SUM: "CAST(sum(reading) AS DOUBLE)",
    Statistic.RAINFALL_ACCUMULATION: "CAST(sum(reading) AS DOUBLE)",
    Statistic.MEDIAN: "quantile_cont(CAST(reading AS DOUBLE), 0.5)",
    Statistic.STANDARD_DEVIATION: "stddev_pop(CAST(reading AS DOUBLE))",
    Statistic.COUNT: "count(reading)",
    Statistic.RAIN_RATE_MEAN: "CAST(sum(reading) AS DOUBLE) / count(reading)",
    Statistic.ENERGY_AVERAGE_LEQ:
        "10 * log10(sum(pow(10, CAST(reading AS DOUBLE) / 10)) / count(reading))",
}

LEVEL_SQL = """levels AS (
  SELECT event_type, date_trunc('hour', ts) AS ts,
         CAST(40 + max(value) / 10 AS DECIMAL(10,3)) AS reading, CAST(count(*) AS DOUBLE) AS weight
  FROM events GROUP BY 1, 2)"""


def levels(spark, folder):
    """Sound-level-like series with a weight (seconds) per row."""
    from gridwright.catalog.base import table

    e = table(spark, folder, "events")
    return e.groupBy(
        "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(
        (F.lit(40) + F.max("value") / 10).cast("decimal(10,3)").alias("reading"),
        F.count("*").cast("double").alias("weight"),
    )


def rounded(source, cfg, digits):
    def build(spark, folder):
        t = average(source(spark, folder), cfg).table
        return t.withColumn("reading", F.round("reading", digits))

    return build


for stat, expr in STATISTICS.items():
    inexact = stat in (Statistic.STANDARD_DEVIATION, Statistic.ENERGY_AVERAGE_LEQ)
    src, text = (levels, (LEVEL_SQL, "levels")) if stat is Statistic.ENERGY_AVERAGE_LEQ else (
        hourly, HOURLY
    )
    cfg = config(day(), stat=stat, threshold=NEAR_FULL)
    register(
        f"statistic_{stat.value}",
        rounded(src, cfg, 6) if inexact else averaged(src, cfg),
        period_sql(
            text, "date_trunc('day', ts)", "INTERVAL 1 DAY", stat=expr, threshold=NEAR_FULL,
            digits=6 if inexact else None,
        ),
    )

register(
    "statistic_leq_weighted",
    rounded(
        levels,
        config(day(), stat=Statistic.ENERGY_AVERAGE_LEQ, threshold=NEAR_FULL, duration="weight"),
        6,
    ),
    period_sql(
        (LEVEL_SQL, "(SELECT * FROM levels)"), "date_trunc('day', ts)", "INTERVAL 1 DAY",
        stat="10 * log10(sum(weight * pow(10, CAST(reading AS DOUBLE) / 10)) / sum(weight))",
        threshold=NEAR_FULL, digits=6,
    ).replace("AS ps, reading FROM", "AS ps, reading, weight FROM"),
)


@query(
    "statistic_median_by_rank_selection",
    "SELECT event_type, quantile_cont(value, 0.5) AS median FROM events GROUP BY 1",
)
def median_by_rank(spark, folder):
    from gridwright.catalog.base import table

    return exact_median(table(spark, folder, "events"), ["event_type"], "value", "median")


# Calendar, labels, expected counts, tiling.
@query(
    "period_calendar_with_labels",
    f"""WITH {DAYS_SQL}, {SEASON_SQL}
SELECT ps AS period_start, pe AS period_end, label,
       CAST((epoch(pe) - epoch(ps)) / 86400 AS BIGINT) AS expected_days
FROM seasons WHERE pe > (SELECT min(ts) FROM days) AND ps <= (SELECT max(ts) FROM days)""",
)
def calendar(spark, folder):
    at = slot_of(SEASON_SPEC, F.col("ts"), "UTC")
    ranges = days(spark, folder).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    c = period_calendar(ranges, SEASON_SPEC, "UTC", [], label="label")
    elapsed = F.unix_micros("_end") - F.unix_micros("_start")
    return c.select(
        F.col("_start").alias("period_start"), F.col("_end").alias("period_end"), "label",
        F.call_function("div", elapsed, F.lit(86_400_000_000)).alias("expected_days"),
    )


LABELS = {
    "day": (day(), "strftime(ts, '%Y-%m-%d')"),
    "week": (
        WeekPeriod(first_weekday=2),
        "'Week ' || strftime(date_trunc('week', ts - INTERVAL 2 DAY) + INTERVAL 2 DAY, '%Y-%m-%d')",
    ),
    "month": (MonthPeriod(), "strftime(ts, '%Y-%m')"),
    "quarter": (QuarterPeriod(), "'Q' || quarter(ts) || ' ' || year(ts)"),
    "year": (
        YearPeriod(first_month=7, first_day=15),
        "'Year ' || CASE WHEN strftime(ts, '%m-%d') >= '07-15' THEN year(ts) ELSE year(ts) - 1 END"
        " || '-07-15'",
    ),
    "clock": (
        clock(hours=12),
        "strftime(ts, '%Y-%m-%dT') || CASE WHEN hour(ts) < 12 THEN '00:00:00+00:00 / ' ||"
        " strftime(ts, '%Y-%m-%dT') || '12:00:00+00:00' ELSE '12:00:00+00:00 / ' ||"
        " strftime(ts + INTERVAL 1 DAY, '%Y-%m-%dT') || '00:00:00+00:00' END",
    ),
}


@query(
    "period_labels",
    f"""WITH {YEARS_SQL}
SELECT ts, {', '.join(f'{sql} AS "{n}"' for n, (_, sql) in LABELS.items())} FROM years""",
)
def labels(spark, folder):
    df = years(spark, folder).select("ts")
    for n, (spec, _) in LABELS.items():
        df = df.withColumn("_slot", slot_of(spec, F.col("ts"), "UTC"))
        df = with_bounds(df, spec, "UTC", label=n).drop("_slot", "_start", "_end")
    return df


@query(
    "period_tiling_days_in_month",
    f"""WITH {DAYS_SQL},
m AS (SELECT DISTINCT date_trunc('month', ts) AS ps FROM days)
SELECT ps AS period_start, CAST(date_diff('day', ps, ps + INTERVAL 1 MONTH) AS BIGINT) AS components
FROM m""",
)
def tiles(spark, folder):
    month = MonthPeriod()
    slots = days(spark, folder).select(slot_of(month, F.col("ts"), "UTC").alias("_slot")).distinct()
    return with_tiling(with_bounds(slots, month, "UTC"), day(), "UTC").select(
        F.col("_start").alias("period_start"), F.col("_expected").alias("components")
    )


# Completeness records, reports, incremental stages.
@query(
    "completeness_records",
    f"""WITH {HOURLY_SQL},
p AS (SELECT event_type, date_trunc('day', ts) AS ps FROM hourly),
r AS (SELECT event_type, min(ps) AS lo, max(ps) AS hi FROM p GROUP BY 1),
c AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ps FROM r),
a AS (SELECT event_type, ps, count(*) AS n FROM p GROUP BY 1, 2)
SELECT CAST(1 AS BIGINT) AS stage_index, c.event_type, c.ps AS period_start,
       c.ps + INTERVAL 1 DAY AS period_end, f.field, coalesce(n, 0) AS valid_count,
       CAST(24 AS BIGINT) AS expected_count, coalesce(n, 0) / 24.0::DOUBLE AS availability,
       coalesce(n, 0) / 24.0::DOUBLE >= {NEAR_FULL} AS accepted, false AS used_two_of_three
FROM c LEFT JOIN a ON c.event_type = a.event_type AND c.ps = a.ps,
     (VALUES ('reading'), ('peak')) AS f(field)""",
)
def completeness(spark, folder):
    cfg = AveragingConfig(
        "ts", HOUR, "UTC",
        (FieldRule("reading"), FieldRule("peak", Statistic.MAXIMUM)),
        (Stage(day(), Completeness(NEAR_FULL)),), keys=("event_type",),
    )
    return average(hourly(spark, folder), cfg).completeness


EIGHT_HOUR_SQL = f"""{HOURLY_SQL},
p AS (SELECT event_type, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01') AS ps, reading
      FROM hourly),
r AS (SELECT event_type, min(ps) AS lo, max(ps) AS hi FROM p GROUP BY 1),
c AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 8 HOUR)) AS ps FROM r),
a AS (SELECT event_type, ps, count(*) AS n, CAST(sum(reading) AS DOUBLE) / count(*) AS v
      FROM p GROUP BY 1, 2),
eight AS (SELECT c.event_type, c.ps, CASE WHEN coalesce(n, 0) / 8.0::DOUBLE >= 1.0 THEN v END AS v
          FROM c LEFT JOIN a ON c.event_type = a.event_type AND c.ps = a.ps),
dayly AS (SELECT event_type, date_trunc('day', ps) AS ps, count(v) AS n,
                 CASE WHEN count(v) >= 2 THEN max(v) END AS v, count(v) = 2 AS two
          FROM eight GROUP BY 1, 2)"""

EIGHT_HOUR = AveragingConfig(
    "ts", HOUR, "UTC", (FieldRule("reading", Statistic.ARITHMETIC_MEAN),),
    (Stage(clock(hours=8), Completeness(1.0)), Stage(day(), Completeness(0.75, True))),
    keys=("event_type",),
)


@query(
    "incremental_two_of_three",
    f"""WITH {EIGHT_HOUR_SQL.replace('max(v) END', 'sum(v) / count(v) END')}
SELECT event_type, ps AS "Period_Start", ps + INTERVAL 1 DAY AS "Period_End",
       round(v, 6) AS reading, two AS decided_by_two_of_three FROM dayly""",
)
def two_of_three(spark, folder):
    stage = average(hourly(spark, folder), EIGHT_HOUR).stages[1]
    return stage.frame.select(
        "event_type", F.col("_start").alias("Period_Start"), F.col("_end").alias("Period_End"),
        F.round("reading", 6).alias("reading"), F.col("_two0").alias("decided_by_two_of_three"),
    )


@query(
    "incremental_leq_weighted_by_component",
    f"""WITH {DAYS_SQL},
lv AS (SELECT ts, 40 + CAST(reading AS DOUBLE) / 10000000 AS l FROM days),
m AS (SELECT date_trunc('month', ts) AS ps, count(*) AS n,
             10 * log10(sum(pow(10, l / 10)) / count(*)) AS v FROM lv GROUP BY 1),
c AS (SELECT unnest(generate_series(min(ps), max(ps), INTERVAL 1 MONTH)) AS ps FROM m),
s AS (SELECT c.ps, epoch(c.ps + INTERVAL 1 MONTH) - epoch(c.ps) AS w,
             CASE WHEN coalesce(n, 0) / ((epoch(c.ps + INTERVAL 1 MONTH) - epoch(c.ps)) / 86400)
                  >= 0.5 THEN v END AS v
      FROM c LEFT JOIN m USING (ps))
SELECT date_trunc('year', ps) AS "Period_Start", date_trunc('year', ps) + INTERVAL 1 YEAR AS "Period_End",
       CASE WHEN count(v) / 12.0::DOUBLE >= 0.5
            THEN round(10 * log10(sum(CASE WHEN v IS NOT NULL THEN w * pow(10, v / 10) END)
                 / sum(CASE WHEN v IS NOT NULL THEN w END)), 6) END AS level
FROM s GROUP BY 1""",
)
def leq_by_component(spark, folder):
    df = days(spark, folder).select(
        "ts", (F.lit(40) + F.col("reading").cast("double") / 10_000_000).alias("level")
    )
    cfg = AveragingConfig(
        "ts", DAY, "UTC", (FieldRule("level", Statistic.ENERGY_AVERAGE_LEQ),),
        (
            Stage(MonthPeriod(), Completeness(0.5)),
            Stage(YearPeriod(), Completeness(0.5)),
        ),
    )
    return average(df, cfg).table.withColumn("level", F.round("level", 6))


@query(
    "stage_report",
    f"""WITH {EIGHT_HOUR_SQL}
SELECT CAST(1 AS BIGINT) AS stage_index, 'Fixed Clock' AS label, 'fixed_clock' AS period_kind,
       count(*) AS periods_evaluated, count(v) AS values_accepted,
       count(*) - count(v) AS values_rejected FROM eight
UNION ALL
SELECT 2, 'Day', 'day', count(*), count(v), count(*) - count(v) FROM dayly""",
)
def report(spark, folder):
    return average(hourly(spark, folder), EIGHT_HOUR).report


# Input checks. Half-hour stamps and repeated rows are derived from the whole table.
@query(
    "averaging_input_violations",
    """WITH s AS (SELECT event_type, event_id, date_trunc('minute', ts) AS ts FROM events),
d AS (SELECT event_type, ts, count(*) AS n FROM s GROUP BY 1, 2),
o AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY event_id % 1000, event_id) AS p
      FROM s)
SELECT 'duplicate' AS kind, event_type, ts, n AS n_rows FROM d WHERE n > 1
UNION ALL
SELECT 'disorder', event_type, ts, 1 FROM o WHERE ts < p
UNION ALL
SELECT 'off_grid', event_type, ts, n FROM d WHERE minute(ts) % 30 <> 0""",
)
def violations(spark, folder):
    from gridwright.catalog.base import table

    e = table(spark, folder, "events")
    order = (F.col("event_id") % 1000) * F.lit(1 << 32) + F.col("event_id")
    df = e.select(
        "event_type", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("value"), order.alias("_ord"),
    )
    cfg = AveragingConfig(
        "ts", timedelta(minutes=30), "UTC", (FieldRule("value"),), (Stage(day()),),
        keys=("event_type",),
    )
    return series_violations(df, cfg)


@query(
    "averaging_off_grid_rows",
    f"""WITH {YEARS_SQL}
SELECT 'off_grid' AS kind, ts, CAST(1 AS BIGINT) AS n_rows FROM years WHERE hour(ts) % 4 <> 2""",
)
def off_grid(spark, folder):
    cfg = AveragingConfig(
        "ts", timedelta(hours=4), "UTC", (FieldRule("reading"),), (Stage(day(time(2, 0))),)
    )
    return off_grid_rows(years(spark, folder), cfg)
