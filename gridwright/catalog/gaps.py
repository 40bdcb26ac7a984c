"""Gap queries on hourly keyed series, multi-year hours and calendar days."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridwright.catalog.base import HOURLY_SQL, YEARS_SQL, hourly, query, table, years
from gridwright.config import Derivation, GapBehavior, GapConfig, GapField
from gridwright.operators import gaps

HOURS = GapConfig("ts", timedelta(hours=1), ("reading", "peak"), keys=("event_type",))
# Four-hour steps over hourly instants: three quarters of the rows are off the grid.
FOUR = GapConfig("ts", timedelta(hours=4), ("reading",))

GRID_SQL = f"""{HOURLY_SQL},
e AS (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1),
grid AS (SELECT event_type, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM e)"""

FOUR_SQL = f"""{YEARS_SQL},
grid AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOUR)) AS ts FROM years)"""


@query(
    "gap_interval_suggestion",
    f"""WITH {HOURLY_SQL},
d AS (SELECT event_type, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)) AS s FROM hourly),
n AS (SELECT event_type, s, count(*) AS n FROM d WHERE s IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, s) AS r,
      sum(n) OVER (PARTITION BY event_type) AS total FROM n)
SELECT event_type, CAST(s AS DOUBLE) AS interval_seconds, n AS matching_steps, CAST(total AS BIGINT) AS total_steps,
       n / total AS confidence, CASE WHEN s = 3600 THEN '1 hour' ELSE 'Custom' END AS label FROM r WHERE r = 1""",
)
def suggestion(spark, folder):
    return gaps.suggest_interval(hourly(spark, folder), "ts", ["event_type"])


@query("gap_expected_grid", f"WITH {GRID_SQL} SELECT event_type, ts FROM grid")
def grid(spark, folder):
    return gaps.expected_grid(hourly(spark, folder), HOURS)


@query(
    "gap_grid_of_millions",
    """WITH r AS (SELECT epoch(min(o_orderdate)) AS lo, epoch(max(o_orderdate)) AS hi, count(DISTINCT o_orderdate) AS n FROM orders)
SELECT CAST((hi - lo) / 60 + 1 AS BIGINT) AS expected, CAST((hi - lo) / 60 + 1 AS BIGINT) - n AS missing FROM r""",
)
def millions(spark, folder):
    """A minute grid over all order dates: more than three million slots."""
    o = table(spark, folder, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"))
    minutes = GapConfig("ts", timedelta(minutes=1))
    expected = gaps.expected_grid(o, minutes).agg(F.count(F.lit(1)).alias("expected"))
    missing = gaps.missing_timestamps(o, minutes).agg(F.count(F.lit(1)).alias("missing"))
    return expected.select("expected", missing.scalar().alias("missing"))


@query(
    "gap_missing_timestamps",
    f"WITH {GRID_SQL} SELECT event_type, ts FROM grid ANTI JOIN hourly USING (event_type, ts)",
)
def missing(spark, folder):
    return gaps.missing_timestamps(hourly(spark, folder), HOURS)


@query(
    "gap_missing_with_off_grid_rows",
    f"WITH {FOUR_SQL} SELECT ts FROM grid ANTI JOIN years USING (ts)",
)
def missing_four(spark, folder):
    return gaps.missing_timestamps(years(spark, folder), FOUR)


@query(
    "gap_spans",
    f"""WITH {HOURLY_SQL},
l AS (SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nx FROM hourly)
SELECT event_type, ts AS previous, nx AS "next",
       CAST((epoch(nx) - epoch(ts)) / 3600 AS BIGINT) - 1 AS missing_count
FROM l WHERE nx > ts + INTERVAL 1 HOUR""",
)
def spans(spark, folder):
    return gaps.gap_spans(hourly(spark, folder), HOURS)


SECONDS_SQL = "s AS (SELECT event_id, event_type, date_trunc('hour', ts) AS ts FROM events)"


def stamps(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    )


@query(
    "gap_duplicate_groups",
    f"""WITH {SECONDS_SQL}
SELECT event_type, ts, count(*) AS n_rows FROM s GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicates(spark, folder):
    return gaps.duplicate_groups(stamps(spark, folder), "ts", ["event_type"])


@query(
    "gap_duplicate_rows",
    f"""WITH {SECONDS_SQL}, d AS (SELECT *, count(*) OVER (PARTITION BY event_type, ts) AS n_rows FROM s)
SELECT event_type, ts, event_id, n_rows FROM d WHERE n_rows > 1""",
)
def duplicate_rows(spark, folder):
    return gaps.duplicate_members(stamps(spark, folder), "ts", ["event_type"], "event_id")


@query(
    "gap_chronological_breaks",
    """WITH l AS (SELECT o_orderkey, o_orderdate, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS previous FROM orders)
SELECT o_orderkey, o_orderdate, previous FROM l WHERE o_orderdate < previous""",
)
def breaks(spark, folder):
    return gaps.chronological_breaks(
        table(spark, folder, "orders"), "o_orderdate", order="o_orderkey", width=512
    )


@query(
    "gap_chronological_breaks_per_series",
    """WITH l AS (SELECT o_orderpriority, o_orderkey, o_orderdate,
  lag(o_orderdate) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS previous FROM orders)
SELECT * FROM l WHERE o_orderdate < previous""",
)
def breaks_per_series(spark, folder):
    return gaps.chronological_breaks(
        table(spark, folder, "orders"), "o_orderdate", ["o_orderpriority"], "o_orderkey", width=512
    )


@query("gap_invalid_timestamps", "SELECT event_id FROM events WHERE event_id % 17 = 0")
def invalid(spark, folder):
    df = table(spark, folder, "events").withColumn(
        "ts", F.when(F.col("event_id") % 17 != 0, F.col("ts"))
    )
    return gaps.invalid_timestamps(df, "ts", "event_id")


@query(
    "gap_off_grid_rows",
    f"""WITH {YEARS_SQL}
SELECT ts, CAST(reading AS DOUBLE) AS reading FROM years
WHERE (epoch(ts) - (SELECT epoch(min(ts)) FROM years)) % 14400 <> 0""",
)
def off_grid(spark, folder):
    return gaps.off_grid_rows(years(spark, folder), FOUR, "reading")


def station(spark, folder):
    """Hourly series with metadata columns to fill."""
    return hourly(spark, folder).select(
        "event_type", "ts", "reading",
        F.concat(F.lit("site "), F.col("event_type")).alias("station"),
        F.lit("ugm3").alias("unit"), F.col("ts").cast("date").alias("date"),
        F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofmonth("ts").alias("day"),
        (F.weekday("ts") + 1).alias("weekday"), F.col("ts").alias("copy"),
        (F.col("ts") + F.expr("interval 30 minutes")).alias("mid"),
        (F.col("ts") + F.expr("interval 1 hour")).alias("until"),
        F.lit(None).cast("string").alias("note"),
        F.lit(None).cast("bigint").alias("Index"), F.lit(None).cast("boolean").alias("Generated"),
        F.date_from_unix_date(
            F.floor((F.unix_micros("ts") + 19_800_000_000) / 86_400_000_000).cast("int")
        ).alias("local_date"),
    )


D = Derivation
DERIVED = {
    "date": D.DATE, "year": D.YEAR, "month": D.MONTH, "day": D.DAY, "weekday": D.ISO_WEEKDAY,
    "copy": D.COPY, "mid": D.INTERVAL_MIDPOINT, "until": D.INTERVAL_END,
}
FILL = GapConfig(
    "ts", timedelta(hours=1), ("reading",),
    (
        GapField("station", GapBehavior.CARRY_STABLE),
        GapField("unit", GapBehavior.FIXED_VALUE, fixed_value="filled"),
        GapField("note"),
        GapField("local_date", GapBehavior.DERIVED_FROM_TIMESTAMP, derivation=D.DATE, zone="Asia/Colombo"),
        *[GapField(n, GapBehavior.DERIVED_FROM_TIMESTAMP, derivation=d) for n, d in DERIVED.items()],
    ),
    keys=("event_type",), index_column="Index", index_start=1, flag_column="Generated",
)


@query(
    "gap_rows_generated",
    f"""WITH {GRID_SQL}
SELECT g.event_type, g.ts, CAST(h.reading AS DOUBLE) AS reading, 'site ' || g.event_type AS station,
       CASE WHEN h.ts IS NULL THEN 'filled' ELSE 'ugm3' END AS unit, CAST(g.ts AS DATE) AS "date",
       CAST(year(g.ts) AS INTEGER) AS "year", CAST(month(g.ts) AS INTEGER) AS "month",
       CAST(day(g.ts) AS INTEGER) AS "day", CAST(isodow(g.ts) AS INTEGER) AS weekday, g.ts AS copy,
       g.ts + INTERVAL 30 MINUTE AS mid, g.ts + INTERVAL 1 HOUR AS until, CAST(NULL AS VARCHAR) AS note,
       row_number() OVER (PARTITION BY g.event_type ORDER BY g.ts) AS "Index", h.ts IS NULL AS "Generated",
       CAST(g.ts + INTERVAL 330 MINUTE AS DATE) AS local_date
FROM grid g LEFT JOIN hourly h ON g.event_type = h.event_type AND g.ts = h.ts""",
)
def generated(spark, folder):
    return gaps.generate_gap_rows(station(spark, folder), FILL)


@query(
    "gap_report",
    f"""WITH {GRID_SQL},
g AS (SELECT event_type, count(*) AS n FROM grid GROUP BY 1),
h AS (SELECT event_type, count(*) AS n FROM hourly GROUP BY 1)
SELECT event_type, h.n AS original_rows, g.n - h.n AS generated_rows FROM g JOIN h USING (event_type)""",
)
def report(spark, folder):
    return gaps.gap_report(hourly(spark, folder), HOURS)


@query(
    "gap_violations",
    f"""WITH {SECONDS_SQL}, {YEARS_SQL}
SELECT 'duplicate' AS kind, CAST(sum(n - 1) AS BIGINT) AS n FROM
  (SELECT count(*) AS n FROM s GROUP BY event_type, ts)
UNION ALL
SELECT 'off_grid', count(*) FROM years
WHERE (epoch(ts) - (SELECT epoch(min(ts)) FROM years)) % 14400 <> 0""",
)
def violations(spark, folder):
    per_type = GapConfig("ts", timedelta(hours=1), keys=("event_type",))
    first = gaps.gap_violations(stamps(spark, folder), per_type, "event_id")
    return first.unionByName(gaps.gap_violations(years(spark, folder), FOUR))


@query(
    "gap_stable_values",
    "SELECT DISTINCT event_type, 'site ' || event_type AS station, 'ugm3' AS unit FROM events",
)
def stable(spark, folder):
    return gaps.stable_values(station(spark, folder), ["station", "unit"], ["event_type"])


@query(
    "gap_stable_suggestion",
    "SELECT 'unit' AS \"column\", 'ugm3' AS value FROM events UNION SELECT 'year', '2024' FROM events"
    " UNION SELECT 'month', '1' FROM events",
)
def stable_suggestion(spark, folder):
    return gaps.suggest_stable(station(spark, folder), excluded=["ts"])
