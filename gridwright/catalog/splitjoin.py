"""Split and join queries."""

from __future__ import annotations

from datetime import time

from pyspark.sql import functions as F

from gridwright.catalog.base import HOURLY_SQL, hourly, query, register, table
from gridwright.config import (
    DayPeriod, MonthPeriod, QuarterPeriod, SeasonPeriod, WeekPeriod, YearPeriod,
    Action,
    DuplicatePolicy,
    FieldGroup,
    MatchPolicy,
    Season,
    SourceSpec,
    SplitJoinSpec,
)
from gridwright.functions import zones
from gridwright.operators import splitjoin

PAIR_SQL = f"""{HOURLY_SQL},
sides AS (SELECT event_type, ts, CAST(sum(reading) OVER (PARTITION BY event_type = 'click', ts) AS DOUBLE) AS both_r,
 CAST(sum(reading) OVER (PARTITION BY event_type IN ('click', 'purchase'), event_type = 'click', ts) AS DOUBLE) AS reading,
 max(peak) OVER (PARTITION BY event_type = 'click', ts) AS both_p,
 max(peak) OVER (PARTITION BY event_type IN ('click', 'purchase'), event_type = 'click', ts) AS peak FROM hourly),
c AS (SELECT DISTINCT ts, reading, peak FROM sides WHERE event_type = 'click'),
p AS (SELECT DISTINCT ts, both_r AS reading, both_p AS peak FROM sides WHERE event_type <> 'click'),
q AS (SELECT DISTINCT ts, reading, peak FROM sides WHERE event_type = 'purchase'),
v AS (SELECT DISTINCT ts, reading, peak FROM sides WHERE event_type NOT IN ('click', 'purchase'))"""


def prepared(spark, folder, *kinds):
    """One prepared source per named event type and one of all others, so that together they
    hold the whole table: hourly totals with the hour as row order."""
    df = hourly(spark, folder)
    rest = ~F.col("event_type").isin(*kinds)
    out = []
    for number, (name, own) in enumerate(
        [*((k, F.col("event_type") == k) for k in kinds), ("others", rest)]
    ):
        part = df.where(own).groupBy("ts").agg(
            F.sum("reading").cast("double").alias("reading"), F.max("peak").alias("peak")
        ).withColumn("_ord", F.unix_micros("ts"))
        out.append(splitjoin.prepare_source(part, SourceSpec(name, "ts"), number))
    return out


MATCH_SQL = {
    MatchPolicy.OUTER: "c FULL JOIN p USING (ts)",
    MatchPolicy.INNER: "c JOIN p USING (ts)",
    MatchPolicy.LEFT: "c LEFT JOIN p USING (ts)",
}

for match, source in MATCH_SQL.items():

    @query(
        f"join_fields_{match.value}",
        f"""WITH {PAIR_SQL} SELECT ts AS "Timestamp", c.reading AS "S1_reading", c.peak AS "S1_peak",
 p.reading AS "S2_reading", p.peak AS "S2_peak" FROM {source}""",
    )
    def fields(spark, folder, match=match):
        return splitjoin.join_fields(prepared(spark, folder, "click"), match)


@query(
    "join_fields_three_sources",
    f"""WITH {PAIR_SQL} SELECT ts AS "Timestamp", c.reading AS "S1_reading", c.peak AS "S1_peak",
 q.reading AS "S2_reading", q.peak AS "S2_peak", v.reading AS "S3_reading", v.peak AS "S3_peak"
FROM c FULL JOIN q USING (ts) FULL JOIN v USING (ts)""",
)
def three(spark, folder):
    return splitjoin.join_fields(prepared(spark, folder, "click", "purchase"))


@query(
    "join_fields_keyed",
    """WITH o AS (SELECT o_orderpriority AS k, o_orderdate AS ts, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
s AS (SELECT o_orderpriority AS k, o_orderdate AS ts, min(o_totalprice) AS w FROM orders
      WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT k, ts AS "Timestamp", v AS "S1_v", w AS "S2_w" FROM o LEFT JOIN s USING (k, ts)""",
)
def keyed(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts"), "o_totalprice",
        "o_orderstatus",
    )
    all_rows = o.groupBy("k", "ts").agg(F.max("o_totalprice").alias("v"), F.lit(0).alias("_ord"))
    final = o.where("o_orderstatus = 'F'").groupBy("k", "ts").agg(
        F.min("o_totalprice").alias("w"), F.lit(0).alias("_ord")
    )
    sources = [
        splitjoin.prepare_source(d, SourceSpec(n, "ts"), i, keys=["k"])
        for i, (n, d) in enumerate((("all", all_rows), ("final", final)))
    ]
    return splitjoin.join_fields(sources, MatchPolicy.LEFT, keys=["k"])


# Order dates repeat heavily; open and other orders are the two sources.
ORDERS_SQL = """lines AS (
  SELECT CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS src, o_orderdate AS ts,
         o_orderkey AS ord, o_totalprice AS price FROM orders)"""


def order_sources(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("_ord"), "o_orderstatus",
    )
    halves = (o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"))
    return [
        splitjoin.prepare_source(h.drop("o_orderstatus"), SourceSpec(f"s{i}", "ts"), i)
        for i, h in enumerate(halves)
    ]


for policy, pick in (
    (DuplicatePolicy.FIRST, "ORDER BY src, ord"),
    (DuplicatePolicy.LAST, "ORDER BY src DESC, ord DESC"),
):
    # 'QUALIFY' keeps one row per instant over both sources.
    register(
        f"join_time_{policy.value}",
        lambda spark, folder, policy=policy: splitjoin.join_time(
            order_sources(spark, folder), policy
        ),
        f"""WITH {ORDERS_SQL} SELECT ts AS _ts, src AS _src, ord AS _ord, price FROM lines
QUALIFY row_number() OVER (PARTITION BY ts {pick}) = 1""",
    )
    register(
        f"join_fields_duplicates_{policy.value}",
        lambda spark, folder, policy=policy: splitjoin.join_fields(
            order_sources(spark, folder), MatchPolicy.OUTER, policy
        ),
        f"""WITH {ORDERS_SQL}, k AS (SELECT * FROM lines
  QUALIFY row_number() OVER (PARTITION BY src, ts {pick}) = 1),
a AS (SELECT * FROM k WHERE src = 0), b AS (SELECT * FROM k WHERE src = 1)
SELECT ts AS "Timestamp", a.price AS "S1_price", b.price AS "S2_price" FROM a FULL JOIN b USING (ts)""",
    )

register(
    "join_time_keep",
    lambda spark, folder: splitjoin.join_time(order_sources(spark, folder), DuplicatePolicy.KEEP),
    f"WITH {ORDERS_SQL} SELECT ts AS _ts, src AS _src, ord AS _ord, price FROM lines",
)
register(
    "join_time_refusing_repeats",
    lambda spark, folder: splitjoin.join_time(
        [
            s.withColumn("_ts", F.timestamp_micros(F.unix_micros("_ts") + F.col("_ord")))
            for s in order_sources(spark, folder)
        ]
    ),
    f"""WITH {ORDERS_SQL} SELECT make_timestamp(epoch_us(ts) + ord) AS _ts, src AS _src, ord AS _ord, price
 FROM lines""",
)


# Splits: every order labelled with its period.
WEEK_WED = "date_trunc('week', {w} - INTERVAL 2 DAY) + INTERVAL 2 DAY"
SPLITS = {
    "day_from_six": (
        DayPeriod(day_start=time(6, 30)), 1,
        "date_trunc('day', {w} - INTERVAL 390 MINUTE) + INTERVAL 390 MINUTE", "INTERVAL 1 DAY",
        "strftime({w} - INTERVAL 390 MINUTE, '%Y-%m-%d')",
    ),
    "week": (
        WeekPeriod(first_weekday=2), 1, WEEK_WED, "INTERVAL 7 DAY",
        "'Week ' || strftime(" + WEEK_WED + ", '%Y-%m-%d')",
    ),
    "month_from_15": (
        MonthPeriod(), 15,
        "date_trunc('month', {w} - INTERVAL 14 DAY) + INTERVAL 14 DAY", "INTERVAL 1 MONTH",
        "strftime({w} - INTERVAL 14 DAY, '%Y-%m')",
    ),
    "quarter": (
        QuarterPeriod(), 1, "date_trunc('quarter', {w})", "INTERVAL 3 MONTH",
        "'Q' || quarter({w}) || ' ' || year({w})",
    ),
    "year_from_july": (
        YearPeriod(first_month=7), 1,
        "date_trunc('year', {w} - INTERVAL 6 MONTH) + INTERVAL 6 MONTH", "INTERVAL 1 YEAR",
        "'Year ' || year({w} - INTERVAL 6 MONTH) || '-07-01'",
    ),
}


def stamped(spark, folder):
    """Orders as one prepared source, spread over the hours of their day."""
    o = table(spark, folder, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (
        F.col("o_orderkey") % 24
    ) * F.lit(3_600_000_000)
    df = o.select(
        F.timestamp_micros(at).alias("ts"), F.col("o_orderkey").alias("_ord"), "o_totalprice"
    )
    return splitjoin.prepare_source(df, SourceSpec("orders", "ts"), 0)


for name, (period, start_day, start, step, label) in SPLITS.items():
    for zone in ("UTC", "Asia/Kolkata"):
        shift = "INTERVAL 330 MINUTE" if zone != "UTC" else "INTERVAL 0 MINUTE"
        w = f"(o_orderdate + to_hours(o_orderkey % 24) + {shift})"
        suffix = "" if zone == "UTC" else "_local"
        spec = SplitJoinSpec(period=period, month_start_day=start_day, zone=zone)
        register(
            f"split_time_{name}{suffix}",
            lambda spark, folder, spec=spec: splitjoin.split_labels(
                stamped(spark, folder), spec
            ).drop("_src"),
            f"""SELECT o_orderdate + to_hours(o_orderkey % 24) AS _ts, o_orderkey AS _ord, o_totalprice,
 {start.format(w=w)} - {shift} AS period_start, {start.format(w=w)} + {step} - {shift} AS period_end,
 {label.format(w=w)} AS period_label FROM orders""",
        )

SEASONS = SeasonPeriod(seasons=(Season("Wet", 5, 15), Season("Dry", 12)))


@query(
    "split_time_season_manifest",
    """WITH s AS (SELECT o_orderdate + to_hours(o_orderkey % 24) AS ts FROM orders),
l AS (SELECT ts, CASE WHEN strftime(ts, '%m-%d') >= '12-01' THEN 'Dry ' || year(ts)
                      WHEN strftime(ts, '%m-%d') >= '05-15' THEN 'Wet ' || year(ts)
                      ELSE 'Dry ' || (year(ts) - 1) END AS period_label FROM s)
SELECT period_label, count(*) AS "rows", min(ts) AS first_timestamp, max(ts) AS last_timestamp
FROM l GROUP BY 1""",
)
def season_manifest(spark, folder):
    labelled = splitjoin.split_labels(stamped(spark, folder), SplitJoinSpec(period=SEASONS))
    return splitjoin.manifest(labelled, ["period_label"])


@query(
    "split_time_output_manifest",
    """WITH s AS (SELECT o_orderdate + to_hours(o_orderkey % 24) AS ts FROM orders)
SELECT strftime(ts, '%Y-%m') AS period_label, date_trunc('month', ts) AS period_start,
 date_trunc('month', ts) + INTERVAL 1 MONTH AS period_end, count(*) AS "rows",
 min(ts) AS first_timestamp, max(ts) AS last_timestamp FROM s GROUP BY 1, 2, 3""",
)
def month_manifest(spark, folder):
    spec = SplitJoinSpec(period=MonthPeriod())
    labelled = splitjoin.split_labels(stamped(spark, folder), spec)
    return splitjoin.manifest(labelled, ["period_label", "period_start", "period_end"])


@query(
    "split_fields_long",
    """WITH l AS (SELECT o_orderdate AS _ts, o_orderkey AS _ord, o_orderpriority AS site,
  o_totalprice AS price, o_custkey AS customer FROM orders)
SELECT 'Money' AS "group", _ts, 0 AS _src, _ord, site, price, NULL::BIGINT AS customer FROM l
UNION ALL SELECT 'People', _ts, 0, _ord, site, NULL, customer FROM l""",
)
def fields_long(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("_ord"),
        F.col("o_orderpriority").alias("site"), F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("customer"),
    )
    source = splitjoin.prepare_source(o, SourceSpec("orders", "ts"), 0)
    groups = [FieldGroup("Money", ("price",)), FieldGroup("People", ("customer",))]
    return splitjoin.split_fields_long(source, groups, ["site"])


@query(
    "split_fields_one_group",
    "SELECT o_orderdate AS _ts, 0 AS _src, o_orderkey AS _ord, o_orderpriority AS site, o_totalprice AS price"
    " FROM orders",
)
def fields_one(spark, folder):
    o = table(spark, folder, "orders").select(
        F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("_ord"),
        F.col("o_orderpriority").alias("site"), F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("customer"),
    )
    source = splitjoin.prepare_source(o, SourceSpec("orders", "ts"), 0)
    return splitjoin.split_fields(source, shared=["site"])["price"]


@query(
    "join_then_split",
    f"""WITH {PAIR_SQL}, j AS (SELECT ts, c.reading AS a, p.reading AS b FROM c FULL JOIN p USING (ts))
SELECT ts AS _ts, a AS "S1_reading", b AS "S2_reading", date_trunc('week', ts) AS period_start,
 date_trunc('week', ts) + INTERVAL 7 DAY AS period_end,
 'Week ' || strftime(date_trunc('week', ts), '%Y-%m-%d') AS period_label FROM j""",
)
def regroup(spark, folder):
    spec = SplitJoinSpec(Action.JOIN_FIELDS, period=WeekPeriod(), regroup=True)
    joined = splitjoin.split_join(prepared(spark, folder, "click"), spec)
    return joined.drop("S1_peak", "S2_peak")


@query(
    "split_iso_timestamps",
    """SELECT o_orderkey AS _ord, strftime(o_orderdate + to_hours(o_orderkey % 24) + INTERVAL 330 MINUTE,
 '%Y-%m-%dT%H:%M:%S') || '+05:30' AS text FROM orders""",
)
def iso(spark, folder):
    return stamped(spark, folder).select(
        "_ord", zones.iso_text(F.col("_ts"), "Asia/Kolkata").alias("text")
    )
