"""Queries over date/time text, intervals and time zones."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from gridwright.catalog.base import query, register, table
from gridwright.config import EndMode, InvalidPolicy
from gridwright.functions import temporal, zones
from gridwright.operators import moments
from gridwright.operators.splitjoin import parse_instants
from gridwright.config import SourceSpec

# Minute-resolution wall clocks over several years, from every order.
WALLS_SQL = """walls AS (
  SELECT o_orderkey AS id, o_orderdate + to_minutes(o_orderkey * 7 % 1440)
         + to_seconds(o_orderkey % 60) AS w FROM orders)"""


def walls(spark, folder):
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (
        (k * 7 % 1440) * F.lit(60_000_000) + (k % 60) * F.lit(1_000_000)
    )
    return o.select(k.alias("id"), F.timestamp_micros(at).cast("timestamp_ntz").alias("w"))


MINUTE = "date_trunc('minute', w)"
DAY = "CAST(w AS DATE)"
# Per profile: SQL that writes the text, SQL of the value read back, result kind.
TEXTS = {
    "iso_t_second": ("strftime(w, '%Y-%m-%dT%H:%M:%S')", "w"),
    "iso_t_minute": ("strftime(w, '%Y-%m-%dT%H:%M')", MINUTE),
    "iso_utc": ("strftime(w, '%Y-%m-%dT%H:%M:%SZ')", "w"),
    "iso_date": ("strftime(w, '%Y-%m-%d')", DAY),
    "iso_minute": ("strftime(w, '%Y-%m-%d %H:%M')", MINUTE),
    "iso_second": ("strftime(w, '%Y-%m-%d %H:%M:%S')", "w"),
    "iso_millisecond": ("strftime(w, '%Y-%m-%d %H:%M:%S.%g')", "w"),
    "iso_offset": (
        "strftime(w + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S') || '+05:30'", "w",
    ),
    "time_minute": ("strftime(w, '%H:%M')", "(hour(w) * 60 + minute(w)) * 60000000"),
    "time_second": (
        "strftime(w, '%H:%M:%S')", "((hour(w) * 60 + minute(w)) * 60 + second(w)) * 1000000",
    ),
    "dmy_slash_date": ("strftime(w, '%d/%m/%Y')", DAY),
    "mdy_slash_date": ("strftime(w, '%m/%d/%Y')", DAY),
    "mdy_slash_minute": ("strftime(w, '%m/%d/%Y %H:%M')", MINUTE),
    "dmy_slash_minute": ("strftime(w, '%d/%m/%Y %H:%M')", MINUTE),
    "iso_basic_utc": ("strftime(w, '%Y%m%dT%H%M%SZ')", "w"),
    "iso_basic_offset": (
        "strftime(w + INTERVAL 330 MINUTE, '%Y%m%dT%H%M%S') || '+0530'", "w",
    ),
    "iso_basic_minute": ("strftime(w, '%Y%m%dT%H%M')", MINUTE),
    "iso_basic_second": ("strftime(w, '%Y%m%dT%H%M%S')", "w"),
}


def formatted(spark, folder, profile):
    """Walls written as text by a profile (instants shown at +05:30)."""
    df = walls(spark, folder)
    p = temporal.profile(profile)
    if p.aware:
        df = df.select("id", F.col("w").cast("timestamp").alias("w"))
    if p.kind == "time":
        df = moments.split_datetime(df, "w").select("id", F.col("Time").alias("w"))
    return moments.format_datetime(
        df, "w", profile, output="text", zone="UTC" if p.utc else "+05:30"
    )


for profile, (write, read) in TEXTS.items():
    kind = "BIGINT" if profile.startswith("time") else None
    back = f"CAST({read} AS BIGINT)" if kind else read

    def parse(spark, folder, profile=profile):
        df = formatted(spark, folder, profile).select("id", "text")
        # Every 40th text is spoilt: parsing must give null there.
        spoilt = F.when(F.col("id") % 40 == 0, F.concat(F.lit("x"), F.col("text"))).otherwise(
            F.col("text")
        )
        df = df.select("id", spoilt.alias("text"))
        return moments.parse_datetime(
            df, "text", profile, output="value", policy=InvalidPolicy.NULL
        )

    register(
        f"datetime_{profile}",
        parse,
        f"""WITH {WALLS_SQL} SELECT id, CASE WHEN id % 40 = 0 THEN 'x' ELSE '' END || {write} AS text,
 CASE WHEN id % 40 <> 0 THEN {back} END AS value FROM walls""",
    )


@query(
    "datetime_one_digit_fields",
    f"""WITH {WALLS_SQL}
SELECT id, {MINUTE} AS loose, CASE WHEN month(w) > 9 AND day(w) > 9 AND hour(w) > 9 THEN {MINUTE} END AS exact
FROM walls""",
)
def loose(spark, folder):
    text = F.date_format(F.col("w").cast("timestamp"), "yyyy-M-d'T'H:mm")
    df = walls(spark, folder).select("id", text.alias("text"))
    return df.select(
        "id", temporal.parse_text(F.col("text"), "iso_minute").alias("loose"),
        temporal.parse_text(F.col("text"), "iso_t_minute").alias("exact"),
    )


@query(
    "datetime_custom_masks",
    f"""WITH {WALLS_SQL}
SELECT id, strftime(w, '%d %B %Y at %I:%M %p') AS long_text, {MINUTE} AS long_value,
       strftime(w, '%d.%m.%y') AS short_text, CAST(w AS DATE) AS short_value FROM walls""",
)
def masks(spark, folder):
    long = temporal.mask_profile("datetime", "dd MMMM yyyy 'at' hh:mm AM/PM")
    short = temporal.mask_profile("date", "dd.MM.yy")
    df = walls(spark, folder)
    df = moments.format_datetime(df, "w", long, output="long_text")
    df = moments.format_datetime(df, "w", short, output="short_text")
    df = moments.parse_datetime(df, "long_text", long, output="long_value")
    return moments.parse_datetime(df, "short_text", short, output="short_value").drop("w")


@query(
    "datetime_interpretations",
    f"""WITH {WALLS_SQL}, d AS (SELECT id, strftime(w, '%d/%m/%Y') AS text, w FROM walls)
SELECT id, text, 'dmy_slash_date' AS profile, 'date' AS kind, strftime(w, '%Y-%m-%d') AS value FROM d
UNION ALL
SELECT id, text, 'mdy_slash_date', 'date', strftime(make_date(year(w), day(w), month(w)), '%Y-%m-%d')
FROM d WHERE day(w) <= 12 AND day(w) <> month(w)""",
)
def interpretations(spark, folder):
    df = formatted(spark, folder, "dmy_slash_date").select("id", "text")
    return moments.interpretations(df, "text", "id").drop("display")


@query(
    "datetime_unambiguous",
    f"""WITH {WALLS_SQL}
SELECT id, CASE WHEN id % 40 = 0 THEN 'no_match' WHEN day(w) <= 12 AND day(w) <> month(w)
                THEN 'ambiguous' ELSE 'ok' END AS reading_status,
       CASE WHEN id % 40 <> 0 AND NOT (day(w) <= 12 AND day(w) <> month(w))
            THEN strftime(w, '%Y-%m-%d') END AS reading FROM walls""",
)
def unambiguous(spark, folder):
    df = formatted(spark, folder, "dmy_slash_date")
    text = F.when(F.col("id") % 40 == 0, F.lit("?")).otherwise(F.col("text"))
    return moments.parse_unambiguous(df.select("id", text.alias("text")), "text").drop("text")


@query(
    "text_and_boolean_masks",
    """SELECT event_id, 'pre-' || event_type || '-post' AS shown, CASE WHEN event_id % 9 <> 0 THEN event_type END AS read,
 CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS flag,
 CASE WHEN event_id % 3 = 0 THEN 'Oui' WHEN event_id % 3 = 1 THEN 'Non' END AS label FROM events""",
)
def text_masks(spark, folder):
    mask, flag = temporal.TextMask("pre-{value}-post"), temporal.BooleanMask("Oui|Non")
    i = F.col("event_id")
    words = F.when(i % 3 == 0, F.when(i % 2 == 0, "OUI").otherwise("true")).when(
        i % 3 == 1, F.when(i % 2 == 0, "non").otherwise("0")
    ).otherwise("maybe")
    df = table(spark, folder, "events").select(
        "event_id", mask.display(F.col("event_type")).alias("shown"), words.alias("words")
    )
    cut = F.when(i % 9 == 0, F.substring("shown", 2, 100)).otherwise(F.col("shown"))
    return df.select(
        "event_id", "shown", mask.parse(cut).alias("read"), flag.parse(F.col("words")).alias("flag"),
        flag.display(F.col("words")).alias("label"),
    )


@query(
    "datetime_combine",
    f"""WITH {WALLS_SQL} SELECT id, CASE WHEN id % 11 <> 0 THEN w END AS "DateTime" FROM walls""",
)
def combine(spark, folder):
    df = moments.split_datetime(walls(spark, folder), "w").drop("w")
    df = df.withColumn("Time", F.when(F.col("id") % 11 != 0, F.col("Time")))
    return moments.combine_date_time(df, "Date", "Time").select("id", "DateTime")


@query(
    "datetime_split",
    f"""WITH {WALLS_SQL} SELECT id, CAST(w AS DATE) AS "Date",
 CAST(epoch_us(w) % 86400000000 AS BIGINT) AS "Time" FROM walls""",
)
def split(spark, folder):
    return moments.split_datetime(walls(spark, folder), "w").drop("w")


for role, back in (("start", 0), ("midpoint", 30), ("end", 60)):
    register(
        f"interval_fields_from_{role}",
        lambda spark, folder, role=role: moments.derive_intervals(
            walls(spark, folder), "w", role, timedelta(hours=1)
        ),
        f"""WITH {WALLS_SQL} SELECT id, w, w - to_minutes({back}) AS "Start",
 w - to_minutes({back - 30}) AS "Mid", w - to_minutes({back - 60}) AS "End" FROM walls""",
    )

ENDS_SQL = f"""{WALLS_SQL}, ends AS (
  SELECT id, CASE WHEN id % 13 <> 0 THEN w END AS s,
         CASE id % 4 WHEN 0 THEN w + INTERVAL 60 MINUTE WHEN 1 THEN w + INTERVAL 3599 SECOND
                     WHEN 2 THEN w + INTERVAL 55 MINUTE END AS e FROM walls)"""


def ends(spark, folder):
    i, w = F.col("id"), F.col("w")
    end = (
        F.when(i % 4 == 0, w + F.expr("interval 60 minutes"))
        .when(i % 4 == 1, w + F.expr("interval 3599 seconds"))
        .when(i % 4 == 2, w + F.expr("interval 55 minutes"))
    )
    return walls(spark, folder).select("id", F.when(i % 13 != 0, w).alias("s"), end.alias("e"))


for mode, expr in (
    (EndMode.SEMANTIC, "CASE WHEN s IS NOT NULL AND (e IS NULL OR id % 4 = 1) THEN s + INTERVAL 1 HOUR ELSE e END"),
    (EndMode.CALCULATE, "CASE WHEN s IS NOT NULL THEN s + INTERVAL 1 HOUR ELSE e END"),
    (EndMode.RETAIN, "e"),
):
    register(
        f"interval_end_{mode.value}",
        lambda spark, folder, mode=mode: moments.normalize_interval_end(
            ends(spark, folder), "s", "e", timedelta(hours=1), mode=mode
        ),
        f"WITH {ENDS_SQL} SELECT id, s, {expr} AS e FROM ends",
    )


@query(
    "time_shift",
    f"""WITH {WALLS_SQL} SELECT id, w - INTERVAL 90 MINUTE AS w, CAST(w AS DATE) + 3 AS "Date",
 CAST((epoch_us(w) + 79200000000) % 86400000000 AS BIGINT) AS "Time" FROM walls""",
)
def shift(spark, folder):
    df = moments.split_datetime(walls(spark, folder), "w")
    df = moments.time_shift(df, "w", timedelta(minutes=-90))
    df = moments.time_shift(df, "Date", timedelta(days=3))
    return moments.time_shift(df, "Time", timedelta(hours=-2))


# Zones. New York had two offsets in these years, so both readings can be listed in SQL.
NY = "America/New_York"
READINGS_SQL = f"""{WALLS_SQL},
c AS (SELECT id, w, w + INTERVAL 4 HOUR AS summer, w + INTERVAL 5 HOUR AS winter FROM walls),
v AS (SELECT id, w,
      CASE WHEN summer AT TIME ZONE 'UTC' AT TIME ZONE '{NY}' = w THEN summer END AS s,
      CASE WHEN winter AT TIME ZONE 'UTC' AT TIME ZONE '{NY}' = w THEN winter END AS t FROM c)"""

for choice, expr in (
    ("raise", "CASE WHEN s IS NULL OR t IS NULL THEN coalesce(s, t) END"),
    ("first", "coalesce(s, t)"),
    ("second", "coalesce(t, s)"),
):

    @query(
        f"zone_localize_{choice}",
        f"WITH {READINGS_SQL} SELECT id, w, {expr} AS instant FROM v",
    )
    def localize(spark, folder, choice=choice):
        return zones.localize(
            walls(spark, folder), F.col("w"), "instant", NY, ambiguous=choice, invalid="null"
        )


@query(
    "zone_localize_lenient",
    f"""WITH {READINGS_SQL}
SELECT id, coalesce(s, t, w + INTERVAL 5 HOUR) AS instant FROM v""",
)
def lenient(spark, folder):
    return walls(spark, folder).select(
        "id", zones.localize_lenient(F.col("w"), NY).alias("instant")
    )


@query(
    "zone_convert_embedded",
    f"""WITH {WALLS_SQL} SELECT id, w, w AT TIME ZONE 'UTC' AT TIME ZONE '{NY}' AS local FROM walls""",
)
def embedded(spark, folder):
    df = walls(spark, folder).select("id", F.col("w").cast("timestamp").alias("w"))
    return moments.convert_timezone(
        df, "w", NY, source_kind="embedded", wall_output="local"
    )


@query(
    "zone_convert_fixed",
    f"""WITH {WALLS_SQL} SELECT id, w, w - INTERVAL 330 MINUTE AS instant,
 (w - INTERVAL 330 MINUTE) AT TIME ZONE 'UTC' AT TIME ZONE '{NY}' AS local FROM walls""",
)
def fixed(spark, folder):
    return moments.convert_timezone(
        walls(spark, folder), "w", NY, source_kind="fixed_iana", zone="Asia/Kolkata",
        output="instant", wall_output="local",
    )


@query(
    "zone_convert_offset",
    f"WITH {WALLS_SQL} SELECT id, w, w + INTERVAL 4 HOUR AS instant FROM walls",
)
def offset(spark, folder):
    return moments.convert_timezone(
        walls(spark, folder), "w", "UTC", source_kind="manual_offset", offset_minutes=-240,
        output="instant",
    )


@query(
    "zone_convert_by_column",
    f"""WITH {WALLS_SQL} SELECT id, CASE id % 3 WHEN 0 THEN w - INTERVAL 330 MINUTE
 WHEN 1 THEN w - INTERVAL 9 HOUR ELSE w END AS instant FROM walls""",
)
def by_column(spark, folder):
    zone = (
        F.when(F.col("id") % 3 == 0, "UTC+5.5").when(F.col("id") % 3 == 1, " Asia/Tokyo ")
        .otherwise("UTC")
    )
    df = walls(spark, folder).withColumn("zone", zone)
    return moments.convert_timezone(
        df, "w", "UTC", source_kind="iana_column", zone_column="zone", output="instant"
    ).select("id", "instant")


@query(
    "zone_offset_text",
    f"""WITH {WALLS_SQL}, l AS (SELECT id, w, w AT TIME ZONE 'UTC' AT TIME ZONE '{NY}' AS x FROM walls)
SELECT id, strftime(x, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch(w) - epoch(x) = 14400 THEN '-04:00' ELSE '-05:00' END
 AS text FROM l""",
)
def offset_text(spark, folder):
    df = walls(spark, folder).select("id", F.col("w").cast("timestamp").alias("w"))
    return moments.format_datetime(df, "w", "iso_offset", output="text", zone=NY).select(
        "id", "text"
    )


@query(
    "instant_parse_iso",
    f"""WITH {WALLS_SQL}
SELECT id, CASE id % 4 WHEN 0 THEN w WHEN 1 THEN w - INTERVAL 9 HOUR
 WHEN 2 THEN w - INTERVAL 330 MINUTE ELSE date_trunc('day', w) - INTERVAL 330 MINUTE END AS _ts FROM walls""",
)
def instants(spark, folder):
    i, w = F.col("id"), F.col("w").cast("timestamp")
    stamp = F.date_format(w, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(i % 4 == 0, F.concat(stamp, F.lit("Z")))
        .when(i % 4 == 1, F.concat(stamp, F.lit("+09:00")))
        .when(i % 4 == 2, F.date_format(w, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(w, "yyyy-MM-dd"))
    )
    df = walls(spark, folder).select("id", text.alias("text"))
    return parse_instants(df, SourceSpec("orders", "text", "Asia/Kolkata")).select("id", "_ts")
