from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridwright.config import EndMode, InvalidPolicy
from gridwright.functions import temporal
from gridwright.operators import moments
from gridwright.operators.diagnostics import Diagnostics
from tests.conftest import rows


def texts(spark, *values, name="When"):
    return spark.createDataFrame(list(enumerate(values, 1)), f"_ord bigint, `{name}` string")


def walls(spark, *values, name="t"):
    return spark.createDataFrame([(v,) for v in values], f"{name} timestamp_ntz")


def test_parse_then_format(spark):
    df = moments.parse_datetime(texts(spark, "08/20/2025 08:00"), "When", "mdy_slash_minute")
    assert df.first().When == datetime(2025, 8, 20, 8)
    assert moments.format_datetime(df, "When", "iso_minute").first().When == "2025-08-20 08:00"


def test_offsets_become_instants(spark):
    for text, profile in (("20260101T010203+0530", "iso_basic_offset"), ("2026-01-01T01:02:03+05:30", "iso_offset")):
        df = moments.parse_datetime(texts(spark, text), "When", profile)
        utc = moments.format_datetime(df, "When", "iso_utc", output="u")
        assert utc.first().u == "2025-12-31T19:32:03Z"
        again = moments.format_datetime(df, "When", profile, output="o", zone="+05:30")
        assert again.first().o == text
    zone = texts(spark, "2026-01-01T01:02:03-04:30").select(temporal.parse_offset_zone(F.col("When"), "iso_offset").alias("z"))
    assert zone.first().z == "-04:30"


@pytest.mark.parametrize("profile,text", [
    ("iso_t_second", "2025-8-20T08:00:00"), ("iso_date", "2025-02-30"), ("iso_date", "2025-08-20 00:00"),
    ("iso_utc", "2025-08-20T08:00:00"), ("time_minute", "25:00"), ("iso_minute", "2025-08-20 08:00:00"),
    ("dmy_slash_date", "13/13/2025"), ("iso_basic_minute", "20250820T8:00"), ("iso_date", "25-08-20"),
])
def test_shapes_that_do_not_match(spark, profile, text):
    df = texts(spark, text)
    notes = Diagnostics()
    out = moments.parse_datetime(df, "When", profile, policy=InvalidPolicy.NULL, notes=notes)
    assert out.first().When is None and notes.counts() == {"invalid_temporal_values": 1}
    kept = moments.parse_datetime(df, "When", profile, policy=InvalidPolicy.PRESERVE).first()
    assert kept.When is None and kept.When_source == text
    with pytest.raises(Exception, match="invalid_temporal_values"):
        moments.parse_datetime(df, "When", profile).collect()


def test_loose_spellings(spark):
    got = [
        (r.v, r.p) for r in texts(spark, "2025-8-2 7:05", " 2025-08-02T07:05 ", "2025-08-02   07:05").select(
            F.col("When").alias("v"), temporal.parse_text(F.col("When"), "iso_minute").alias("p")).collect()
    ]
    assert {p for _, p in got} == {datetime(2025, 8, 2, 7, 5)}


def test_zone_less_values_cannot_be_written_with_an_offset(spark):
    df = walls(spark, datetime(2025, 1, 1))
    for profile in ("iso_utc", "iso_offset"):
        with pytest.raises(Exception, match="invalid_temporal_values"):
            moments.format_datetime(df, "t", profile, output="x").collect()
    assert moments.format_datetime(df, "t", "iso_utc", output="x", policy=InvalidPolicy.NULL).first().x is None


def test_ambiguity(spark):
    df = texts(spark, "04/05/2026", "13/05/2026", "05/05/2026", "nothing", None)
    found = rows(moments.interpretations(df, "When").where("_ord = 1").select("value"))
    assert found == [("2026-04-05",), ("2026-05-04",)]
    got = [(r.reading, r.reading_status) for r in moments.parse_unambiguous(df, "When").orderBy("_ord").collect()]
    assert got == [(None, "ambiguous"), ("2026-05-13", "ok"), ("2026-05-05", "ok"), (None, "no_match"), (None, None)]
    with pytest.raises(Exception, match="no single reading"):
        moments.parse_unambiguous(df, "When", strict=True).collect()


@pytest.mark.parametrize("kind,mask,text,value", [
    ("datetime", "dd.MM.yyyy HH:mm", "20.08.2025 08:05", datetime(2025, 8, 20, 8, 5)),
    ("datetime", "d MMM yy h:mm AM/PM", "05 Aug 99 07:30 PM", datetime(1999, 8, 5, 19, 30)),
    ("date", "MMMM d, yyyy", "August 20, 2025", date(2025, 8, 20)),
    ("datetime", "yyyy-MM-dd 'at' HH:mm:ss", "2025-08-20 at 08:05:01", datetime(2025, 8, 20, 8, 5, 1)),
    ("time", "HH:mm", "08:05", (8 * 60 + 5) * 60_000_000),
])
def test_masks_round_trip(spark, kind, mask, text, value):
    p = temporal.mask_profile(kind, mask)
    df = moments.parse_datetime(texts(spark, text), "When", p)
    assert df.first().When == value
    assert moments.format_datetime(df, "When", p).first().When == text


def test_mask_rules():
    for kind, mask in (("datetime", "yyyyMMdd HHmmss"), ("date", "qq"), ("date", "yyyy-yyyy"), ("date", "---"), ("month", "MM"), ("date", "yyyy %d")):
        with pytest.raises(ValueError):
            temporal.mask_profile(kind, mask)
    assert temporal.mask_profile("datetime", "yyyy-MM-dd'T'HH:mm").name == "iso_t_minute"
    assert temporal.mask_profile("datetime", "dd/MM/yyyy HH:mm").patterns == ("d/M/yyyy H:m",)


def test_combine_and_split(spark):
    df = spark.createDataFrame([(date(2025, 8, 20), 8 * 3600 * 1_000_000), (None, 5)], "Date date, Time bigint")
    out = moments.combine_date_time(df, "Date", "Time")
    assert [r.DateTime for r in out.collect()] == [datetime(2025, 8, 20, 8), None]
    back = moments.split_datetime(out.select("DateTime"), "DateTime").first()
    assert (back.Date, back.Time) == (date(2025, 8, 20), 8 * 3600 * 1_000_000)
    with pytest.raises(ValueError):
        moments.combine_date_time(df.select("Time", F.lit("x").alias("d")), "d", "Time")


@pytest.mark.parametrize("role,minute", [("start", 0), ("midpoint", 30), ("end", 60)])
def test_interval_roles(spark, role, minute):
    df = walls(spark, datetime(2025, 8, 20, 8) + timedelta(minutes=minute))
    got = moments.derive_intervals(df, "t", role, timedelta(hours=1)).first()
    assert [got.Start.minute + got.Start.hour * 60, got.Mid.minute, got.End.hour] == [480, 30, 9]
    with pytest.raises(ValueError):
        moments.derive_intervals(df, "t", "instantaneous", timedelta(hours=1))


def test_interval_ends(spark):
    eight = datetime(2025, 8, 20, 8)
    data = [(eight, eight + timedelta(minutes=59)), (eight, eight + timedelta(minutes=115)), (eight, None), (None, eight)]
    df = spark.createDataFrame(data, "s timestamp_ntz, e timestamp_ntz")
    notes = Diagnostics()
    got = [r.e for r in moments.normalize_interval_end(df, "s", "e", timedelta(hours=1), notes=notes).collect()]
    nine = eight + timedelta(hours=1)
    assert got == [nine, eight + timedelta(minutes=115), nine, eight]
    assert notes.counts() == {"interval_ends_normalized": 2, "interval_ends_unresolved": 1}
    assert moments.normalize_interval_end(df, "s", "e", timedelta(hours=1), mode=EndMode.RETAIN) is df


def test_shifts(spark):
    df = spark.createDataFrame([(datetime(2025, 3, 9, 1), date(2025, 1, 31), 1_000_000)], "t timestamp_ntz, d date, m bigint")
    out = moments.time_shift(df, "t", timedelta(hours=1, seconds=1))
    out = moments.time_shift(out, "d", timedelta(days=1))
    out = moments.time_shift(out, "m", timedelta(seconds=-2))
    assert tuple(out.first()) == (datetime(2025, 3, 9, 2, 0, 1), date(2025, 2, 1), 86_399_000_000)
    with pytest.raises(ValueError):
        moments.time_shift(df, "d", timedelta(hours=1))
    # An instant shifts on its own wall clock: across the New York spring change a day is 23 h.
    ny = spark.sql("select timestamp'2025-03-08 17:00:00' as t")
    moved = moments.time_shift(ny, "t", timedelta(days=1), zone="America/New_York")
    assert moved.select(F.col("t").cast("timestamp_ntz").alias("t")).first().t == datetime(2025, 3, 9, 16)


def test_time_zone_conversion(spark):
    df = spark.createDataFrame(
        [(datetime(2025, 8, 20, 8), "UTC"), (datetime(2025, 8, 20, 8), "Asia/Colombo"), (None, None)],
        "t timestamp_ntz, z string",
    )
    by = moments.convert_timezone(df, "t", "Asia/Colombo", source_kind="iana_column", zone_column="z", output="i", wall_output="w")
    assert [r.w for r in by.collect()] == [datetime(2025, 8, 20, 13, 30), datetime(2025, 8, 20, 8), None]
    manual = moments.convert_timezone(df, "t", "UTC", source_kind="manual_offset", offset_minutes=330, wall_output="w")
    assert manual.first().w == datetime(2025, 8, 20, 2, 30)
    with pytest.raises(Exception, match="blank"):
        moments.convert_timezone(df.withColumn("z", F.lit(" ")), "t", "UTC", source_kind="iana_column", zone_column="z").collect()
    instant = df.withColumn("t", F.col("t").cast("timestamp"))
    for frame, kwargs in (
        (df, {"source_kind": "embedded"}), (instant, {"source_kind": "fixed_iana", "zone": "UTC"}),
        (df, {"source_kind": "fixed_iana"}), (df, {"source_kind": "manual_offset", "offset_minutes": 5000}),
    ):
        with pytest.raises(ValueError):
            moments.convert_timezone(frame, "t", "UTC", **kwargs)
