"""Zones and reporting periods against Python's zoneinfo."""

from datetime import UTC, datetime, time, timedelta
from zoneinfo import ZoneInfo

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from gridwright.config import (
    AnchoredDays, AnchoredYear, ClockPeriod, DayPeriod, MonthPeriod, QuarterPeriod, Season,
    SeasonPeriod, WeekPeriod, YearPeriod, clock, day,
)
from gridwright.functions import zones
from gridwright.functions.periods import slot_of, with_bounds
from gridwright.operators.averaging import with_tiling

ZONES = (
    "America/New_York", "Asia/Colombo", "Australia/Lord_Howe", "America/Sao_Paulo",
    "Pacific/Apia", "Europe/London", "Asia/Kolkata", "America/Havana",
)


def readings(wall, zone):
    """All instants whose wall clock in ``zone`` is ``wall``."""
    info = ZoneInfo(zone)
    found = set()
    for fold in (0, 1):
        instant = wall.replace(tzinfo=info, fold=fold).astimezone(UTC)
        if instant.astimezone(info).replace(tzinfo=None) == wall:
            found.add(instant)
    return sorted(found)


def edge(wall, zone):
    """Period edge: earliest reading, else next wall minute that exists."""
    while not readings(wall, zone):
        wall += timedelta(minutes=1)
    return readings(wall, zone)[0]


def walls_around_transitions(zone, years=range(2005, 2022)):
    info, out = ZoneInfo(zone), []
    at = datetime(min(years), 1, 1, tzinfo=UTC)
    while at.year <= max(years):
        nxt = at + timedelta(days=1)
        if at.astimezone(info).utcoffset() != nxt.astimezone(info).utcoffset():
            base = at.astimezone(info).replace(tzinfo=None, minute=0, second=0)
            out += [base + timedelta(minutes=30 * k) for k in range(-4, 64)]
        at = nxt
    return out


def ntz(spark, walls):
    return spark.createDataFrame([(w,) for w in walls], "w timestamp_ntz")


@pytest.mark.parametrize("zone", ZONES)
def test_candidates_and_edges_match_zoneinfo(spark, zone):
    walls = walls_around_transitions(zone) or [datetime(2020, 1, 1)]
    df = ntz(spark, walls).select("w", F.unix_micros(F.col("w").cast("timestamp")).alias("u"))
    df = zones.with_candidates(df, "u", zone, "c")
    df = zones.with_boundary(df, "u", "edge", zone, strict=False)
    df = df.withColumn("edge2", zones.edge_micros(F.col("u"), zone))
    for r in df.collect():
        want = [int(x.timestamp() * 1_000_000) for x in readings(r.w, zone)]
        got = sorted({v for v in (r.c_first, r.c_last) if v is not None})
        assert got == want, (zone, r.w)
        assert r.edge == r.edge2 == int(edge(r.w, zone).timestamp() * 1_000_000), (zone, r.w)


def test_strict_localisation_choices(spark):
    df = ntz(spark, [datetime(2025, 11, 2, 1, 30)])
    first = zones.localize(df, F.col("w"), "i", "America/New_York", ambiguous="first").first().i
    second = zones.localize(df, F.col("w"), "i", "America/New_York", ambiguous="second").first().i
    assert second - first == timedelta(hours=1)
    for wall, choice in ((datetime(2025, 11, 2, 1, 30), "raise"), (datetime(2025, 3, 9, 2, 30), "first")):
        with pytest.raises(Exception, match="ambiguous|does not exist"):
            zones.localize(
                ntz(spark, [wall]), F.col("w"), "i", "America/New_York", ambiguous=choice
            ).collect()


def test_zone_names():
    assert zones.canonical_zone("Colombo") == "Asia/Colombo"
    assert zones.canonical_zone("UTC+5.5") == zones.canonical_zone("UTC+05:30") == "+05:30"
    for bad in ("Nowhere/City", "+25:00", "+05:61", ""):
        with pytest.raises(ValueError):
            zones.canonical_zone(bad)


def bounds(spark, instants, spec, zone):
    df = spark.createDataFrame([(i,) for i in instants], "t timestamp")
    df = df.select("t", slot_of(spec, F.col("t"), zone).alias("_slot"))
    df = with_bounds(df, spec, zone, label="label")
    return {
        r.t: (r._start.replace(tzinfo=UTC), r._end.replace(tzinfo=UTC), r.label)
        for r in df.select(
            F.col("t").cast("timestamp_ntz").alias("t"),
            F.col("_start").cast("timestamp_ntz").alias("_start"),
            F.col("_end").cast("timestamp_ntz").alias("_end"), "label",
        ).collect()
    }


def u(*parts):
    return datetime(*parts, tzinfo=UTC)


MONSOONS = SeasonPeriod(seasons=(
        Season("Northeast Monsoon", 12), Season("First Inter-monsoon", 3),
        Season("Southwest Monsoon", 6), Season("Second Inter-monsoon", 10),
    ),
)

LITERAL = [
    (clock(hours=8), "UTC", u(2026, 1, 1, 9), u(2026, 1, 1, 8), u(2026, 1, 1, 16), None),
    (day(time(6)), "UTC", u(2026, 1, 1, 5), u(2025, 12, 31, 6), u(2026, 1, 1, 6), "2025-12-31"),
    (WeekPeriod(day_start=time(6), first_weekday=6), "UTC", u(2026, 1, 4, 5),
     u(2025, 12, 28, 6), u(2026, 1, 4, 6), "Week 2025-12-28"),
    (MonthPeriod(), "UTC", u(2026, 2, 10), u(2026, 2, 1), u(2026, 3, 1), "2026-02"),
    (QuarterPeriod(first_month=2), "UTC", u(2026, 1, 10),
     u(2025, 11, 1), u(2026, 2, 1), "Q4 2025"),
    (YearPeriod(first_month=4), "UTC", u(2026, 3, 31, 23),
     u(2025, 4, 1), u(2026, 4, 1), "Year 2025-04-01"),
    (AnchoredDays(length=timedelta(days=30), anchor=datetime(2026, 1, 1)),
     "UTC", u(2026, 2, 1), u(2026, 1, 31), u(2026, 3, 2), None),
    (AnchoredYear(anchor=datetime(2024, 1, 1)), "UTC", u(2025, 1, 1),
     u(2024, 12, 31), u(2025, 12, 31), None),
    (MONSOONS, "UTC", u(2026, 1, 15), u(2025, 12, 1), u(2026, 3, 1), "Northeast Monsoon 2025"),
    (day(), "America/New_York", u(2026, 3, 8, 12), u(2026, 3, 8, 5), u(2026, 3, 9, 4), "2026-03-08"),
    (day(), "America/New_York", u(2026, 11, 1, 12), u(2026, 11, 1, 4), u(2026, 11, 2, 5), "2026-11-01"),
    # Repeated hour: one period with two hourly slots.
    (clock(hours=1), "America/New_York", u(2026, 11, 1, 6, 30), u(2026, 11, 1, 5), u(2026, 11, 1, 7), None),
    # Half-hour clock inside the repeated hour: the first reading of each wall slot counts.
    (clock(minutes=30), "America/New_York", u(2026, 11, 1, 6, 40), u(2026, 11, 1, 5, 30), u(2026, 11, 1, 7), None),
    # A day edge lost to daylight saving moves to the next wall minute.
    (day(time(2, 30)), "America/New_York", u(2026, 3, 8, 12), u(2026, 3, 8, 7), u(2026, 3, 9, 6, 30), "2026-03-08"),
]


@pytest.mark.parametrize("case", LITERAL, ids=lambda c: f"{c[0].kind}-{c[1]}-{c[2]:%m%d%H}")
def test_literal_periods(spark, case):
    spec, zone, at, start, end, label = case
    found = bounds(spark, [at], spec, zone)[at.replace(tzinfo=None)]
    assert found[:2] == (start, end)
    if label:
        assert found[2] == label


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    zone=st.sampled_from(ZONES),
    shift=st.integers(0, 23),
    seeds=st.lists(st.integers(946_684_800, 1_767_225_600), min_size=20, max_size=20),
    weekday=st.integers(0, 6),
)
def test_day_and_week_edges_match_zoneinfo(spark, zone, shift, seeds, weekday):
    instants = [datetime.fromtimestamp(s, UTC) for s in seeds]
    for spec, length in (
        (day(time(shift)), 1),
        (WeekPeriod(day_start=time(shift), first_weekday=weekday), 7),
    ):
        found = bounds(spark, instants, spec, zone)
        for at in instants:
            wall = at.astimezone(ZoneInfo(zone)).replace(tzinfo=None) - timedelta(hours=shift)
            first = wall.date()
            if length == 7:
                first -= timedelta(days=(first.weekday() - weekday) % 7)
            start = datetime.combine(first, time(shift))
            want = edge(start, zone), edge(start + timedelta(days=length), zone)
            assert found[at.replace(tzinfo=None)][:2] == want, (zone, at, spec)


def test_tiling_skips_lost_clock_slots_and_refuses_misfits(spark):
    df = spark.createDataFrame([(u(2026, 3, 8, 12),), (u(2026, 11, 1, 12),)], "t timestamp")
    target = day()
    df = df.select(slot_of(target, F.col("t"), "America/New_York").alias("_slot"))
    df = with_bounds(df, target, "America/New_York")
    counts = [r[0] for r in with_tiling(df, clock(hours=1), "America/New_York").orderBy("_slot").select("_expected").collect()]
    assert counts == [23, 24]
    misfit = AnchoredDays(length=timedelta(days=5), anchor=datetime(2026, 1, 1))
    with pytest.raises(Exception, match="tile"):
        with_tiling(df, misfit, "America/New_York").collect()


def test_period_settings_are_checked():
    for kind, bad in (
        (ClockPeriod, {"length": timedelta(hours=5)}),
        (ClockPeriod, {"length": timedelta(days=2)}),
        (ClockPeriod, {"length": timedelta(0)}),
        (AnchoredDays, {"length": timedelta(days=-1)}),
        (SeasonPeriod, {"seasons": (Season("a", 1),)}),
        (SeasonPeriod, {"seasons": (Season("a", 1), Season("A", 2))}),
        (SeasonPeriod, {"seasons": (Season("a", 1), Season("b", 1))}),
        (YearPeriod, {"first_month": 2, "first_day": 29}),
        (QuarterPeriod, {"first_month": 13}),
        (WeekPeriod, {"first_weekday": 7}),
        (DayPeriod, {"day_start": time(1, tzinfo=UTC)}),
    ):
        with pytest.raises(ValueError):
            kind(**bad)
    with pytest.raises(ValueError, match="names must differ; season starts must differ"):
        SeasonPeriod(seasons=(Season("a", 1), Season("A", 1)))
