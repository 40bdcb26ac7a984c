"""Reporting periods as integer slots.

Every period kind maps a wall clock to a consecutive BIGINT *slot* with plain integer
arithmetic, so the hot path groups by a number. Period edges and labels (the part that needs
daylight-saving care) are worked out from the slot, once per period instead of once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridwright.config import MICROS_PER_DAY, PeriodKind, Period, micros
from gridwright.functions.names import col, cols
from gridwright.functions.zones import (
    anchor_micros,
    canonical_zone,
    fixed_offset_micros,
    iso_text,
    wall_micros,
    with_boundary,
)

ANCHORED = (PeriodKind.FIXED_DAYS, PeriodKind.FIXED_YEAR)
CLOCKED = (PeriodKind.FIXED_CLOCK, PeriodKind.DAY)


def big(value: int) -> Column:
    return F.lit(value).cast("bigint")


def floor_div(value: Column, divisor: int) -> Column:
    """Floor division of BIGINTs, right for negative values too."""
    return F.call_function("div", value - F.pmod(value, big(divisor)), big(divisor))


def step_micros(spec: Period) -> int:
    if spec.kind is PeriodKind.DAY:
        return MICROS_PER_DAY
    if spec.kind is PeriodKind.FIXED_YEAR:
        return 365 * MICROS_PER_DAY
    return micros(spec.length)


def _date(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def _month_number(day: Column) -> Column:
    return F.year(day).cast("bigint") * 12 + F.month(day) - 1


def _month_days(number: Column) -> Column:
    """Day number of the first day of a month given as months since year 0."""
    year = floor_div(number, 12).cast("int")
    month = (F.pmod(number, big(12)) + 1).cast("int")
    return F.unix_date(F.make_date(year, month, F.lit(1))).cast("bigint")


def _season_days(spec: Period, slot: Column) -> Column:
    seasons = spec.ordered_seasons
    year = floor_div(slot, len(seasons)).cast("int")
    place = F.pmod(slot, big(len(seasons)))
    value = F.lit(None).cast("date")
    for index, season in enumerate(seasons):
        start = F.make_date(year, F.lit(season.month), F.lit(season.day))
        value = F.when(place == index, start).otherwise(value)
    return F.unix_date(value).cast("bigint")


def slot_of(spec: Period, instant: Column, zone: str) -> Column:
    """BIGINT slot of the period holding a TIMESTAMP."""
    zone = canonical_zone(zone)
    if spec.kind in ANCHORED:
        step = step_micros(spec)
        return floor_div(F.unix_micros(instant) - big(anchor_micros(spec.anchor, zone)), step)
    return slot_of_wall(spec, wall_micros(instant, zone))


def slot_of_wall(spec: Period, wall: Column) -> Column:
    """BIGINT slot of a wall clock given in micros (calendar and clock kinds)."""
    shifted = wall - big(spec.day_start_micros) if spec.day_start_micros else wall
    kind = spec.kind
    if kind in CLOCKED:
        return floor_div(shifted, step_micros(spec))
    days = floor_div(shifted, MICROS_PER_DAY)
    if kind is PeriodKind.WEEK:
        return floor_div(days + (3 - spec.first_weekday), 7)
    reporting = _date(days)
    if kind is PeriodKind.CALENDAR_MONTH:
        return _month_number(reporting)
    if kind is PeriodKind.QUARTER:
        return floor_div(_month_number(reporting) - (spec.first_month - 1), 3)
    year = F.year(reporting)
    if kind is PeriodKind.CALENDAR_YEAR:
        start = F.make_date(year, F.lit(spec.first_month), F.lit(spec.first_day))
        return year.cast("bigint") - (reporting < start).cast("bigint")
    # Seasons: the shifted wall lies in the same season as the wall itself, because every
    # boundary carries the same day start.
    started = big(0)
    for season in spec.seasons:
        start = F.make_date(year, F.lit(season.month), F.lit(season.day))
        started = started + (reporting >= start).cast("bigint")
    return year.cast("bigint") * len(spec.seasons) + started - 1


def slot_days(spec: Period, slot: Column) -> Column:
    """Day number on which a calendar slot starts."""
    kind = spec.kind
    if kind is PeriodKind.WEEK:
        return slot * 7 - (3 - spec.first_weekday)
    if kind is PeriodKind.CALENDAR_MONTH:
        return _month_days(slot)
    if kind is PeriodKind.QUARTER:
        return _month_days(slot * 3 + (spec.first_month - 1))
    if kind is PeriodKind.CALENDAR_YEAR:
        start = F.make_date(
            slot.cast("int"), F.lit(spec.first_month), F.lit(spec.first_day)
        )
        return F.unix_date(start).cast("bigint")
    return _season_days(spec, slot)


def slot_wall(spec: Period, slot: Column) -> Column:
    """Wall-clock micros at which a calendar or clock slot starts."""
    if spec.kind in CLOCKED:
        return slot * big(step_micros(spec)) + big(spec.day_start_micros)
    return slot_days(spec, slot) * big(MICROS_PER_DAY) + big(spec.day_start_micros)


def slot_label(spec: Period, slot: Column, start: Column, end: Column, zone: str) -> Column:
    kind = spec.kind
    if kind in ANCHORED or kind is PeriodKind.FIXED_CLOCK:
        return F.concat(iso_text(start, zone), F.lit(" / "), iso_text(end, zone))
    if kind is PeriodKind.DAY:
        return _date(slot).cast("string")
    first = _date(slot_days(spec, slot))
    if kind is PeriodKind.WEEK:
        return F.concat(F.lit("Week "), first.cast("string"))
    if kind is PeriodKind.CALENDAR_MONTH:
        return F.date_format(first, "yyyy-MM")
    if kind is PeriodKind.QUARTER:
        number = (F.pmod(slot, big(4)) + 1).cast("string")
        return F.concat(F.lit("Q"), number, F.lit(" "), F.year(first).cast("string"))
    if kind is PeriodKind.CALENDAR_YEAR:
        return F.concat(F.lit("Year "), first.cast("string"))
    names = F.array(*[F.lit(s.name) for s in spec.ordered_seasons])
    place = F.pmod(slot, big(len(spec.seasons))).cast("int")
    return F.concat(F.get(names, place), F.lit(" "), F.year(first).cast("string"))


def with_bounds(
    df: DataFrame,
    spec: Period,
    zone: str,
    *,
    slot: str = "_slot",
    start: str = "_start",
    end: str = "_end",
    label: str | None = None,
    day_shift: int = 0,
    strict: bool = False,
) -> DataFrame:
    """Add TIMESTAMP period edges (and a label) to rows that carry a slot.

    ``day_shift`` moves wall-clock edges by whole days (months that start on day 15, say);
    ``strict`` raises on edges that daylight saving skips or repeats. A zero-length period
    (a clock slot lying wholly inside a skipped hour) has ``start = end``.
    """
    zone = canonical_zone(zone)
    names = df.columns
    at = col(slot)
    if spec.kind in ANCHORED:
        step = big(step_micros(spec))
        origin = big(anchor_micros(spec.anchor, zone))
        df = df.select(
            "*",
            F.timestamp_micros(origin + at * step).alias(start),
            F.timestamp_micros(origin + (at + 1) * step).alias(end),
        )
    elif fixed_offset_micros(zone) is not None:
        back = day_shift * MICROS_PER_DAY - fixed_offset_micros(zone)
        df = df.select(
            "*",
            F.timestamp_micros(slot_wall(spec, at) + big(back)).alias(start),
            F.timestamp_micros(slot_wall(spec, at + 1) + big(back)).alias(end),
        )
    else:
        shift = big(day_shift * MICROS_PER_DAY)
        df = df.select(
            "*",
            (slot_wall(spec, at) + shift).alias("__w0"),
            (slot_wall(spec, at + 1) + shift).alias("__w1"),
        )
        df = with_boundary(df, "__w0", "__i0", zone, strict=strict)
        df = with_boundary(df, "__w1", "__i1", zone, strict=strict)
        df = df.select(
            *cols(names),
            F.timestamp_micros(col("__i0")).alias(start),
            F.timestamp_micros(col("__i1")).alias(end),
        )
    if label is not None:
        df = df.select("*", slot_label(spec, at, col(start), col(end), zone).alias(label))
    return df


SLOTS_PER_BLOCK = 4096


def explode_range(
    df: DataFrame, low: str, high: str, output: str, *, keep: Sequence[str]
) -> DataFrame:
    """One row per integer in ``[low, high]``.

    Ranges are first cut into blocks that are spread over the cluster, so neither one row's
    array nor one series' expansion grows with the length of the range.
    """
    size = big(SLOTS_PER_BLOCK)
    blocks = F.sequence(big(0), floor_div(col(high) - col(low), SLOTS_PER_BLOCK))
    df = df.where(col(high) >= col(low)).select(
        *cols(keep), col(low).alias("__lo"), col(high).alias("__hi"), F.explode(blocks).alias("__b")
    )
    df = df.repartition(*cols(keep), col("__b"))
    first = col("__lo") + col("__b") * size
    last = F.least(col("__hi"), first + size - 1)
    return df.select(*cols(keep), F.explode(F.sequence(first, last)).alias(output))
