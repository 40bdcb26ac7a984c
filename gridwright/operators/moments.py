"""Date/time columns: parse, format, combine, split, intervals, shifts, zone conversion."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridwright.config import MICROS_PER_DAY, EndMode, InvalidPolicy, TimestampRole, micros
from gridwright.functions import temporal, zones
from gridwright.functions.names import col, dtype, is_instant, is_wall, put, require
from gridwright.operators.diagnostics import Diagnostics, watch, write_result


def parse_datetime(
    df: DataFrame,
    source: str,
    profile: str | temporal.Profile,
    *,
    output: str | None = None,
    policy: InvalidPolicy = InvalidPolicy.STOP,
    notes: Diagnostics | None = None,
) -> DataFrame:
    """Read a column by one named profile or mask; nulls pass."""
    p = temporal.profile(profile)
    value = temporal.parse(col(source), dtype(df, source), p)
    return write_result(
        df, source, output, value, p.spark_type, policy, "invalid_temporal_values", notes
    )


def format_datetime(
    df: DataFrame,
    source: str,
    profile: str | temporal.Profile,
    *,
    output: str | None = None,
    zone: str | Column = "UTC",
    policy: InvalidPolicy = InvalidPolicy.STOP,
    notes: Diagnostics | None = None,
) -> DataFrame:
    """Text of a temporal column. ``zone`` is the display zone of instants; a UTC or offset
    profile applied to zone-less values fails by policy."""
    zone = zones.canonical_zone(zone) if isinstance(zone, str) else zone
    value = temporal.format_value(col(source), dtype(df, source), profile, zone)
    return write_result(
        df, source, output, value, "string", policy, "invalid_temporal_values", notes
    )


def interpretations(df: DataFrame, source: str, order: str = "_ord") -> DataFrame:
    """Long list of every distinct reading of each text value."""
    require(df, source, order)
    return df.select(
        col(order), col(source), F.explode(temporal.interpretations(col(source))).alias("r")
    ).select(col(order), col(source), "r.profile", "r.display", "r.kind", "r.value")


def parse_unambiguous(
    df: DataFrame, source: str, *, output: str = "reading", strict: bool = False
) -> DataFrame:
    """ISO text of the only reading, with ``<output>_status`` ok / no_match / ambiguous."""
    readings = temporal.interpretations(col(source))
    df = df.select("*", readings.alias("__r"))
    n = F.size("__r")
    status = F.when(n == 1, "ok").when(n == 0, "no_match").otherwise("ambiguous")
    status = F.when(col(source).isNotNull(), status)
    value = F.when(n == 1, F.get("__r", F.lit(0))["value"])
    if strict:
        text = F.concat(F.lit("no single reading of: "), col(source))
        bad = col(source).isNotNull() & (n != 1)
        value = F.when(bad, F.raise_error(text).cast("string")).otherwise(value)
    return df.select("*", value.alias(output), status.alias(f"{output}_status")).drop("__r")


def _day_of(value: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.DateType):
        return value
    if is_instant(kind) or is_wall(kind):
        return value.cast("date")
    raise ValueError(f"column {name!r} does not hold dates")


def _time_of(value: Column, kind: T.DataType, name: str) -> Column:
    if isinstance(kind, T.LongType):
        return value
    if is_instant(kind) or is_wall(kind):
        return F.pmod(F.unix_micros(value.cast("timestamp")), F.lit(MICROS_PER_DAY))
    raise ValueError(f"column {name!r} does not hold times of day")


def combine_date_time(df: DataFrame, date: str, time: str, output: str = "DateTime") -> DataFrame:
    """Wall clock of a date and a time of day; null when either is null."""
    day = _day_of(col(date), dtype(df, date), date)
    at = _time_of(col(time), dtype(df, time), time)
    value = F.timestamp_micros(F.unix_date(day).cast("bigint") * F.lit(MICROS_PER_DAY) + at)
    return put(df, output, value.cast("timestamp_ntz"))


def split_datetime(
    df: DataFrame, source: str, date_output: str = "Date", time_output: str = "Time",
    *, zone: str = "UTC",
) -> DataFrame:
    """DATE and micros-of-day columns of a datetime (as shown in ``zone`` for instants)."""
    wall = _wall(df, source, zone)
    df = put(df, date_output, wall.cast("date"))
    return put(
        df, time_output, F.pmod(F.unix_micros(wall.cast("timestamp")), F.lit(MICROS_PER_DAY))
    )


def _wall(df: DataFrame, name: str, zone: str) -> Column:
    kind = dtype(df, name)
    if is_wall(kind):
        return col(name)
    if is_instant(kind):
        return zones.wall_clock(col(name), zones.canonical_zone(zone))
    raise ValueError(f"column {name!r} does not hold datetimes")


def moved(value: Column, kind: T.DataType, shift: int, zone: str) -> Column:
    """Add micros to the wall clock; an instant keeps its zone and is placed again."""
    step = F.lit(shift).cast("bigint")
    if is_wall(kind):
        at = F.unix_micros(value.cast("timestamp")) + step
        return F.timestamp_micros(at).cast("timestamp_ntz")
    zone = zones.canonical_zone(zone)
    if zones.fixed_offset_micros(zone) is not None:
        return F.timestamp_micros(F.unix_micros(value) + step)
    at = zones.wall_micros(value, zone) + step
    return zones.localize_lenient(F.timestamp_micros(at), zone)


def derive_intervals(
    df: DataFrame,
    source: str,
    role: TimestampRole | str,
    duration: timedelta,
    *,
    start: str | None = "Start",
    midpoint: str | None = "Mid",
    end: str | None = "End",
    zone: str = "UTC",
) -> DataFrame:
    """Start, midpoint and end of the sampling interval a timestamp stands for."""
    span = micros(duration)
    # Offsets of the interval start by role; midpoints use half the duration.
    back = {"start": 0, "midpoint": span // 2, "end": span}.get(TimestampRole(role).value)
    if back is None:
        raise ValueError(f"timestamp role {role!r} does not define interval edges")
    kind = dtype(df, source)
    if not (is_wall(kind) or is_instant(kind)):
        raise ValueError(f"column {source!r} does not hold datetimes")
    for name, forward in ((start, 0), (midpoint, span // 2), (end, span)):
        if name is not None:
            df = put(df, name, moved(col(source), kind, forward - back, zone))
    return df


def normalize_interval_end(
    df: DataFrame,
    start: str,
    end: str,
    duration: timedelta,
    *,
    mode: EndMode | str = EndMode.SEMANTIC,
    tolerance: timedelta = timedelta(minutes=1),
    notes: Diagnostics | None = None,
) -> DataFrame:
    """Replace inclusive or missing interval ends by start + duration.

    An end at most ``tolerance`` below the expected one is normalised; any other difference
    is kept and counted as unresolved. A null start keeps the supplied end.
    """
    if duration <= timedelta(0) or tolerance < timedelta(0):
        raise ValueError("the duration must be positive and the tolerance not negative")
    mode = EndMode(mode)
    if mode is EndMode.RETAIN:
        return df
    kind = dtype(df, start)
    if dtype(df, end) != kind or not (is_wall(kind) or is_instant(kind)):
        raise ValueError("start and end must be datetimes of one type")
    expected = moved(col(start), kind, micros(duration), "UTC")
    short = F.unix_micros(expected.cast("timestamp")) - F.unix_micros(col(end).cast("timestamp"))
    has_start = col(start).isNotNull()
    if mode is EndMode.CALCULATE:
        replace = has_start
        unresolved = F.lit(False)
    else:
        near = (short > 0) & (short <= micros(tolerance))
        replace = has_start & (col(end).isNull() | near)
        unresolved = has_start & col(end).isNotNull() & (short != 0) & ~near
    df = watch(notes, df, "interval_ends_normalized", F.count_if(replace))
    df = watch(notes, df, "interval_ends_unresolved", F.count_if(unresolved))
    return put(df, end, F.when(replace, expected).otherwise(col(end)), replaces=end)


def time_shift(
    df: DataFrame, source: str, offset: timedelta, *, output: str | None = None, zone: str = "UTC"
) -> DataFrame:
    """Shift datetimes by wall clock, dates by whole days, times of day modulo 24 h."""
    kind, shift = dtype(df, source), micros(offset)
    if is_wall(kind) or is_instant(kind):
        value = moved(col(source), kind, shift, zone)
    elif isinstance(kind, T.DateType):
        if shift % MICROS_PER_DAY:
            raise ValueError("dates shift by whole days only")
        value = F.date_add(col(source), shift // MICROS_PER_DAY)
    elif isinstance(kind, T.LongType):
        value = F.pmod(col(source) + F.lit(shift).cast("bigint"), F.lit(MICROS_PER_DAY))
    else:
        raise ValueError(f"column {source!r} does not hold temporal values")
    return put(df, output or source, value, replaces=source)


def convert_timezone(
    df: DataFrame,
    source: str,
    target_zone: str,
    *,
    source_kind: str,
    zone: str | None = None,
    zone_column: str | None = None,
    offset_minutes: int | None = None,
    output: str | None = None,
    ambiguous: str = "raise",
    wall_output: str | None = None,
    invalid: str = "raise",
) -> DataFrame:
    """Give a column its instant: ``embedded``, ``fixed_iana``, ``iana_column`` or
    ``manual_offset``. The instant never changes; ``wall_output`` adds the wall clock of the
    target zone. Instants must use ``embedded``, wall clocks must not."""
    target = zones.canonical_zone(target_zone)
    given = (zone is not None, zone_column is not None, offset_minutes is not None)
    needed = {
        "embedded": (False, False, False),
        "fixed_iana": (True, False, False),
        "iana_column": (False, True, False),
        "manual_offset": (False, False, True),
    }
    if needed.get(source_kind) != given:
        raise ValueError(f"inconsistent settings for time-zone source {source_kind!r}")
    kind = dtype(df, source)
    if source_kind == "embedded":
        if not is_instant(kind):
            raise ValueError("wall-clock timestamps need an explicit source zone or offset")
    elif not is_wall(kind):
        raise ValueError("instants carry their own offset; use the embedded source kind")
    name = output or source
    if output is not None and output != source and output in df.columns:
        raise ValueError(f"column {output!r} already exists")
    names = df.columns
    if source_kind == "embedded":
        df = df.select("*", col(source).alias("__instant"))
    else:
        if source_kind == "fixed_iana":
            where: str | Column = zones.canonical_zone(zone)
        elif source_kind == "iana_column":
            require(df, zone_column)
            where = F.when(col(source).isNotNull(), zones.zone_from_column(col(zone_column)))
        else:
            where = zones.offset_name(offset_minutes)
        df = zones.localize(
            df, col(source), "__instant", where, ambiguous=ambiguous, invalid=invalid
        )
    out = [col("__instant").alias(n) if n == name else col(n) for n in names]
    if name not in names:
        out.append(col("__instant").alias(name))
    if wall_output is not None:
        out.append(zones.wall_clock(col("__instant"), target).alias(wall_output))
    return df.select(*out)
