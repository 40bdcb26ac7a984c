"""Time zones: names, wall clock of an instant, and the three localisation rules.

Wall-clock values travel as BIGINT micros ("the clock face read as if it were UTC"), which
keeps calendar arithmetic inside integer code generation.

Three rules turn a wall clock into an instant and must stay separate:

* ``localize``: skipped times are an error, repeated times follow an explicit choice;
* ``localize_lenient``: repeated times take the first reading, skipped ones move forward;
* ``with_boundary``: repeated times take the earliest reading, skipped ones move to the next
  wall minute that exists (reporting-period edges).
"""

from __future__ import annotations

import re
from functools import lru_cache
from datetime import UTC, datetime, timedelta, timezone, tzinfo
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, functions as F

from gridwright.functions.names import col

DAY = 86_400_000_000
MINUTE = 60_000_000

# Spellings accepted besides IANA names and signed offsets.
ZONE_ALIASES = {
    "Colombo": "Asia/Colombo",
    "+5.5": "+05:30",
    "UTC+5.5": "+05:30",
}

# An offset of less than a day; UTC may stand before it.
_OFFSET = re.compile(r"(?:UTC)?([+-])([01]\d|2[0-3]):([0-5]\d)")


def canonical_zone(name: str) -> str:
    """An IANA name or ``±HH:MM``; anything else raises."""
    wanted = ZONE_ALIASES.get(name.strip(), name.strip())
    if offset := _OFFSET.fullmatch(wanted):
        return wanted[offset.start(1) :]
    if wanted not in _named_zones():
        raise ValueError(f"unknown time zone {name!r}")
    return wanted


@lru_cache(maxsize=1)
def _named_zones() -> frozenset[str]:
    return frozenset(available_timezones())


def fixed_offset_micros(zone: str) -> int | None:
    """Offset of a zone that never changes (UTC or ``±HH:MM``), else None."""
    if zone in ("UTC", "Etc/UTC", "Z"):
        return 0
    found = _OFFSET.fullmatch(zone)
    if not found:
        return None
    minutes = int(found[2]) * 60 + int(found[3])
    return (minutes if found[1] == "+" else -minutes) * MINUTE


def offset_name(minutes: int) -> str:
    if not -1439 <= minutes <= 1439:
        raise ValueError("a manual UTC offset lies between -23:59 and +23:59")
    sign = "-" if minutes < 0 else "+"
    return f"{sign}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def zone_from_column(zone: Column) -> Column:
    """Canonical zone text of a column; a blank zone is an error."""
    text = F.trim(zone)
    for alias, real in ZONE_ALIASES.items():
        text = F.when(F.trim(zone) == alias, F.lit(real)).otherwise(text)
    text = F.regexp_replace(text, r"^UTC(?=[+-]\d{2}:\d{2}$)", "")
    return F.when(
        F.coalesce(F.trim(zone), F.lit("")) == "",
        F.raise_error(F.lit("the time-zone column holds a blank value")).cast("string"),
    ).otherwise(text)


def _offset_at(instant: Column, zone: Column) -> Column:
    local = F.from_utc_timestamp(F.timestamp_micros(instant), zone)
    return F.unix_micros(local) - instant


def wall_micros(instant: Column, zone: str | Column) -> Column:
    """Wall-clock micros shown in ``zone`` at a TIMESTAMP."""
    if isinstance(zone, str):
        fixed = fixed_offset_micros(zone)
        if fixed is not None:
            return F.unix_micros(instant) + F.lit(fixed) if fixed else F.unix_micros(instant)
        zone = F.lit(zone)
    return F.unix_micros(F.from_utc_timestamp(instant, zone))


def wall_clock(instant: Column, zone: str | Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ shown in ``zone`` at a TIMESTAMP."""
    if isinstance(zone, str) and fixed_offset_micros(zone) == 0:
        return instant.cast("timestamp_ntz")
    zone = F.lit(zone) if isinstance(zone, str) else zone
    return F.from_utc_timestamp(instant, zone).cast("timestamp_ntz")


def localize_lenient(wall: Column, zone: str) -> Column:
    """Attach a zone to a wall clock: first reading of an overlap, shift through a gap."""
    wall = wall.cast("timestamp")
    return wall if fixed_offset_micros(zone) == 0 else F.to_utc_timestamp(wall, F.lit(zone))


def with_candidates(df: DataFrame, wall: str, zone: str | Column, tag: str) -> DataFrame:
    """Add ``{tag}_first`` / ``{tag}_last``: the instants (micros) whose wall clock is ``wall``
    (micros). Both null: the time is skipped. Different: the time is repeated.

    The offsets one day either side of the transition are the only two candidates; each is
    kept when the round trip returns the same wall clock.
    """
    fixed = fixed_offset_micros(zone) if isinstance(zone, str) else None
    if fixed is not None:
        instant = col(wall) - F.lit(fixed)
        return df.select("*", instant.alias(f"{tag}_first"), instant.alias(f"{tag}_last"))
    z = F.lit(zone) if isinstance(zone, str) else zone
    df = df.select(
        "*",
        F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(col(wall)), z)).alias(f"{tag}_near"),
    )
    df = df.select(
        "*",
        _offset_at(col(f"{tag}_near") - F.lit(DAY), z).alias(f"{tag}_before"),
        _offset_at(col(f"{tag}_near") + F.lit(DAY), z).alias(f"{tag}_after"),
    )
    readings = []
    for offset in (f"{tag}_before", f"{tag}_after"):
        candidate = col(wall) - col(offset)
        readings.append(F.when(_offset_at(candidate, z) == col(offset), candidate))
    return df.select(
        "*",
        F.least(*readings).alias(f"{tag}_first"),
        F.greatest(*readings).alias(f"{tag}_last"),
    )


def _helpers(tag: str) -> list[str]:
    return [f"{tag}_{part}" for part in ("near", "before", "after", "first", "last")]


def localize(
    df: DataFrame,
    wall: Column,
    output: str,
    zone: str | Column,
    *,
    ambiguous: str = "raise",
    invalid: str = "raise",
) -> DataFrame:
    """Add TIMESTAMP ``output`` for a TIMESTAMP_NTZ wall clock.

    ``ambiguous``: ``raise``, ``first`` or ``second``. A skipped time always fails;
    ``invalid="null"`` marks failures with null instead of raising, for violation reports.
    """
    if ambiguous not in ("raise", "first", "second"):
        raise ValueError("ambiguous is one of raise, first, second")
    names = df.columns
    df = df.select("*", F.unix_micros(wall.cast("timestamp")).alias("__wall"))
    df = with_candidates(df, "__wall", zone, "__loc")
    first, last = col("__loc_first"), col("__loc_last")

    def fail(why: str) -> Column:
        if invalid == "null":
            return F.lit(None).cast("bigint")
        return F.raise_error(
            F.concat(F.lit(f"local time {why}: "), F.timestamp_micros(col("__wall")).cast("string"))
        ).cast("bigint")

    value = F.when(col("__wall").isNull(), F.lit(None).cast("bigint")).when(
        first.isNull(), fail("does not exist")
    )
    if ambiguous == "raise":
        value = value.when(first != last, fail("is ambiguous")).otherwise(first)
    else:
        value = value.otherwise(first if ambiguous == "first" else last)
    kept = [col(n) for n in names if n != output]
    return df.select(*kept, F.timestamp_micros(value).alias(output))


def with_boundary(df: DataFrame, wall: str, output: str, zone: str, *, strict: bool) -> DataFrame:
    """Add BIGINT micros ``output``: the instant of a period edge given as wall micros.

    ``strict`` raises on skipped or repeated edges; otherwise a repeated edge is the earliest
    reading and a skipped one the next wall minute that exists.
    """
    names = df.columns
    df = with_candidates(df, wall, zone, "__edge")
    first, last = col("__edge_first"), col("__edge_last")
    if fixed_offset_micros(zone) is not None:
        value = first
    elif strict:
        text = F.timestamp_micros(col(wall)).cast("string")
        value = (
            F.when(
                first.isNull(),
                F.raise_error(F.concat(F.lit("period edge does not exist: "), text)).cast("bigint"),
            )
            .when(
                first != last,
                F.raise_error(F.concat(F.lit("period edge is ambiguous: "), text)).cast("bigint"),
            )
            .otherwise(first)
        )
    else:
        after = col("__edge_after")
        probes = F.filter(
            F.sequence(F.lit(1).cast("bigint"), F.lit(24 * 60).cast("bigint")),
            lambda k: _offset_at(col(wall) + k * F.lit(MINUTE) - after, F.lit(zone)) == after,
        )
        moved = col(wall) + F.try_element_at(probes, F.lit(1)) * F.lit(MINUTE) - after
        value = F.when(first.isNotNull(), first).otherwise(moved)
    return df.select(*[col(n) for n in names], value.alias(output))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, for expressions used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def edge_micros(wall: Column, zone: str) -> Column:
    """The lenient rule of ``with_boundary`` as one expression (usable inside lambdas)."""
    fixed = fixed_offset_micros(zone)
    if fixed is not None:
        return wall - F.lit(fixed)
    z = F.lit(zone)

    def place(w: Column, before: Column, after: Column) -> Column:
        first = F.least(
            *[F.when(_offset_at(w - o, z) == o, w - o) for o in (before, after)]
        )
        probes = F.filter(
            F.sequence(F.lit(1).cast("bigint"), F.lit(24 * 60).cast("bigint")),
            lambda k: _offset_at(w + k * F.lit(MINUTE) - after, z) == after,
        )
        moved = w + F.try_element_at(probes, F.lit(1)) * F.lit(MINUTE) - after
        return F.coalesce(first, moved)

    def around(w: Column) -> Column:
        near = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(w), z))
        return let(
            near,
            lambda n: let(
                _offset_at(n - F.lit(DAY), z),
                lambda b: let(_offset_at(n + F.lit(DAY), z), lambda a: place(w, b, a)),
            ),
        )

    return let(wall, around)


def offset_text(instant: Column, zone: str | Column) -> Column:
    """``+HH:MM`` in force at an instant (``+HH:MM:SS`` where the zone has seconds)."""
    offset = wall_micros(instant, zone) - F.unix_micros(instant)
    size = F.abs(offset)

    def two(value: Column) -> Column:
        return F.lpad(value.cast("bigint").cast("string"), 2, "0")

    seconds = F.floor(size / 1_000_000)
    text = F.concat(
        F.when(offset < 0, F.lit("-")).otherwise(F.lit("+")),
        two(F.floor(seconds / 3600)),
        F.lit(":"),
        two(F.floor(seconds / 60) % 60),
    )
    return F.when(seconds % 60 == 0, text).otherwise(F.concat(text, F.lit(":"), two(seconds % 60)))


def iso_text(instant: Column, zone: str | Column) -> Column:
    """ISO-8601 text with offset, micros shown only when present."""
    local = wall_clock(instant, zone)
    base = F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(
        F.unix_micros(instant) % 1_000_000 == 0, F.lit("")
    ).otherwise(F.date_format(local, ".SSSSSS"))
    return F.concat(base, fraction, offset_text(instant, zone))


def anchor_micros(anchor: datetime, zone: str) -> int:
    """Instant of a configured anchor: an aware anchor as is, a naive one as a period edge."""
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    fixed = fixed_offset_micros(zone)
    info: tzinfo = (
        timezone(timedelta(microseconds=fixed)) if fixed is not None else ZoneInfo(zone)
    )

    def exists(moment: datetime) -> bool:
        return moment.astimezone(UTC).astimezone(info).replace(tzinfo=None) == anchor_wall

    if anchor.tzinfo is not None:
        instant = anchor.astimezone(UTC)
    else:
        instant = None
        for step in range(24 * 60 + 1):
            anchor_wall = anchor + timedelta(minutes=step)
            readings = [anchor_wall.replace(tzinfo=info, fold=f) for f in (0, 1)]
            real = [r.astimezone(UTC) for r in readings if exists(r)]
            if real:
                instant = min(real)
                break
        if instant is None:
            raise ValueError(f"anchor {anchor} cannot be placed in {zone}")
    delta = instant - epoch
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds
