"""Splitting by calendar period or field group; joining by exact instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridwright.config import (
    Action,
    DuplicatePolicy,
    FieldGroup,
    MatchPolicy,
    PeriodKind,
    SourceSpec,
    SplitJoinSpec,
)
from gridwright.errors import DataViolation
from gridwright.functions import numeric, temporal, zones
from gridwright.functions.names import col, cols, dtype, is_instant, is_text, require
from gridwright.functions.periods import big, slot_of_wall, with_bounds

SPLIT_KINDS = (
    PeriodKind.CALENDAR_YEAR,
    PeriodKind.CALENDAR_MONTH,
    PeriodKind.WEEK,
    PeriodKind.QUARTER,
    PeriodKind.SEASON,
    PeriodKind.DAY,
)

ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
)


def parse_instants(
    df: DataFrame, source: SourceSpec, output: str = "_ts", *, strict: bool = True
) -> DataFrame:
    """Instant of each row: ISO text (or a mask), an embedded offset first, else the source
    zone with skipped and repeated times refused. Without ``strict`` failures become null."""
    kind = dtype(df, source.timestamp)
    zone = zones.canonical_zone(source.zone)
    value = col(source.timestamp)
    if is_instant(kind):
        return df.select("*", value.alias(output))
    embedded: Column = F.lit(None).cast("timestamp")
    if is_text(kind):
        text = numeric.strip(value)
        if source.pattern == "ISO":
            usual = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}).(\d{2})$", "$1T$2:00")
            usual = F.regexp_replace(usual, r"([+-]\d{2})(\d{2})$", "$1:$2")
            moment = F.when(text.rlike(ISO_SHAPE), usual.try_cast("timestamp"))
            has_offset = text.rlike(r".\d{2}(Z|[+-]\d{2}:?\d{2})$") & text.contains(":")
            embedded = F.when(has_offset, moment)
            wall = F.when(~has_offset, moment).cast("timestamp_ntz")
        else:
            profile = temporal.mask_profile("datetime", source.pattern)
            parsed = temporal.parse_text(value, profile)
            if profile.aware:
                embedded, wall = parsed, F.lit(None).cast("timestamp_ntz")
            else:
                wall = parsed
    else:
        wall = value.cast("timestamp_ntz")
    df = df.select("*", embedded.alias("__e"), wall.alias("__w"))
    df = zones.localize(df, col("__w"), "__i", zone, invalid="raise" if strict else "null")
    result = F.coalesce(col("__e"), col("__i"))
    if strict:
        message = F.concat(
            F.lit(f"{source.name}: invalid or missing timestamp "),
            F.coalesce(value.cast("string"), F.lit("null")),
        )
        result = F.when(
            col("__e").isNull() & col("__w").isNull(), F.raise_error(message).cast("timestamp")
        ).otherwise(result)
    return df.select("*", result.alias(output)).drop("__e", "__w", "__i")


def prepare_source(
    df: DataFrame,
    source: SourceSpec,
    number: int,
    *,
    keys: Sequence[str] = (),
    order: str = "_ord",
    strict: bool = True,
) -> DataFrame:
    """``keys, _ts, _src, _ord`` and the selected fields (default: all but the timestamp)."""
    require(df, source.timestamp, order, *keys)
    fields = list(source.fields) or [
        n for n in df.columns if n not in {source.timestamp, order, *keys}
    ]
    require(df, *fields)
    if not fields or source.timestamp in fields or len(set(fields)) != len(fields):
        raise ValueError(f"select unique non-timestamp fields for {source.name}")
    parsed = parse_instants(df, source, strict=strict)
    return parsed.select(
        *cols(keys), "_ts", F.lit(number).alias("_src"), col(order).cast("bigint").alias("_ord"),
        *cols(fields),
    )


def _fields(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [n for n in df.columns if n not in {"_ts", "_src", "_ord", *keys}]


def join_time(
    sources: Sequence[DataFrame],
    duplicates: DuplicatePolicy = DuplicatePolicy.ERROR,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Concatenate prepared sources in time. First / last keep one row per instant across and
    within sources, by source then row order; keep retains all; error refuses repeats."""
    _check_sources(sources)
    names = _fields(sources[0], keys)
    if any(_fields(s, keys) != names for s in sources[1:]):
        raise ValueError("a time join needs the same field names in the same order")
    rows = sources[0]
    for other in sources[1:]:
        rows = rows.union(other.select(*cols(rows.columns)))
    if duplicates is DuplicatePolicy.KEEP:
        return rows
    place = F.struct("_src", "_ord", *cols(names))
    pick = F.max(place) if duplicates is DuplicatePolicy.LAST else F.min(place)
    exprs = [pick.alias("__r")]
    if duplicates is DuplicatePolicy.ERROR:
        exprs.append(F.count("*").alias("__n"))
    kept = rows.groupBy(*cols(keys), "_ts").agg(*exprs)
    at = col("_ts")
    if duplicates is DuplicatePolicy.ERROR:
        message = F.concat(F.lit("repeated timestamp "), at.cast("string"))
        at = F.when(col("__n") > 1, F.raise_error(message).cast("timestamp")).otherwise(at)
    return kept.select(
        *cols(keys), at.alias("_ts"), F.col("__r._src"), F.col("__r._ord"),
        *[F.col(f"__r.`{n}`") for n in names],
    )


def join_fields(
    sources: Sequence[DataFrame],
    match: MatchPolicy = MatchPolicy.OUTER,
    duplicates: DuplicatePolicy = DuplicatePolicy.ERROR,
    keys: Sequence[str] = (),
    timestamp: str = "Timestamp",
) -> DataFrame:
    """Equi-join of any number of prepared sources on the exact instant, in one shuffle.

    Each source becomes a nullable struct in a common row; one grouped aggregation resolves
    duplicates per source and lines the sources up. Output: keys, timestamp, ``S{n}_{field}``.
    """
    _check_sources(sources)
    if duplicates is DuplicatePolicy.KEEP:
        raise ValueError("a field join needs one row per timestamp and source")
    payloads = [
        F.struct("_ord", *cols(_fields(s, keys))) for s in sources
    ]
    rows = None
    for i, source in enumerate(sources):
        shaped = source.select(
            *cols(keys), "_ts",
            *[
                (payloads[j] if i == j else F.lit(None)).alias(f"s{j}")
                for j in range(len(sources))
            ],
        )
        rows = shaped if rows is None else rows.union(shaped)
    pick = F.max if duplicates is DuplicatePolicy.LAST else F.min
    exprs = [pick(f"s{i}").alias(f"s{i}") for i in range(len(sources))]
    if duplicates is DuplicatePolicy.ERROR:
        exprs += [F.count(f"s{i}").alias(f"n{i}") for i in range(len(sources))]
    grouped = rows.groupBy(*cols(keys), "_ts").agg(*exprs)
    at = col("_ts")
    if duplicates is DuplicatePolicy.ERROR:
        repeated = F.greatest(*[F.col(f"n{i}") for i in range(len(sources))]) > 1
        message = F.concat(F.lit("a source repeats timestamp "), at.cast("string"))
        at = F.when(repeated, F.raise_error(message).cast("timestamp")).otherwise(at)
    if match is MatchPolicy.INNER:
        for i in range(len(sources)):
            grouped = grouped.where(F.col(f"s{i}").isNotNull())
    elif match is MatchPolicy.LEFT:
        grouped = grouped.where(F.col("s0").isNotNull())
    out = [
        F.col(f"s{i}.`{n}`").alias(f"S{i + 1}_{n}")
        for i, s in enumerate(sources)
        for n in _fields(s, keys)
    ]
    return grouped.select(*cols(keys), at.alias(timestamp), *out)


def _check_sources(sources: Sequence[DataFrame]) -> None:
    if len(sources) < 2:
        raise ValueError("joining needs at least two sources")


def split_labels(df: DataFrame, spec: SplitJoinSpec, timestamp: str = "_ts") -> DataFrame:
    """Add ``period_start``, ``period_end`` (instants) and ``period_label`` of the calendar
    period each row belongs to.

    Periods are worked out on the wall clock of the boundary zone; an edge that daylight
    saving skips or repeats is refused, as is a row outside its own period.
    """
    if spec.period.kind not in SPLIT_KINDS:
        raise ValueError(f"cannot split by {spec.period.kind}")
    zone = zones.canonical_zone(spec.zone)
    monthly = spec.period.kind in (PeriodKind.CALENDAR_MONTH, PeriodKind.QUARTER)
    shift = spec.month_start_day - 1 if monthly else 0
    wall = zones.wall_micros(col(timestamp), zone) - big(shift * 86_400_000_000)
    names = df.columns
    rows = df.select("*", slot_of_wall(spec.period, wall).alias("_slot"))
    rows = with_bounds(
        rows, spec.period, zone, start="period_start", end="period_end", label="period_label",
        day_shift=shift, strict=True,
    )
    outside = (col(timestamp) < col("period_start")) | (col(timestamp) >= col("period_end"))
    message = F.concat(F.lit("timestamp outside its period: "), col(timestamp).cast("string"))
    start = F.when(outside, F.raise_error(message).cast("timestamp")).otherwise(col("period_start"))
    return rows.select(*cols(names), start.alias("period_start"), "period_end", "period_label")


def split_fields(
    df: DataFrame,
    groups: Sequence[FieldGroup] = (),
    shared: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """One projection per field group: timestamp, shared fields, group fields. Without groups
    every remaining field is a group of its own."""
    available = _fields(df, keys)
    if not set(shared) <= set(available):
        raise ValueError("shared fields must exist in the source")
    groups = list(groups) or [FieldGroup(n, (n,)) for n in available if n not in set(shared)]
    if not groups:
        raise ValueError("select at least one field to split")
    out = {}
    for group in groups:
        names = list(dict.fromkeys([*shared, *group.fields]))
        if not set(names) <= set(available):
            raise ValueError(f"group {group.name!r} uses an unavailable field")
        out[group.name] = df.select(*cols(keys), "_ts", "_src", "_ord", *cols(names))
    return out


def split_fields_long(
    df: DataFrame,
    groups: Sequence[FieldGroup] = (),
    shared: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """All field groups from one scan: a ``group`` column plus every field, null where the
    group does not use it. Meant for one partitioned write."""
    split = split_fields(df, groups, shared, keys)
    used = {name: set(_fields(frame, keys)) for name, frame in split.items()}
    fields = [n for n in _fields(df, keys) if any(n in u for u in used.values())]
    base = df.select("*", F.explode(F.array(*[F.lit(g) for g in split])).alias("group"))
    values = [
        F.when(col("group").isin([g for g, u in used.items() if n in u]), col(n)).alias(n)
        for n in fields
    ]
    return base.select("group", *cols(keys), "_ts", "_src", "_ord", *values)


def manifest(df: DataFrame, name: Sequence[str], timestamp: str = "_ts") -> DataFrame:
    """One row per output: row count and time range."""
    return df.groupBy(*cols(name)).agg(
        F.count("*").alias("rows"),
        F.min(col(timestamp)).alias("first_timestamp"),
        F.max(col(timestamp)).alias("last_timestamp"),
    )


def check_outputs(
    manifest_rows: DataFrame, limit: int | None = None, *, allow_none: bool = False
) -> int:
    """Number of outputs; raises when there are none, or more than a limit that was asked for."""
    n = manifest_rows.count()
    if limit is not None and n > limit:
        raise DataViolation(f"the plan exceeds the {limit:,} output limit")
    if n == 0 and not allow_none:
        raise DataViolation("no output rows match this plan")
    return n


def split_join(sources: Sequence[DataFrame], spec: SplitJoinSpec) -> DataFrame:
    """Run a plan over prepared sources; split plans carry labels, joins plain rows."""
    keys = spec.keys
    if spec.action is Action.JOIN_TIME:
        joined = join_time(sources, spec.duplicates, keys)
    elif spec.action is Action.JOIN_FIELDS:
        joined = join_fields(sources, spec.match, spec.duplicates, keys, timestamp="_ts")
    else:
        rows = None
        for source in sources:
            part = (
                split_labels(source, spec)
                if spec.action is Action.SPLIT_TIME
                else split_fields_long(source, spec.groups, spec.shared_fields, keys)
            )
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        return rows
    return split_labels(joined, spec) if spec.regroup else joined
