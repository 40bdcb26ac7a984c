"""Completeness-aware period averaging, direct or in stages.

Each stage is one grouped aggregation keyed by (series keys, integer period slot). Partial
aggregation runs before the shuffle, so a hot series costs one small row per task and period.
Everything a stage reports (values, completeness records, summary) is a projection of that one
result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field as dc_field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gridwright.config import (
    MICROS_PER_DAY,
    PERIOD_END,
    PERIOD_START,
    AveragingConfig,
    FieldRule,
    Period,
    PeriodKind,
    Stage,
    Statistic,
    micros,
)
from gridwright.errors import DataViolation
from gridwright.functions.names import col, cols, dtype, is_float, require
from gridwright.functions.periods import (
    ANCHORED,
    CLOCKED,
    SLOTS_PER_BLOCK,
    big,
    explode_range,
    floor_div,
    slot_of,
    slot_wall,
    step_micros,
    with_bounds,
)
from gridwright.functions.zones import (
    anchor_micros,
    canonical_zone,
    edge_micros,
    fixed_offset_micros,
)
from gridwright.operators.ordering import refused_if_any, successive_pairs

ADDITIVE = (Statistic.SUM, Statistic.RAINFALL_ACCUMULATION)
MEANS = (Statistic.ARITHMETIC_MEAN, Statistic.RAIN_RATE_MEAN)

def _fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def finite(value: Column, kind: T.DataType) -> Column:
    """The value itself; a NaN or infinite float is an error at this layer."""
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"averaging needs numeric fields, got {kind.simpleString()}")
    if not is_float(kind):
        return value
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, _fail("averaging values must be finite", "double")).otherwise(
        value.cast("double")
    )


def statistic(value: Column, which: Statistic, weight: Column | None = None) -> Column:
    """Aggregate expression over non-null values; null where there are none."""
    n = F.count(value)
    if which is Statistic.COUNT:
        result = n.cast("bigint")
    elif which is Statistic.MINIMUM:
        result = F.min(value).cast("double")
    elif which is Statistic.MAXIMUM:
        result = F.max(value).cast("double")
    elif which in ADDITIVE:
        result = F.sum(value).cast("double")
    elif which is Statistic.MEDIAN:
        result = F.median(value).cast("double")
    elif which is Statistic.STANDARD_DEVIATION:
        result = F.stddev_pop(value.cast("double"))
    elif which in MEANS:
        result = F.sum(value).cast("double") / n
    else:
        energy = F.pow(F.lit(10.0), value.cast("double") / 10.0)
        if weight is None:
            total, weights = F.sum(energy), n.cast("double")
        else:
            total, weights = F.sum(energy * weight), F.sum(weight)
        total = F.when(
            total == float("inf"), _fail("an energy average overflows", "double")
        ).otherwise(total)
        result = F.lit(10.0) * F.log10(total / weights)
    return F.when(n > 0, result)


def duration_seconds(value: Column, kind: T.DataType) -> Column:
    """Positive Leq weights in seconds from a number or a day-time interval."""
    if isinstance(kind, T.DayTimeIntervalType):
        start = F.lit(0).cast("timestamp")
        seconds = (F.unix_micros(start + value) / 1_000_000).cast("double")
    else:
        seconds = finite(value, kind).cast("double")
    return F.when(
        seconds <= 0, _fail("energy-average durations must be positive", "double")
    ).otherwise(seconds)


@dataclass
class StageResult:
    """One stage. ``frame`` holds keys, slot, period edges, ``expected`` and, per field ``i``,
    ``_n{i}`` (valid count), ``_ok{i}``, ``_two{i}`` and the output column."""

    index: int
    stage: Stage
    config: AveragingConfig
    frame: DataFrame

    @property
    def table(self) -> DataFrame:
        """Keys, Period_Start, Period_End and one column per field."""
        return self.frame.select(
            *cols(self.config.keys),
            col("_start").alias(PERIOD_START),
            col("_end").alias(PERIOD_END),
            *[col(f.output) for f in self.config.fields],
        )

    @property
    def completeness(self) -> DataFrame:
        """One record per period and field."""
        records = F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f.output).alias("field"),
                        col(f"_n{i}").alias("valid_count"),
                        col("_expected").alias("expected_count"),
                        (col(f"_n{i}") / col("_expected")).alias("availability"),
                        col(f"_ok{i}").alias("accepted"),
                        col(f"_two{i}").alias("used_two_of_three"),
                    )
                    for i, f in enumerate(self.config.fields)
                ]
            )
        )
        return self.frame.select(
            F.lit(self.index).cast("bigint").alias("stage_index"),
            *cols(self.config.keys),
            col("_start").alias("period_start"),
            col("_end").alias("period_end"),
            records.alias("r"),
        ).select("stage_index", *cols(self.config.keys), "period_start", "period_end", "r.*")

    @property
    def report(self) -> DataFrame:
        """One row: periods evaluated, values accepted and rejected."""
        accepted = sum(
            (F.count_if(col(f"_ok{i}")) for i in range(len(self.config.fields))), F.lit(0)
        )
        total = F.count("*") * len(self.config.fields)
        return self.frame.agg(
            F.count("*").alias("periods_evaluated"),
            accepted.cast("bigint").alias("values_accepted"),
            (total - accepted).cast("bigint").alias("values_rejected"),
        ).select(
            F.lit(self.index).cast("bigint").alias("stage_index"),
            F.lit(self.stage.title).alias("label"),
            F.lit(self.stage.period.kind.value).alias("period_kind"),
            "*",
        )


@dataclass
class AveragingResult:
    stages: list[StageResult]
    notes: list[str] = dc_field(default_factory=list)

    @property
    def table(self) -> DataFrame:
        return self.stages[-1].table

    @property
    def completeness(self) -> DataFrame:
        frames = [s.completeness for s in self.stages]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    @property
    def report(self) -> DataFrame:
        out = self.stages[0].report
        for stage in self.stages[1:]:
            out = out.unionByName(stage.report)
        return out


def period_calendar(
    ranges: DataFrame,
    spec: Period,
    zone: str,
    keys: Sequence[str],
    *,
    max_periods: int | None = None,
    label: str | None = None,
) -> DataFrame:
    """Every period of each key between slots ``_lo`` and ``_hi``, populated or not.

    Periods of zero length (clock slots lost to a skipped hour) do not exist.
    """
    if max_periods is not None:
        guard = F.when(
            col("_hi") - col("_lo") >= max_periods,
            _fail(f"the range exceeds the {max_periods:,}-period limit", "bigint"),
        ).otherwise(col("_hi"))
        ranges = ranges.withColumn("_hi", guard)
    slots = explode_range(ranges, "_lo", "_hi", "_slot", keep=keys)
    periods = with_bounds(slots, spec, zone, label=label)
    return periods.where(col("_end") > col("_start")) if _may_vanish(spec, zone) else periods


def _may_vanish(spec: Period, zone: str) -> bool:
    """Only clock-shaped periods of a zone with transitions can lose their whole length."""
    return spec.kind in CLOCKED and fixed_offset_micros(canonical_zone(zone)) is None


def fill_periods(
    grouped: DataFrame, spec: Period, zone: str, keys: Sequence[str],
    max_periods: int | None = None,
) -> DataFrame:
    """Add the unpopulated periods between each key's first and last populated one.

    Works on grouped rows only (one per key and period): each row is repeated up to the next
    populated slot, so the source is scanned once and nothing is joined back. Slots are cut into
    chunks; the next slot comes from a window over the chunk, and for the last row of a chunk
    from a window over the first and last rows of all chunks of the key. A long gap is cut into
    blocks, so no array grows with it.
    """
    measures = [c for c in grouped.columns if c not in keys and c != "_slot"]
    rows = grouped.withColumn("__chunk", floor_div(col("_slot"), SLOTS_PER_BLOCK))
    inside = Window.partitionBy(*cols(keys), col("__chunk")).orderBy("_slot")
    rows = rows.select(
        "*", F.lead("_slot").over(inside).alias("__near"),
        F.lag("_slot").over(inside).isNull().alias("__opens"),
    )
    closes = col("__near").isNull()
    edge = col("__opens") | closes
    rows = rows.withColumn("__place", F.when(~edge, col("__chunk")))
    edges = Window.partitionBy(*cols(keys), col("__place"))
    following = F.when(closes, F.lead("_slot").over(edges.orderBy("_slot"))).otherwise(col("__near"))
    last = F.coalesce(following - 1, col("_slot"))
    if max_periods is not None:
        span = F.max("_slot").over(edges) - F.min("_slot").over(edges)
        limit = _fail(f"the range exceeds the {max_periods:,}-period limit", "bigint")
        last = F.when(edge & (span >= max_periods), limit).otherwise(last)
    part = F.sequence(big(0), floor_div(col("__last") - col("_slot"), SLOTS_PER_BLOCK))
    rows = rows.select(*cols(keys), "_slot", *cols(measures), last.alias("__last")).select(
        "*", F.explode(part).alias("__part")
    )
    low = col("_slot") + col("__part") * SLOTS_PER_BLOCK
    high = F.least(col("__last"), low + SLOTS_PER_BLOCK - 1)
    rows = rows.select("*", F.explode(F.sequence(low, high)).alias("__at"))
    here = col("__at") == col("_slot")
    filled = rows.select(
        *cols(keys), col("__at").alias("_slot"), *[F.when(here, col(m)).alias(m) for m in measures]
    )
    frame = with_bounds(filled, spec, zone)
    return frame.where(col("_end") > col("_start")) if _may_vanish(spec, zone) else frame


def _accept(frame: DataFrame, config: AveragingConfig, stage: Stage) -> DataFrame:
    rule = stage.completeness
    extra: list[Column] = []
    shown = {}
    for i, f in enumerate(config.fields):
        enough = col(f"_n{i}") / col("_expected") >= rule.threshold
        two = F.lit(False)
        if rule.allow_two_of_three:
            two = (col("_expected") == 3) & (col(f"_n{i}") >= 2) & ~enough
        extra += [(enough | two).alias(f"_ok{i}"), two.alias(f"_two{i}")]
        shown[f"_v{i}"] = F.when(enough | two, col(f"_v{i}")).alias(f.output)
    kept = [c for c in frame.columns if c not in shown]
    return frame.select(*cols(kept), *extra, *shown.values())


def same_keys(keys: Sequence[str], left: str, right: str, slot: bool = True) -> list[Column]:
    pairs = [F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`")) for k in keys]
    if slot:
        pairs.append(F.col(f"{left}._slot").eqNullSafe(F.col(f"{right}._slot")))
    return pairs


# Share of the values on either side of the middle that the bounds of a median leave in.
MEDIAN_MARGIN, MEDIAN_ACCURACY = 0.002, 10_000


def exact_median(df: DataFrame, keys: Sequence[str], value: str, output: str) -> DataFrame:
    """Exact group medians by rank selection, one way for groups of all sizes.

    A mergeable quantile summary of fixed size bounds the middle of each group by rank, whatever
    the values are. Values below the bounds are only counted. The few between them (about 0.4 %
    of a large group, equal values counted once) are ranked one by one.
    """
    number = col(value).cast("double")
    rows = df.where(col(value).isNotNull()).select(*cols(keys), number.alias("__v"))
    middle = F.array(F.lit(0.5 - MEDIAN_MARGIN), F.lit(0.5 + MEDIAN_MARGIN))
    bounds = rows.groupBy(*cols(keys)).agg(
        F.percentile_approx("__v", middle, F.lit(MEDIAN_ACCURACY)).alias("__m"),
        F.count(F.lit(1)).alias("__n"),
    ).select(
        *[col(k).alias(f"__e{i}") for i, k in enumerate(keys)],
        F.col("__m")[0].alias("__lo"), F.col("__m")[1].alias("__hi"), "__n",
    )
    same = [col(k).eqNullSafe(col(f"__e{i}")) for i, k in enumerate(keys)] or F.lit(True)
    counted = rows.groupBy(*cols(keys), "__v").agg(F.count(F.lit(1)).alias("__c"))
    below = col("__v") < col("__lo")
    near = counted.join(bounds, same).where(col("__v") <= col("__hi")).groupBy(
        *cols(keys), "__n", F.when(~below, col("__v")).alias("__v")
    ).agg(F.sum("__c").alias("__c"))  # all values below the bounds become one row
    run = Window.partitionBy(*cols(keys)).orderBy(F.asc_nulls_first("__v"))
    ranked = near.select("*", (F.sum("__c").over(run) - col("__c")).alias("__at"))
    low, high = F.expr("(__n - 1) div 2"), F.expr("__n div 2")
    holds = [(col("__at") <= r) & (r < col("__at") + col("__c")) for r in (low, high)]
    found = [F.max(F.when(h, col("__v"))) for h in holds]
    return ranked.groupBy(*cols(keys)).agg(((found[0] + found[1]) / 2).alias(output))


# Grid points that one mask column marks, and mask columns of one group.
MASK_POINTS, MASKS = 64, 8


def grid_points(spec: Period, zone: str, step: int) -> int:
    """No period of this kind holds more points of the input grid than this."""
    days = {
        PeriodKind.WEEK: 7,
        PeriodKind.CALENDAR_MONTH: 31,
        PeriodKind.QUARTER: 92,
    }
    if spec.kind in ANCHORED or spec.kind in CLOCKED:
        length = step_micros(spec)
    else:
        length = days.get(spec.kind, 366) * MICROS_PER_DAY
    if spec.kind not in ANCHORED and fixed_offset_micros(canonical_zone(zone)) is None:
        length += 2 * MICROS_PER_DAY  # no zone change makes a period longer by more
    return -(-length // step)


def grid_masks(at: Column, step: int, points: int) -> tuple[Column, list[Column]]:
    """(part, masks) of an instant in micros: which part of its period's grid it lies in, and one
    bit for its place there, in one of up to ``MASKS`` columns.

    Places are grid numbers modulo ``points``: instants of one phase inside one period never
    share a place unless they are equal. Masks merge by ``bit_or``; a group holds a repeated
    instant exactly if it has more rows than bits."""
    size = MASK_POINTS * MASKS
    place = F.pmod(floor_div(at, step), big(points))
    word = floor_div(place, MASK_POINTS)
    bit = F.call_function("shiftleft", big(1), F.pmod(place, big(MASK_POINTS)).cast("int"))
    words = min(MASKS, -(-points // MASK_POINTS))
    masks = [F.when(F.pmod(word, big(MASKS)) == j, bit) for j in range(words)]
    return floor_div(place, size), masks


def surplus(masks: Sequence[str]) -> Column:
    """Rows of a group beyond its distinct grid points."""
    bits = [F.coalesce(F.bit_count(F.bit_or(col(m))), F.lit(0)) for m in masks]
    return F.count(F.lit(1)) - sum(bits[1:], bits[0])


def parts(i: int, rule: FieldRule, value: Column, weight: Column | None) -> list[Column]:
    """Partial results of field ``i`` that ``merged`` puts together."""
    made = {"n": F.count(value)}
    which = rule.statistic
    if which is Statistic.MINIMUM:
        made["low"] = F.min(value)
    elif which is Statistic.MAXIMUM:
        made["high"] = F.max(value)
    elif which in ADDITIVE or which in MEANS:
        made["total"] = F.sum(value)
    elif which is Statistic.STANDARD_DEVIATION:
        number = value.cast("double")
        made["total"], made["spread"] = F.sum(number), F.var_pop(number) * F.count(value)
    elif which is Statistic.ENERGY_AVERAGE_LEQ:
        energy = F.pow(F.lit(10.0), value.cast("double") / 10.0)
        weights = F.lit(1.0) if weight is None else weight
        made["energy"] = F.sum(energy * weights)
        made["weight"] = F.sum(F.when(value.isNotNull(), weights))
    return [c.alias(f"_{name}{i}") for name, c in made.items()]


def merged_spread(i: int) -> Column:
    """Sum of squared distances from the common mean, merged part by part: differences of means
    keep their digits where squares of large values would lose them. A period has as many parts
    as its grid or its base windows, whatever the table's size."""
    part = F.struct(
        col(f"_n{i}").cast("double").alias("n"), (col(f"_total{i}") / col(f"_n{i}")).alias("mean"),
        col(f"_spread{i}").alias("spread"),
    )
    listed = F.sort_array(F.collect_list(F.when(col(f"_n{i}") > 0, part)))
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "mean", "spread")])

    def merge(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"),
            (a["spread"] + b["spread"] + apart * apart * a["n"] * b["n"] / n).alias("spread"),
        )

    return F.aggregate(listed, zero, merge)["spread"]


def merged(i: int, rule: FieldRule) -> Column:
    """The statistic ``_v{i}`` of merged parts; null where there are no values."""
    n, which = F.sum(f"_n{i}"), rule.statistic
    if which is Statistic.COUNT:
        value = n.cast("bigint")
    elif which is Statistic.MINIMUM:
        value = F.min(f"_low{i}").cast("double")
    elif which is Statistic.MAXIMUM:
        value = F.max(f"_high{i}").cast("double")
    elif which in ADDITIVE:
        value = F.sum(f"_total{i}").cast("double")
    elif which in MEANS:
        value = F.sum(f"_total{i}").cast("double") / n
    elif which is Statistic.STANDARD_DEVIATION:
        value = F.sqrt(merged_spread(i) / n)
    elif which is Statistic.MEDIAN:
        value = middle(F.sort_array(F.flatten(F.collect_list(f"_values{i}"))))
    else:
        energy = F.sum(f"_energy{i}")
        energy = F.when(
            energy == float("inf"), _fail("an energy average overflows", "double")
        ).otherwise(energy)
        value = F.lit(10.0) * F.log10(energy / F.sum(f"_weight{i}"))
    return F.when(n > 0, value).alias(f"_v{i}")


def refuse_repeats(grouped: DataFrame) -> DataFrame:
    """Raise for rows without a timestamp and for ``_surplus`` rows of periods on one phase;
    periods of several phases are off the grid, which the expected counts refuse."""
    one_phase = col("_phase_lo") == col("_phase_hi")
    clean = (
        F.when(col("_phase_lo").isNull(), _fail("a timestamp is missing", "boolean"))
        .when(one_phase & (col("_surplus") > 0), _fail("an instant is repeated", "boolean"))
        .otherwise(True)
    )
    return grouped.where(clean).drop("_surplus")


def _first_stage(df: DataFrame, config: AveragingConfig, strict: bool) -> StageResult:
    stage = config.stages[0]
    keys = list(config.keys)
    step = micros(config.interval)
    ts = col(config.timestamp)
    values, inputs = [], []
    for i, f in enumerate(config.fields):
        value = finite(col(f.column), dtype(df, f.column))
        weight = None
        if f.weight_column is not None:
            weight = duration_seconds(col(f.weight_column), dtype(df, f.weight_column))
            values.append(F.when(value.isNotNull(), weight).alias(f"_w{i}"))
            value = F.when(col(f.weight_column).isNotNull(), value)
            weight = col(f"_w{i}")
        values.append(value.alias(f"_x{i}"))
        inputs.append((i, f, col(f"_x{i}"), weight))
    at = F.unix_micros(ts)
    points = grid_points(stage.period, config.zone, step)
    # Without repeats a group has no more values than its grid; larger ones are ranked by bounds.
    medians = [i for i, f, _, _ in inputs if f.statistic is Statistic.MEDIAN]
    selected = [] if strict and points <= MEDIAN_POINTS else medians
    part, masks = grid_masks(at, step, points)
    names = [f"_mask{j}" for j in range(len(masks))]
    split = strict and points > MASK_POINTS * MASKS
    marks = [m.alias(n) for m, n in zip(masks, names)] if strict else []
    rows = df.select(
        *cols(keys), slot_of(stage.period, ts, config.zone).alias("_slot"),
        F.pmod(at, big(step)).alias("_phase"), *([part.alias("_part")] if split else []), *marks,
        *values,
    )
    # Rows without a timestamp group under a null slot. They are met by an aggregate of theirs: a
    # filter on the slot would be pushed to the rows and work every timestamp out twice.
    phases = [F.min("_phase").alias("_phase_lo"), F.max("_phase").alias("_phase_hi")]
    extra = [surplus(names).alias("_surplus")] if strict else []
    if split:
        # A long period is folded part by part of its grid, then its parts are merged.
        partial = rows.groupBy(*cols(keys), "_slot", "_part").agg(
            *[p for row in inputs for p in parts(*row)], *phases, *extra,
            *([] if selected else [
                F.sort_array(F.collect_list(col(f"_x{i}").cast("double"))).alias(f"_values{i}")
                for i in medians]))
        whole = [
            c for i, f, _, _ in inputs
            for c in (F.sum(f"_n{i}").alias(f"_n{i}"), *([] if i in selected else [merged(i, f)]))
        ]
        if selected:  # a table of its own: a summary of values cannot be made from parts
            bounds = rows.groupBy(*cols(keys), "_slot").agg(*[median_bounds(i) for i in selected])
        grouped = partial.groupBy(*cols(keys), "_slot").agg(
            *whole, F.min("_phase_lo").alias("_phase_lo"), F.max("_phase_hi").alias("_phase_hi"),
            F.sum("_surplus").alias("_surplus"))
        if selected:
            grouped = grouped.alias("g").join(bounds.alias("m"), same_keys(keys, "g", "m"), "left").select(
                "g.*", *[f"m._m{i}" for i in selected])
    else:
        whole = [
            c for i, f, x, w in inputs
            for c in (F.count(x).alias(f"_n{i}"), median_bounds(i) if i in selected
                      else statistic(x, f.statistic, w).alias(f"_v{i}"))
        ]
        grouped = rows.groupBy(*cols(keys), "_slot").agg(*whole, *phases, *extra)
    if strict:
        grouped = refuse_repeats(grouped)
        if "_ord" in df.columns and not config.allow_reorder:
            grouped = refused_if_any(grouped, disorder(df, config), "disorder")
    else:
        grouped = grouped.where(col("_phase_lo").isNotNull())
    return finish_first_stage(with_medians(grouped, rows, keys, selected), config)


# A group of at most so many grid points is small enough to hold its values for an exact median.
MEDIAN_POINTS = 100_000


def middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    low, high = (F.get(values, F.call_function("div", m, F.lit(2)).cast("int")) for m in (n - 1, n))
    return (low + high) / 2


def median_bounds(i: int) -> Column:
    """``_m{i}``: values that bound the middle of field ``i`` in a group by rank."""
    shares = F.array(F.lit(0.5 - MEDIAN_MARGIN), F.lit(0.5 + MEDIAN_MARGIN))
    number = col(f"_x{i}").cast("double")
    return F.percentile_approx(number, shares, F.lit(MEDIAN_ACCURACY)).alias(f"_m{i}")


def with_medians(
    grouped: DataFrame, rows: DataFrame, keys: Sequence[str], fields: Sequence[int]
) -> DataFrame:
    """Append the exact medians ``_v{i}`` of all ``fields`` to groups of any size.

    ``grouped`` holds ``_n{i}`` and ``_m{i}``, found in its own aggregate. One pass over the values
    of all fields counts what lies below the bounds and ranks what lies between them, about 0.4 %
    of a large group; a group's other columns travel along as one value."""
    if not fields:
        return grouped
    names = [c for c in grouped.columns if c not in {*keys, "_slot", *[f"_m{i}" for i in fields]}]
    on = [*cols(keys), "_slot", "_field"]
    bounds = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_field"), col(f"_n{i}").alias("n"), col(f"_m{i}")[0].alias("lo"),
                 col(f"_m{i}")[1].alias("hi")) for i in fields])).alias("_b")
    groups = grouped.select(
        *cols(keys), "_slot", F.struct(*cols(names)).alias("_g"), bounds
    ).select(
        *[col(k).alias(f"_e{j}") for j, k in enumerate(keys)], F.col("_slot").alias("_eslot"),
        F.col("_b._field").alias("_efield"), "_g", "_b")
    value = F.explode(F.array(*[
        F.struct(F.lit(i).alias("_field"), col(f"_x{i}").cast("double").alias("v")) for i in fields]))
    counted = rows.select(*cols(keys), "_slot", value.alias("_f")).where("_f.v IS NOT NULL").select(
        *cols(keys), "_slot", "_f._field", F.col("_f.v").alias("_v")
    ).groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_c"))
    same = [col(k).eqNullSafe(col(f"_e{j}")) for j, k in enumerate(keys)]
    same += [col("_slot").eqNullSafe(col("_eslot")), col("_field") == col("_efield")]
    near = groups.join(counted, [*same, col("_v") <= F.col("_b.hi")], "left").select(
        *[col(f"_e{j}").alias(k) for j, k in enumerate(keys)], F.col("_eslot").alias("_slot"),
        F.col("_efield").alias("_field"), "_g", F.col("_b.n").alias("_n"),
        F.when(col("_v") >= F.col("_b.lo"), col("_v")).alias("_v"), "_c",
    ).groupBy(*on, "_g", "_n", "_v").agg(F.sum("_c").alias("_c"))
    run = Window.partitionBy(*on).orderBy(F.asc_nulls_first("_v"))
    ranked = near.select("*", (F.sum("_c").over(run) - col("_c")).alias("_at"))
    picked = [
        F.max(F.when((col("_at") <= F.expr(r)) & (F.expr(r) < col("_at") + col("_c")), col("_v")))
        for r in ("(_n - 1) div 2", "_n div 2")]
    medians = ranked.groupBy(*on, "_g").agg(((picked[0] + picked[1]) / 2).alias("_v"))
    return medians.groupBy(*cols(keys), "_slot", "_g").agg(
        *[F.max(F.when(col("_field") == i, col("_v"))).alias(f"_v{i}") for i in fields]
    ).select(*cols(keys), "_slot", "_g.*", *[f"_v{i}" for i in fields])


def finish_first_stage(grouped: DataFrame, config: AveragingConfig) -> StageResult:
    """Stage 1 from grouped rows ``keys, _slot, _n{i}, _v{i}, _phase_lo, _phase_hi``: empty
    periods, expected counts, completeness."""
    stage = config.stages[0]
    keys = list(config.keys)
    step = micros(config.interval)
    frame = fill_periods(grouped, stage.period, config.zone, keys, config.max_periods)
    elapsed = F.unix_micros(col("_end")) - F.unix_micros(col("_start"))
    start_phase = F.pmod(F.unix_micros(col("_start")), big(step))
    expected = (
        F.when(
            elapsed % step != 0,
            _fail("a reporting period is not a whole number of input intervals", "bigint"),
        )
        .when(
            (col("_phase_lo") != start_phase) | (col("_phase_hi") != start_phase),
            _fail("timestamps are off the confirmed input grid", "bigint"),
        )
        .otherwise(F.call_function("div", elapsed, big(step)))
    )
    fills = [F.coalesce(col(f"_n{i}"), F.lit(0)).alias(f"_n{i}") for i in range(len(config.fields))]
    frame = frame.select(
        *cols(keys), "_slot", "_start", "_end", expected.alias("_expected"), *fills,
        *[
            col(f"_v{i}")
            for i in range(len(config.fields))
        ],
    )
    return StageResult(1, stage, config, _accept(frame, config, stage))


def with_tiling(df: DataFrame, component: Period, zone: str) -> DataFrame:
    """Append ``_expected``: the number of component periods that exactly tile the period
    ``[_start, _end)``. Raises where components do not meet the period's edges."""
    low = slot_of(component, col("_start"), zone)
    high = slot_of(component, col("_end"), zone)
    spans = df.select("*", low.alias("__lo"), high.alias("__hi"))
    starts = F.unix_micros(col("_start")), F.unix_micros(col("_end"))
    if component.kind in ANCHORED:
        step = step_micros(component)
        origin = big(anchor_micros(component.anchor, canonical_zone(zone)))
        edges = [origin + col(c) * big(step) for c in ("__lo", "__hi")]
        count = col("__hi") - col("__lo")
    else:
        zone = canonical_zone(zone)

        def edge(slot: Column) -> Column:
            return edge_micros(slot_wall(component, slot), zone)

        edges = [edge(col("__lo")), edge(col("__hi"))]
        count = col("__hi") - col("__lo")
        if _may_vanish(component, zone):
            real = F.filter(
                F.sequence(col("__lo"), col("__hi") - 1), lambda s: edge(s + 1) > edge(s)
            )
            count = F.when(col("__hi") > col("__lo"), F.size(real).cast("bigint"))
    meets = (edges[0] == starts[0]) & (edges[1] == starts[1]) & (count > 0)
    expected = F.when(meets, count).otherwise(
        _fail("component periods do not tile the target period", "bigint")
    )
    return spans.select(*cols(df.columns), expected.alias("_expected"))


def next_stage(previous: StageResult, stage: Stage) -> StageResult:
    config = previous.config
    keys = list(config.keys)
    weight = (F.unix_micros(col("_end")) - F.unix_micros(col("_start"))) / 1_000_000
    rows = previous.frame.select(
        *cols(keys),
        slot_of(stage.period, col("_start"), config.zone).alias("_slot"),
        weight.alias("_w"),
        *[col(f.output).alias(f"_x{i}") for i, f in enumerate(config.fields)],
    )
    component = previous.stage.period
    shortest = step_micros(component) if component.kind in (*ANCHORED, *CLOCKED) else MICROS_PER_DAY
    many = grid_points(stage.period, config.zone, shortest) > MEDIAN_POINTS
    aggregates, selected = [], []
    for i, f in enumerate(config.fields):
        value = col(f"_x{i}")
        w = F.when(value.isNotNull(), col("_w"))
        aggregates.append(F.count(value).alias(f"_n{i}"))
        if many and f.statistic is Statistic.MEDIAN:
            selected.append(i)
            aggregates.append(median_bounds(i))
        else:
            aggregates.append(statistic(value, f.statistic, w).alias(f"_v{i}"))
    grouped = with_medians(rows.groupBy(*cols(keys), "_slot").agg(*aggregates), rows, keys, selected)
    # The calendar of the previous stage has no holes, so every target period is populated.
    frame = with_bounds(grouped, stage.period, config.zone)
    frame = with_tiling(frame, previous.stage.period, config.zone)
    frame = frame.select(
        *cols(keys), "_slot", "_start", "_end", "_expected",
        *[c for i in range(len(config.fields)) for c in (f"_n{i}", f"_v{i}")],
    )
    return StageResult(previous.index + 1, stage, config, _accept(frame, config, stage))


def average(df: DataFrame, config: AveragingConfig, *, strict: bool = True) -> AveragingResult:
    """Average a keyed series whose timestamp is an instant (TIMESTAMP).

    Missing and repeated timestamps are refused by the first stage's own aggregate, when the
    result is worked out. Disorder along an ``_ord`` column, unless reordering is allowed, is
    refused by a subquery over (keys, timestamp). ``strict=False`` leaves these checks out
    for data that is known to be clean: rows without a timestamp are then left out and repeated
    instants count as often as they come.
    """
    require(df, config.timestamp, *config.keys, *[f.column for f in config.fields])
    require(df, *[f.weight_column for f in config.fields if f.weight_column])
    if not isinstance(dtype(df, config.timestamp), T.TimestampType):
        raise ValueError("averaging needs an instant; give wall-clock timestamps a zone first")
    stages = [_first_stage(df, config, strict)]
    for stage in config.stages[1:]:
        stages.append(next_stage(stages[-1], stage))
    return AveragingResult(stages)


def series_violations(
    df: DataFrame, config: AveragingConfig, *, order: str = "_ord", grid: bool = True
) -> DataFrame:
    """Rows ``kind, keys, ts, n_rows``: every reason an averaging input would be refused."""
    keys = list(config.keys)
    ts = col(config.timestamp)
    named = [*cols(keys)]
    rows = df.select(*named, ts.alias("ts"), *([col(order)] if order in df.columns else []))
    invalid = rows.where(col("ts").isNull()).groupBy(*named).agg(
        F.count("*").alias("n_rows")
    ).where("n_rows > 0").select(
        F.lit("invalid").alias("kind"), *named, F.lit(None).cast("timestamp").alias("ts"), "n_rows"
    )
    valid = rows.where(col("ts").isNotNull())
    found = invalid.unionByName(
        valid.groupBy(*named, "ts").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(
            F.lit("duplicate").alias("kind"), *named, "ts", "n_rows"
        )
    )
    if order in df.columns and not config.allow_reorder:
        found = found.unionByName(disorder(df, config, order=order))
    if grid:
        found = found.unionByName(off_grid_rows(df, config))
    return found


def disorder(df: DataFrame, config: AveragingConfig, *, order: str = "_ord") -> DataFrame:
    """Rows earlier than the row before them in source order, as violations."""
    named, ts = cols(config.keys), col(config.timestamp)
    rows = df.where(ts.isNotNull()).select(*named, ts.alias("ts"), col(order))
    pairs = successive_pairs(rows, list(config.keys), order, ["ts"])
    return pairs.where(F.col("next.ts") < F.col("prev.ts")).select(
        F.lit("disorder").alias("kind"), *named, F.col("next.ts").alias("ts"),
        F.lit(1).cast("bigint").alias("n_rows"),
    )


def off_grid_rows(df: DataFrame, config: AveragingConfig) -> DataFrame:
    """Instants not a whole number of intervals after their period's start."""
    keys = list(config.keys)
    step = big(micros(config.interval))
    spec = config.stages[0].period
    ts = col(config.timestamp)
    rows = df.where(ts.isNotNull()).select(
        *cols(keys), ts.alias("ts"), slot_of(spec, ts, config.zone).alias("_slot"),
        F.pmod(F.unix_micros(ts), step).alias("_phase"),
    )
    # Only (slot, phase) pairs meet the period edges: a handful per period on clean data.
    pairs = rows.select("_slot", "_phase").distinct()
    bad = with_bounds(pairs, spec, config.zone).where(
        col("_phase") != F.pmod(F.unix_micros(col("_start")), step)
    ).select("_slot", "_phase")
    return rows.join(bad, ["_slot", "_phase"], "left_semi").groupBy(*cols(keys), "ts").agg(
        F.count("*").alias("n_rows")
    ).select(F.lit("off_grid").alias("kind"), *cols(keys), "ts", "n_rows")


def require_clean(violations: DataFrame) -> None:
    """Raise with counts per kind when a violations frame is not empty."""
    found = violations.groupBy("kind").agg(F.count("*").alias("n")).collect()
    if found:
        raise DataViolation(
            "; ".join(f"{row['kind']}: {row['n']}" for row in sorted(found, key=lambda r: r["kind"]))
        )
