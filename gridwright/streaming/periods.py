"""Period averaging over a stream.

The stream folds observations into mergeable partial results per (keys, base window). Base
windows have a fixed length that divides every period edge (15 minutes suits all time zones),
so they carry the event-time watermark and their state is dropped once it passes. Partial
results are appended per micro-batch; the newest version of each window wins, which makes
retries harmless. Calendar periods, completeness and later stages are then an ordinary batch
aggregation over the small partial table.

A partial result marks the grid points that it has seen, bit by bit, so a repeated instant is
refused when the averages are worked out, as in a batch, however far apart its readings arrive.
For a median it keeps the window's values, which the grid of a window bounds.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from gridwright.config import MICROS_PER_DAY, AveragingConfig, Statistic, micros
from gridwright.functions.names import col, cols, dtype, require
from gridwright.functions.periods import (
    ANCHORED,
    CLOCKED,
    big,
    slot_of,
    step_micros,
    with_bounds,
)
from gridwright.functions.zones import anchor_micros, canonical_zone, fixed_offset_micros
from gridwright.operators.averaging import (
    AveragingResult,
    duration_seconds,
    finish_first_stage,
    finite,
    grid_masks,
    merged,
    next_stage,
    parts,
    refuse_repeats,
    same_keys,
    surplus,
)

def check_base(config: AveragingConfig, base: timedelta) -> None:
    """Refuse base windows that hold a broken interval or straddle a period's edge."""
    length, step = micros(base), micros(config.interval)
    if length <= 0 or length % step:
        raise ValueError("base windows must be a whole number of input intervals")
    spec, zone = config.stages[0].period, canonical_zone(config.zone)
    if spec.kind in ANCHORED:
        places = [step_micros(spec), anchor_micros(spec.anchor, zone)]
    else:
        whole = step_micros(spec) if spec.kind in CLOCKED else MICROS_PER_DAY
        places = [whole, *(spec.day_start_micros - o for o in zone_offsets(zone))]
    if any(p % length for p in places):
        raise ValueError("base windows must divide every edge of the first stage's periods")


def zone_offsets(zone: str) -> set[int]:
    """All UTC offsets (micros) that a zone has had or will have between 1970 and 2100."""
    fixed = fixed_offset_micros(zone)
    if fixed is not None:
        return {fixed}
    rules = ZoneInfo(zone)
    start = datetime(1970, 1, 1, tzinfo=UTC)
    days = (start + timedelta(days=d) for d in range(130 * 366))
    return {micros(d.astimezone(rules).utcoffset()) for d in days}


def partial_windows(
    stream: DataFrame, config: AveragingConfig, *, base: timedelta, delay: str
) -> DataFrame:
    """Streaming partial results per (keys, base window, part of its grid)."""
    check_base(config, base)
    keys = list(config.keys)
    require(stream, config.timestamp, *keys, *[f.column for f in config.fields])
    step = micros(config.interval)
    values, partial = [], []
    for i, f in enumerate(config.fields):
        value = finite(col(f.column), dtype(stream, f.column)).cast("double")
        weight = F.lit(1.0)
        if f.weight_column:
            weight = duration_seconds(col(f.weight_column), dtype(stream, f.weight_column))
            value = F.when(col(f.weight_column).isNotNull(), value)
        values += [value.alias(f"_x{i}"), weight.alias(f"_w{i}")]
        partial += parts(i, f, col(f"_x{i}"), col(f"_w{i}"))
        if f.statistic is Statistic.MEDIAN:
            partial.append(F.sort_array(F.collect_list(col(f"_x{i}"))).alias(f"_values{i}"))
    at = F.unix_micros(col(config.timestamp))
    part, masks = grid_masks(at, step, micros(base) // step)
    names = [f"_mask{j}" for j in range(len(masks))]
    rows = stream.select(
        *cols(keys), col(config.timestamp).alias("_ts"), part.alias("_part"),
        F.pmod(at, big(step)).alias("_phase"), *[m.alias(n) for m, n in zip(masks, names)], *values,
    ).withWatermark("_ts", delay)
    window = F.window("_ts", f"{micros(base)} microseconds")
    return rows.groupBy(*cols(keys), window.alias("_window"), "_part").agg(
        *partial, F.min("_phase").alias("_phase_lo"), F.max("_phase").alias("_phase_hi"),
        surplus(names).alias("_surplus"),
    ).select(F.col("_window.start").alias("_at"), "*").drop("_window")


#: Days of windows in one folder of a micro-batch.
SPAN_DAYS = 32


def span_of(instant: Column) -> Column:
    return F.floor(F.unix_micros(instant) / (SPAN_DAYS * MICROS_PER_DAY)).cast("bigint")


def start_partials(
    partials: DataFrame, path: str, checkpoint: str, **trigger: object
) -> StreamingQuery:
    """Run the stream; each micro-batch overwrites its own folder, so a retried batch leaves
    one copy. Windows of ``SPAN_DAYS`` lie together, so that a refresh reads only some of them."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_span", span_of(F.col("_at"))).write.mode("overwrite").partitionBy(
            "_span").parquet(f"{path}/batch_id={batch_id}")

    return (
        partials.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(save)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def latest_partials(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The newest version of each base window."""
    return newest_partials(spark.read.parquet(path), keys)


def newest_partials(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    rest = [n for n in df.columns if n not in {*keys, "_at", "_part", "batch_id", "_span"}]
    best = F.max_by(F.struct(*cols(rest)), col("batch_id")).alias("p")
    return df.groupBy(*cols(keys), "_at", "_part").agg(best).select(
        *cols(keys), "_at", "_part", "p.*")


def compact_partials(
    spark: SparkSession, path: str, target: str, keys: tuple[str, ...]
) -> DataFrame:
    """Keep the newest version of each window only, in a folder of its own; batch numbers stay, so
    later batches of the stream can be written there as well."""
    df = spark.read.parquet(path)
    newest = F.max("batch_id").over(Window.partitionBy(*cols(keys), col("_at"), col("_part")))
    df.withColumn("__newest", newest).where("batch_id = __newest").drop("__newest").write.mode(
        "overwrite").partitionBy("batch_id").parquet(target)
    return latest_partials(spark, target, keys)


def grouped_partials(partials: DataFrame, config: AveragingConfig) -> DataFrame:
    """The rows of the first stage's own aggregate from partial windows."""
    keys = list(config.keys)
    slot = slot_of(config.stages[0].period, col("_at"), config.zone)
    rows = partials.withColumn("_slot", slot)
    aggregates = [
        c for i, f in enumerate(config.fields)
        for c in (F.sum(f"_n{i}").alias(f"_n{i}"), merged(i, f))
    ]
    return refuse_repeats(rows.groupBy(*cols(keys), "_slot").agg(
        *aggregates, F.min("_phase_lo").alias("_phase_lo"), F.max("_phase_hi").alias("_phase_hi"),
        F.sum("_surplus").alias("_surplus"),
    ))


def average_grouped(grouped: DataFrame, config: AveragingConfig) -> AveragingResult:
    """All stages from the first stage's grouped rows."""
    stages = [finish_first_stage(grouped, config)]
    for stage in config.stages[1:]:
        stages.append(next_stage(stages[-1], stage))
    return AveragingResult(stages)


def average_partials(partials: DataFrame, config: AveragingConfig) -> AveragingResult:
    """All stages from merged partial windows."""
    return average_grouped(grouped_partials(partials, config), config)


def dirty_periods(spark: SparkSession, path: str, config: AveragingConfig, since: int) -> DataFrame:
    """``keys, _slot`` of the first stage's periods with windows in batches after ``since``."""
    slot = slot_of(config.stages[0].period, col("_at"), config.zone)
    new = spark.read.parquet(path).where(F.col("batch_id") > since)
    return new.select(*cols(config.keys), slot.alias("_slot")).distinct()


def dirty_windows(spark: SparkSession, path: str, config: AveragingConfig, since: int) -> DataFrame:
    """The newest windows of the dirty periods; other spans of time are not read."""
    keys, spec = list(config.keys), config.stages[0].period
    dirty = dirty_periods(spark, path, config, since)
    low, high = (span_of(col(c)) for c in ("_start", "_end"))
    spans = with_bounds(dirty.select("_slot").distinct(), spec, config.zone).select(
        F.explode(F.sequence(low, high)).alias("_span")).distinct()
    near = spark.read.parquet(path).join(spans, "_span", "left_semi")
    rows = newest_partials(near, config.keys).withColumn("_slot", slot_of(spec, col("_at"), config.zone))
    return rows.alias("g").join(dirty.alias("m"), same_keys(keys, "g", "m"), "left_semi").drop("_slot")


def refreshed(
    spark: SparkSession, path: str, config: AveragingConfig, state: DataFrame | None, since: int
) -> DataFrame:
    """The first stage's grouped rows after new batches: those of dirty periods worked out again
    from their windows, the others taken from ``state``, the rows of batches up to ``since``.

    The caller stores the result; it holds one row per period, from which ``average_grouped``
    makes all stages."""
    fresh = grouped_partials(dirty_windows(spark, path, config, since), config)
    if state is None:
        return fresh
    dirty = dirty_periods(spark, path, config, since)
    kept = state.alias("g").join(dirty.alias("m"), same_keys(config.keys, "g", "m"), "left_anti")
    return kept.unionByName(fresh)
