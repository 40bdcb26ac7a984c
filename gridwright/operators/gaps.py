"""Gap analysis and reconstruction on a confirmed interval grid.

Instants are compared as BIGINT micros, stepped in elapsed time and anchored at each series'
first instant. One pass folds a series into *blocks*: per (keys, phase, block of 4,096 slots)
the set of occupied slots. Phase is the remainder by the interval, so off-grid instants stay
apart without knowing the grid first, and copies of an instant collapse before the shuffle.
Everything else (grid, missing slots, spans, checks, report) is worked out from block rows;
observed rows are never shuffled to find or fill gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gridwright.errors import DataViolation
from gridwright.config import Derivation, GapBehavior, GapConfig, GapField, micros
from gridwright.functions import zones
from gridwright.functions.names import col, cols, dtype, is_instant, is_wall, require
from gridwright.functions.periods import big, explode_range, floor_div
from gridwright.operators.diagnostics import Diagnostics, watch
from gridwright.operators.ordering import (
    CHUNK_ROWS,
    join_members,
    refused_if_any,
    successive_pairs,
    with_single_row,
)

# Names of the common sampling intervals, in seconds.
INTERVAL_NAMES = {
    60: "1 minute",
    300: "5 minutes",
    900: "15 minutes",
    3600: "1 hour",
}


def _micros(df: DataFrame, name: str) -> Column:
    kind = dtype(df, name)
    if not (is_instant(kind) or is_wall(kind)):
        raise ValueError(f"column {name!r} does not hold datetimes")
    return F.unix_micros(col(name).cast("timestamp"))


def _as_type(at: Column, kind: T.DataType) -> Column:
    moment = F.timestamp_micros(at)
    return moment if is_instant(kind) else moment.cast("timestamp_ntz")


def _instants(df: DataFrame, keys: Sequence[str], timestamp: str) -> DataFrame:
    """Distinct (keys, __t); copies collapse before the shuffle."""
    return (
        df.where(col(timestamp).isNotNull())
        .select(*cols(keys), _micros(df, timestamp).alias("__t"))
        .distinct()
    )


def suggest_interval(
    df: DataFrame, timestamp: str, keys: Sequence[str] = ()
) -> DataFrame:
    """Most frequent step between distinct instants per series, ties to the smallest.

    Rows ``keys, interval_seconds, matching_steps, total_steps, confidence, label``.
    """
    pairs = successive_pairs(_instants(df, keys, timestamp), keys, "__t", ["__t"])
    steps = pairs.groupBy(
        *cols(keys), (F.col("next.__t") - F.col("prev.__t")).alias("__d")
    ).agg(F.count("*").alias("__n"))
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__d").alias("d")))
    seconds = (F.col("best.d") / 1_000_000).cast("double")
    label = F.lit("Custom")
    for value, name in INTERVAL_NAMES.items():
        label = F.when(seconds == value, name).otherwise(label)
    return steps.groupBy(*cols(keys)).agg(best.alias("best"), F.sum("__n").alias("total")).select(
        *cols(keys),
        seconds.alias("interval_seconds"),
        (-F.col("best.n")).alias("matching_steps"),
        F.col("total").alias("total_steps"),
        (-F.col("best.n") / F.col("total")).alias("confidence"),
        label.alias("label"),
    ).where(F.col("total_steps").isNotNull())


BLOCK_SLOTS = 4096

# Blocks of a series that one task looks at together.
CHUNK_BLOCKS = 4096


def _blocks(df: DataFrame, config: GapConfig, carried: Sequence[str] = ()) -> DataFrame:
    """``keys, __phase, __block, __rows, __head, __tail, __size, __inner`` in one pass, with
    per-series facts ``__first, __last, __end`` and the next block's head ``__next``.

    ``__inner`` lists the gaps inside the block as (a, z) instants. Rows without a timestamp
    form a block of null phase. The smallest and largest value of the ``i``-th ``carried`` column
    in the series come along as ``__lo{i}`` and ``__hi{i}``.
    """
    keys, step = list(config.keys), micros(config.interval)
    width = big(step * BLOCK_SLOTS)
    rows = df.select(
        *cols(keys), _micros(df, config.timestamp).alias("__t"),
        *[col(c).alias(f"__c{i}") for i, c in enumerate(carried)],
    ).select(
        *cols(keys), "__t", F.pmod("__t", big(step)).alias("__phase"),
        floor_div(col("__t"), step * BLOCK_SLOTS).alias("__block"),
        *[f"__c{i}" for i in range(len(carried))],
    )
    bounds = [f"{n}{i}" for i in range(len(carried)) for n in ("__lo", "__hi")]
    extremes = [
        f(f"__c{i}").alias(f"{n}{i}")
        for i in range(len(carried)) for n, f in (("__lo", F.min), ("__hi", F.max))
    ]
    slot = F.call_function("div", col("__t") - col("__phase") - col("__block") * width, big(step))
    blocks = rows.groupBy(*cols(keys), "__phase", "__block").agg(
        F.count("*").alias("__rows"), F.sort_array(F.collect_set(slot)).alias("__slots"), *extremes
    )
    origin = col("__block") * width + col("__phase")

    def instant(place: Column) -> Column:
        return origin + place * big(step)

    n = F.size("__slots")
    # Neighbours as two shifted slices; a block without slots has none.
    size = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice("__slots", F.lit(1), size), F.slice("__slots", F.lit(2), size),
        lambda a, z: F.struct(instant(a).alias("a"), instant(z).alias("z")),
    )
    blocks = blocks.select(
        *cols(keys), "__phase", "__block", "__rows",
        instant(F.try_element_at("__slots", F.lit(1))).alias("__head"),
        instant(F.try_element_at("__slots", F.lit(-1))).alias("__tail"),
        n.cast("bigint").alias("__size"),
        F.filter(pairs, lambda p: p["z"] - p["a"] > step).alias("__inner"), *bounds,
    )
    # A series is cut into chunks of blocks. Neighbours inside a chunk come from a window over the
    # chunk; only the first and last block of each chunk, which also bound the series, meet in a
    # window over the series.
    blocks = blocks.withColumn("__chunk", floor_div(col("__block"), CHUNK_BLOCKS))
    chunk = Window.partitionBy(*cols(keys), col("__phase"), col("__chunk"))
    inside = chunk.orderBy("__block")
    blocks = blocks.select(
        "*", F.lead("__head").over(inside).alias("__near"),
        F.lag("__block").over(inside).isNull().alias("__opens"),
        F.lead("__block").over(inside).isNull().alias("__closes"),
    )
    edge = col("__opens") | col("__closes")
    place = F.when(~edge, F.struct("__phase", "__chunk"))
    series = Window.partitionBy(*cols(keys), col("__place"))
    ahead = F.lead(F.struct("__phase", "__head")).over(series.orderBy("__phase", "__block"))
    if bounds:  # of the chunk first, then of the series by way of the edges, then for all blocks
        blocks = blocks.withColumns({b: _extreme(b).over(chunk) for b in bounds})
    blocks = blocks.withColumn("__place", place).select(
        "*", F.when(edge, F.min("__head").over(series)).alias("__edge_first"),
        F.when(edge, F.max("__tail").over(series)).alias("__edge_last"), ahead.alias("__ahead"),
        *[F.when(edge, _extreme(b).over(series)).alias(f"__edge{b}") for b in bounds],
    )
    following = F.when(
        col("__closes"), F.when(F.col("__ahead.__phase") == col("__phase"), F.col("__ahead.__head"))
    ).otherwise(col("__near"))
    blocks = blocks.select(
        *cols(keys), "__phase", "__block", "__rows", "__head", "__tail", "__size", "__inner",
        F.max("__edge_first").over(chunk).alias("__first"),
        F.max("__edge_last").over(chunk).alias("__last"), following.alias("__next"),
        *[F.max(f"__edge{b}").over(chunk).alias(b) for b in bounds],
    )
    slots = _limited(floor_div(col("__last") - col("__first"), step), config)
    on_grid = F.coalesce(col("__phase") == F.pmod("__first", big(step)), F.lit(False))
    return blocks.select(
        "*", (col("__first") + slots * big(step)).alias("__end"), on_grid.alias("__on")
    )


def _extreme(bound: str) -> Column:
    return F.min(bound) if bound.startswith("__lo") else F.max(bound)


def _on_keys(keys: Sequence[str], left: str, right: str) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return condition


def _with_series(rows: DataFrame, series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach per-series facts. A keyless table has one row of facts, read as a scalar
    subquery; keyed facts are joined and Spark picks the strategy from the measured size."""
    facts = [c for c in series.columns if c not in keys]
    if not keys:
        return with_single_row(rows, series.select(*cols(facts)))
    return rows.alias("r").join(series.alias("s"), _on_keys(keys, "r", "s")).select(
        "r.*", *[F.col(f"s.`{c}`") for c in facts]
    )


def expected_grid(df: DataFrame, config: GapConfig) -> DataFrame:
    """Every slot from each series' first to its last instant: ``keys, timestamp``."""
    keys, step = list(config.keys), micros(config.interval)
    series = _blocks(df, config).groupBy(*cols(keys)).agg(
        F.max("__first").alias("__first"), F.max("__end").alias("__end")
    ).where(col("__first").isNotNull())
    count = floor_div(col("__end") - col("__first"), step)
    ranges = series.select(*cols(keys), "__first", big(0).alias("__zero"), count.alias("__count"))
    grid = explode_range(ranges, "__zero", "__count", "__i", keep=[*keys, "__first"])
    at = col("__first") + col("__i") * big(step)
    return grid.select(
        *cols(keys), _as_type(at, dtype(df, config.timestamp)).alias(config.timestamp)
    )


def _limited(slots: Column, config: GapConfig) -> Column:
    """The number of grid steps, refused when a limit was asked for and the series exceeds it."""
    if config.max_expected_rows is None:
        return slots
    message = f"a series would have more than {config.max_expected_rows:,} expected rows"
    return F.when(
        slots >= config.max_expected_rows, F.raise_error(F.lit(message)).cast("bigint")
    ).otherwise(slots)


def _refused(kind: str, n: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"{kind}: "), n.cast("string"))).cast("boolean")


def _spans(
    df: DataFrame, config: GapConfig, *, trailing: bool, strict: bool = False,
    carried: Sequence[str] = (),
) -> DataFrame:
    """``keys, __prev, __next`` (micros) around each run of missing grid slots.

    ``trailing`` adds the run after the last on-grid instant, which is missing but belongs to
    no interior span. ``strict`` raises for any block with rows that cannot be reconstructed.
    ``carried`` columns come along with their one value in the series, or raise.
    """
    keys, step = list(config.keys), micros(config.interval)
    use = col("__on")
    if strict:
        use = (
            F.when(col("__phase").isNull(), _refused("invalid", col("__rows")))
            .when(col("__rows") > col("__size"), _refused("duplicate", col("__rows") - col("__size")))
            .when(~col("__on"), _refused("off_grid", col("__rows"))).otherwise(True)
        )
    blocks = _blocks(df, config, carried).where(use)
    kept = []
    for i, name in enumerate(carried):
        conflict = F.raise_error(F.lit(f"column {name} is not stable")).cast(dtype(df, name))
        kept.append(F.when(col(f"__lo{i}") != col(f"__hi{i}"), conflict).otherwise(
            col(f"__lo{i}")).alias(f"__s{i}"))
    between = F.struct(col("__tail").alias("a"), col("__next").alias("z"))
    none = F.array().cast("array<struct<a:bigint,z:bigint>>")
    runs = F.concat(
        col("__inner"), F.when(col("__next") - col("__tail") > step, F.array(between)).otherwise(none)
    )
    if trailing:
        after = F.struct(col("__tail").alias("a"), (col("__end") + big(step)).alias("z"))
        open_end = col("__next").isNull() & (col("__tail") < col("__end"))
        runs = F.concat(runs, F.when(open_end, F.array(after)).otherwise(none))
    shared = [f"__s{i}" for i in range(len(carried))]
    return blocks.select(*cols(keys), *kept, F.explode(runs).alias("__s")).select(
        *cols(keys), *shared, F.col("__s.a").alias("__prev"), F.col("__s.z").alias("__next")
    )


def gap_spans(df: DataFrame, config: GapConfig) -> DataFrame:
    """Interior gaps: ``keys, previous, next, missing_count``."""
    kind, step = dtype(df, config.timestamp), micros(config.interval)
    return _spans(df, config, trailing=False).select(
        *cols(config.keys),
        _as_type(col("__prev"), kind).alias("previous"),
        _as_type(col("__next"), kind).alias("next"),
        (floor_div(col("__next") - col("__prev"), step) - 1).alias("missing_count"),
    )


def missing_timestamps(df: DataFrame, config: GapConfig) -> DataFrame:
    """Grid slots without an observation: ``keys, timestamp``."""
    return _missing(df, config).drop("__t")


def _missing(
    df: DataFrame, config: GapConfig, *, strict: bool = False, carried: Sequence[str] = ()
) -> DataFrame:
    """Missing slots as ``keys, timestamp, __t`` (micros) and the ``carried`` values."""
    step, keys = micros(config.interval), list(config.keys)
    shared = [f"__s{i}" for i in range(len(carried))]
    spans = _spans(df, config, trailing=True, strict=strict, carried=carried).select(
        *cols(keys), *shared, "__prev", big(1).alias("__one"),
        (floor_div(col("__next") - col("__prev"), step) - 1).alias("__n"),
    )
    slots = explode_range(spans, "__one", "__n", "__i", keep=[*keys, *shared, "__prev"])
    at = col("__prev") + col("__i") * big(step)
    return slots.select(*cols(keys), *shared, at.alias("__t")).select(
        "*", _as_type(col("__t"), dtype(df, config.timestamp)).alias(config.timestamp)
    )


def duplicate_groups(df: DataFrame, timestamp: str, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, timestamp, n_rows`` of instants that occur more than once."""
    rows = df.where(col(timestamp).isNotNull())
    return rows.groupBy(*cols(keys), col(timestamp)).agg(F.count("*").alias("n_rows")).where(
        col("n_rows") > 1
    )


def duplicate_members(
    df: DataFrame, timestamp: str, keys: Sequence[str] = (), order: str = "_ord"
) -> DataFrame:
    """Long form: one row per duplicated source row, with its group's size."""
    groups = duplicate_groups(df, timestamp, keys)
    rows = df.select(*cols(keys), col(timestamp), col(order)).where(col(timestamp).isNotNull())
    # Null keys never match an equality join; give them a value of their own.
    if keys:
        tag = F.to_json(F.struct(*cols(keys)), {"ignoreNullFields": "false"})
        rows, groups = rows.withColumn("__key", tag), groups.withColumn("__key", tag).drop(*keys)
        return join_members(rows, groups, ["__key", timestamp], col(order)).drop("__key")
    return join_members(rows, groups, [timestamp], col(order))


def chronological_breaks(
    df: DataFrame, timestamp: str, keys: Sequence[str] = (), order: str = "_ord",
    *, width: int = CHUNK_ROWS,
) -> DataFrame:
    """Valid rows earlier than the previous valid row in source order."""
    valid = df.where(col(timestamp).isNotNull())
    pairs = successive_pairs(valid, keys, order, [order, timestamp], width=width)
    late = pairs.where(F.col(f"next.`{timestamp}`") < F.col(f"prev.`{timestamp}`"))
    return late.select(
        *cols(keys),
        F.col(f"next.`{order}`").alias(order),
        F.col(f"next.`{timestamp}`").alias(timestamp),
        F.col(f"prev.`{timestamp}`").alias("previous"),
    )


def invalid_timestamps(df: DataFrame, timestamp: str, order: str = "_ord") -> DataFrame:
    return df.where(col(timestamp).isNull()).select(col(order))


def off_grid_rows(df: DataFrame, config: GapConfig, order: str = "_ord") -> DataFrame:
    """Rows not a whole number of intervals after their series' first instant."""
    keys, step = list(config.keys), micros(config.interval)
    rows = df.where(col(config.timestamp).isNotNull()).select(
        *cols(keys), col(order), col(config.timestamp), _micros(df, config.timestamp).alias("__t")
    )
    first = rows.groupBy(*cols(keys)).agg(F.min("__t").alias("__first"))
    # Facts per (keys, phase) are tiny on clean data; rows are matched by their phase.
    return _with_series(rows, first.where(col("__first").isNotNull()), keys).where(
        F.pmod(col("__t") - col("__first"), big(step)) != 0
    ).select(*cols(keys), col(order), col(config.timestamp))


def gap_violations(df: DataFrame, config: GapConfig, order: str = "_ord") -> DataFrame:
    """``kind, n`` per reason why the series cannot be reconstructed (empty if none): rows
    without a timestamp, surplus copies, off-grid rows and, where it matters, disorder.

    The first three come from one narrow pass.
    """
    keys = list(config.keys)
    blocks = _blocks(df, config)
    lost = col("__phase").isNull()
    facts = blocks.agg(
        F.sum(F.when(lost, col("__rows"))).alias("invalid"),
        F.sum(F.when(~lost, col("__rows") - col("__size"))).alias("duplicate"),
        F.sum(F.when(~lost & ~col("__on"), col("__rows"))).alias("off_grid"),
    )
    kinds = ("invalid", "duplicate", "off_grid")
    listed = F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), col(k).alias("n")) for k in kinds])
    )
    found = facts.select(listed.alias("v")).select("v.kind", "v.n")
    if order in df.columns and not config.allow_reorder:
        late = chronological_breaks(df, config.timestamp, keys, order)
        found = found.unionByName(
            late.agg(F.count("*").alias("n")).select(F.lit("disorder").alias("kind"), "n")
        )
    return found.where("n > 0")


def require_reconstructable(df: DataFrame, config: GapConfig, order: str = "_ord") -> None:
    """Run the checks and raise with a count per kind."""
    found = gap_violations(df, config, order).collect()  # at most one row per kind
    if found:
        raise DataViolation("; ".join(f"{r['kind']}: {r['n']}" for r in found))


def stable_values(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: the single non-null value of each column; raises when a column
    holds two different ones."""
    exprs = []
    for n in columns:
        conflict = F.raise_error(F.lit(f"column {n} is not stable")).cast(dtype(df, n))
        exprs.append(
            F.when(F.min(col(n)) != F.max(col(n)), conflict).otherwise(F.min(col(n))).alias(n)
        )
    return df.groupBy(*cols(keys)).agg(*exprs)


def suggest_stable(df: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """``column, value`` for columns with exactly one distinct non-null value."""
    names = [n for n in df.columns if n not in set(excluded)]
    facts = df.agg(
        *[
            F.struct(
                F.lit(n).alias("column"),
                F.min(col(n)).cast("string").alias("value"),
                F.coalesce(F.min(col(n)) == F.max(col(n)), F.lit(False)).alias("stable"),
            ).alias(f"f{i}")
            for i, n in enumerate(names)
        ]
    )
    found = facts.select(F.explode(F.array(*[F.col(f"f{i}") for i in range(len(names))])).alias("f"))
    return found.where("f.stable").select("f.column", "f.value")


def derive(at: Column, kind: T.DataType, rule: GapField, interval: int) -> Column:
    """Value of a timestamp-derived field for a generated row at ``at`` (micros)."""
    zone = zones.canonical_zone(rule.zone) if rule.zone else "UTC"
    if rule.zone and not is_instant(kind):
        raise ValueError("a zone-derived gap field needs instants")
    name = rule.derivation
    forward = {
        Derivation.COPY: 0,
        Derivation.INTERVAL_START: 0,
        Derivation.INTERVAL_MIDPOINT: interval // 2,
        Derivation.INTERVAL_END: interval,
    }
    if name in forward:
        return _as_type(at + big(forward[name]), kind)
    wall = zones.wall_micros(F.timestamp_micros(at), zone)
    day = F.date_from_unix_date(floor_div(wall, 86_400_000_000).cast("int"))
    if name is Derivation.DATE:
        return day
    if name is Derivation.TIME:
        return F.pmod(wall, big(86_400_000_000))
    parts = {
        Derivation.YEAR: F.year(day),
        Derivation.MONTH: F.month(day),
        Derivation.DAY: F.dayofmonth(day),
        Derivation.ISO_WEEKDAY: F.weekday(day) + 1,
    }
    return parts[name]


def generate_gap_rows(
    df: DataFrame,
    config: GapConfig,
    *,
    strict: bool = True,
    order: str = "_ord",
    notes: Diagnostics | None = None,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Observed rows plus one generated row per missing slot; measurements stay null.

    The rows are read once; one narrow pass over blocks gives the missing slots, the carried
    values and, with ``strict``, the refusals, which raise when the result is worked out (disorder
    along ``order`` is a subquery of it). The result is not sorted; sinks sort when order matters.
    ``basis`` is the same data without observed counts: the narrow passes read it, so counting
    never widens them.
    """
    basis = df if basis is None else basis
    require(df, config.timestamp, *config.measurements, *[f.column for f in config.fields])
    require(df, *[c for c in (config.index_column, config.flag_column) if c], *config.keys)
    keys, step = list(config.keys), micros(config.interval)
    kind = dtype(df, config.timestamp)
    carried = [f.column for f in config.fields if f.behavior is GapBehavior.CARRY_STABLE]
    missing = _missing(basis, config, strict=strict, carried=carried)
    rules = {f.column: f for f in config.fields}
    values = []
    for n in df.columns:
        target = dtype(df, n)
        rule = rules.get(n)
        if n in keys or n == config.timestamp:
            value = col(n)
        elif rule is None or rule.behavior is GapBehavior.NULL:
            value = F.lit(None)
        elif rule.behavior is GapBehavior.CARRY_STABLE:
            value = col(f"__s{carried.index(n)}")
        elif rule.behavior is GapBehavior.FIXED_VALUE:
            value = F.lit(rule.fixed_value)
        else:
            value = derive(col("__t"), kind, rule, step)
        values.append(value.cast(target).alias(n))
    generated = missing.select(*values, F.lit(True).alias("__generated"))
    result = df.select("*", F.lit(False).alias("__generated")).unionByName(generated)
    if strict and order in basis.columns and not config.allow_reorder:
        late = chronological_breaks(basis, config.timestamp, keys, order)
        result = refused_if_any(result, late, "disorder")
    result = watch(notes, result, "gap_rows_generated", F.count_if(col("__generated")))
    if config.flag_column is not None:
        flag = col("__generated").cast(dtype(df, config.flag_column)).alias(config.flag_column)
        result = result.select(
            *[flag if n == config.flag_column else col(n) for n in result.columns]
        )
    result = result.drop("__generated")
    if config.index_column is not None:
        first = basis.where(col(config.timestamp).isNotNull()).groupBy(*cols(keys)).agg(
            F.min(_micros(basis, config.timestamp)).alias("__first")
        )
        result = _with_series(result, first, keys)
        place = floor_div(_micros(result, config.timestamp) - col("__first"), step)
        index = (place + config.index_start).cast(dtype(df, config.index_column))
        result = result.select(
            *[
                index.alias(n) if n == config.index_column else col(n)
                for n in df.columns
            ]
        )
    return result


def gap_report(df: DataFrame, config: GapConfig) -> DataFrame:
    """``keys, original_rows, generated_rows`` without building the generated rows."""
    step, keys = micros(config.interval), list(config.keys)
    # Slots of the grid minus the occupied ones.
    wanted = F.max(floor_div(col("__end") - col("__first"), step) + 1)
    occupied = F.sum(F.when(col("__on"), col("__size")))
    return _blocks(df, config).groupBy(*cols(keys)).agg(
        F.sum("__rows").cast("bigint").alias("original_rows"),
        F.coalesce(wanted - occupied, F.lit(0)).cast("bigint").alias("generated_rows"),
    )
