"""Column profiling: blanks, missing markers, semantic types, likely interval, previews.

Per-column facts come from wide single-row aggregations (no shuffle of cell values). Distinct
values are only shuffled for columns an approximate count shows to be of low cardinality.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from gridwright.functions import numeric
from gridwright.functions.names import col, cols, require
from gridwright.operators.ordering import (
    CHUNK_ROWS,
    chunk_offsets,
    successive_pairs,
    with_chunk,
)

# Texts that look like missing markers, boolean words, detection thresholds.
MISSING_WORDS = ("na", "n/a", "null", "none", "nan", "-999", "-999.0")
TRUE_WORDS = ("true", "yes", "y")
FALSE_WORDS = ("false", "no", "n")
NUMBER_SHARE = 0.95
MOMENT_SHARE = 0.8
CATEGORY_LIMIT = 20

# Names of common intervals, in seconds.
INTERVAL_NAMES = {
    60.0: "1 minute",
    300.0: "5 minutes",
    900.0: "15 minutes",
    3600.0: "1 hour",
    28800.0: "8 hours",
    86400.0: "1 day",
}

# Spellings read as date/time while profiling, as (shape, pattern); the first
# match wins.
MOMENTS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.\d{1,6}", "yyyy-MM-dd[ ]['T']HH:mm:ss.SSSSSS"),
    (r"\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}", "yyyy-M-d[ ]['T']H:m:s"),
    (r"\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}", "yyyy-M-d[ ]['T']H:m"),
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{8}T\d{6}", "yyyyMMdd'T'HHmmss"),
    (r"\d{8}T\d{4}", "yyyyMMdd'T'HHmm"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})",
     "yyyy-MM-dd[ ]['T']HH:mm:ss[.SSSSSS]XXX"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})", "yyyy-MM-dd[ ]['T']HH:mmXXX"),
    (r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}", "d/M/yyyy H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}", "d/M/yyyy H:m"),
    (r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}:\d{1,2}", "M/d/yyyy H:m:s"),
    (r"\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}", "M/d/yyyy H:m"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}:\d{1,2}:\d{1,2}", "H:m:s"),
    (r"\d{1,2}:\d{1,2}", "H:m"),
)


def _text(name: str) -> Column:
    return numeric.strip(col(name).cast("string"))


def is_blank(name: str) -> Column:
    return F.coalesce(_text(name) == "", F.lit(True))


def is_marker(name: str) -> Column:
    return F.coalesce(F.lower(_text(name)).isin(list(MISSING_WORDS)), F.lit(False))


def _usable(name: str) -> Column:
    """Text of a cell that is neither blank nor a missing marker."""
    return F.when(~is_blank(name) & ~is_marker(name), _text(name))


def read_moment(text: Column) -> Column:
    """Wall-clock or instant reading of a text in any profiled spelling, as TIMESTAMP."""
    readings = [
        F.when(
            text.rlike(f"^{shape}$"),
            F.try_to_timestamp(
                F.regexp_replace(text, r"\s+", " ") if r"\s" in shape else text, F.lit(pattern)
            ),
        )
        for shape, pattern in MOMENTS
    ]
    # One cheap look spares plain words and numbers the whole list.
    return F.when(text.rlike("^[0-9]{1,4}[-/:]|^[0-9]{8}(T|$)"), F.coalesce(*readings))


def missing_markers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``marker, count`` per raw spelling over all columns and rows, most frequent first."""
    names = list(columns or df.columns)
    require(df, *names)
    found = F.filter(
        F.array(*[F.when(is_marker(n), _text(n)) for n in names]), lambda v: v.isNotNull()
    )
    return (
        df.select(F.explode(found).alias("marker"))
        .groupBy("marker")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "marker")
    )


def column_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, blank_count, marker_count, row_count, missing_percent, entirely_empty``."""
    names = list(columns or df.columns)
    require(df, *names)
    totals = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_blank(n)).alias(f"b{i}") for i, n in enumerate(names)],
        *[F.count_if(is_marker(n)).alias(f"m{i}") for i, n in enumerate(names)],
    )
    records = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"), F.col(f"b{i}").alias("blank"), F.col(f"m{i}").alias("marker")
            )
            for i, n in enumerate(names)
        ]
    )
    missing = (F.col("r.blank") + F.col("r.marker")) / F.col("rows") * 100
    return totals.select("rows", F.explode(records).alias("r")).select(
        F.col("r.column"),
        F.col("r.blank").alias("blank_count"),
        F.col("r.marker").alias("marker_count"),
        F.col("rows").alias("row_count"),
        F.when(F.col("rows") > 0, F.round(missing, 2)).otherwise(F.lit(0.0)).alias("missing_percent"),
        (F.col("r.blank") == F.col("rows")).alias("entirely_empty"),
    )


def first_values(df: DataFrame, name: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` usable values of a column in source order (``_ord, value``)."""
    return (
        df.select(col(order).alias("_ord"), _usable(name).alias("value"))
        .where(F.col("value").isNotNull())
        .orderBy("_ord")
        .limit(limit)
    )


def _type_facts(names: Sequence[str], value) -> list[Column]:
    facts = []
    for i, n in enumerate(names):
        v = value(n)
        moment = read_moment(v)
        # Python-style integers may hold single underscores between digits.
        whole = v.rlike(r"^[+-]?\d+(_\d+)*$")
        slash = v.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}$")
        day = F.regexp_extract(v, r"^(\d{1,2})[/-]", 1).try_cast("int")
        month = F.regexp_extract(v, r"^\d{1,2}[/-](\d{1,2})[/-]", 1).try_cast("int")
        facts.append(
            F.struct(
                F.lit(n).alias("column"),
                F.count(v).alias("n"),
                F.count_if(F.lower(v).isin(list(TRUE_WORDS + FALSE_WORDS))).alias("bools"),
                F.count_if(whole).alias("ints"),
                F.count_if(numeric.to_double(v, StringType()).isNotNull()).alias("numbers"),
                F.count(moment).alias("moments"),
                F.count_if(v.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$")).alias("clocks"),
                F.count_if(v.rlike("[:T]")).alias("timed"),
                F.count_if(slash).alias("slashes"),
                F.count_if(slash & (day <= 12) & (month <= 12)).alias("open_slashes"),
            ).alias(f"f{i}")
        )
    return facts




def infer_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    *,
    order: str = "_ord",
    sample_limit: int | None = None,
) -> DataFrame:
    """``column, inferred_type, confidence, ambiguous_regional, unique_count, n``.

    Types are judged on all usable values; only when asked, on the first ``sample_limit`` of each
    column in source order.
    """
    names = [n for n in (columns or df.columns) if n != order]
    require(df, *names)
    if sample_limit is None:
        source = df.select(*[_usable(n).alias(n) for n in names])
    else:
        source = None
        for n in names:
            part = first_values(df, n, order, sample_limit).select(
                *[(F.col("value") if m == n else F.lit(None).cast("string")).alias(m) for m in names]
            )
            source = part if source is None else source.unionByName(part)
    facts = source.agg(*_type_facts(names, col)).select(
        F.explode(F.array(*[F.col(f"f{i}") for i in range(len(names))])).alias("f")
    ).select("f.*")
    unique = distinct_counts(source, names)
    f = facts.join(unique, "column", "left")
    n = F.col("n")
    share = lambda c: F.try_divide(F.col(c), n)
    limit = F.least(F.lit(CATEGORY_LIMIT), F.greatest(F.lit(2), F.bround(n * 0.2, 0)))
    boolean = F.col("bools") == n
    integer = share("ints") >= NUMBER_SHARE
    decimal = share("numbers") >= NUMBER_SHARE
    moment = share("moments") >= MOMENT_SHARE
    moment_kind = (
        F.when(F.col("clocks") == n, "Time").when(F.col("timed") == 0, "Date").otherwise("DateTime")
    )
    category = (F.col("unique_count") <= limit) & (n >= 5)
    kind = (
        F.when(n == 0, "Empty").when(boolean, "Boolean").when(integer, "Integer")
        .when(decimal, "Decimal").when(moment, moment_kind).when(category, "Category")
        .otherwise("Text")
    )
    confidence = (
        F.when(n == 0, 1.0).when(boolean, 1.0).when(integer, share("ints"))
        .when(decimal, share("numbers")).when(moment, share("moments")).when(category, 0.8)
        .otherwise(0.9)
    )
    ambiguous = (
        moment & ~boolean & ~integer & ~decimal
        & (F.col("slashes") > 0) & (F.col("open_slashes") == F.col("slashes"))
    )
    return f.select(
        "column",
        kind.alias("inferred_type"),
        confidence.cast("double").alias("confidence"),
        F.coalesce(ambiguous, F.lit(False)).alias("ambiguous_regional"),
        F.coalesce("unique_count", F.lit(0)).cast("bigint").alias("unique_count"),
        "n",
    )


def distinct_counts(source: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, unique_count``: exact counts of distinct values, equal cells of a task counted
    once before the shuffle; a column without values has no row."""
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), col(n).cast("string").alias("v")) for n in names]
    )
    return (
        source.select(F.explode(cells).alias("c")).where("c.v is not null")
        .groupBy("c.column", "c.v").agg(F.count("*").alias("k"))
        .groupBy("column").agg(F.count("*").alias("unique_count"))
    )


def examples(
    df: DataFrame, columns: Sequence[str] | None = None, *, order: str = "_ord", count: int = 3
) -> DataFrame:
    """``column, place, example``: the first distinct usable values of each column in order.

    One scan: equal cells become one row before the shuffle, the first few of each column are
    picked in 64 parts and then among those.
    """
    names = [n for n in (columns or df.columns) if n != order]
    cells = F.array(
        *[F.struct(F.lit(n).alias("column"), _usable(n).alias("example")) for n in names])
    seen = (
        df.select(col(order).alias("__o"), F.explode(cells).alias("c"))
        .where("c.example is not null")
        .groupBy("c.column", "c.example").agg(F.min("__o").alias("__o"))
        .withColumn("__part", F.pmod(F.xxhash64("example"), F.lit(64)))
    )
    place = F.row_number().over(Window.partitionBy("column", "__part").orderBy("__o", "example"))
    few = seen.withColumn("__place", place).where(F.col("__place") <= count)
    place = F.row_number().over(Window.partitionBy("column").orderBy("__o", "example"))
    return few.select("column", place.alias("place"), "example").where(F.col("place") <= count)


def likely_datetime_column(types: DataFrame) -> str | None:
    """Date/time column with the best (confidence, number of readings)."""
    best = (
        types.where(F.col("inferred_type").isin("Date", "DateTime") & (F.col("n") >= 2))
        .orderBy(F.desc("confidence"), F.desc("n"))
        .first()
    )
    return best["column"] if best else None


def interval_label(seconds: Column) -> Column:
    label = F.concat(F.format_string("%s", _short(seconds)), F.lit(" seconds"))
    label = F.when(seconds % 60 == 0, F.concat(_short(seconds / 60), F.lit(" minutes"))).otherwise(
        label
    )
    label = F.when(seconds % 3600 == 0, F.concat(_short(seconds / 3600), F.lit(" hours"))).otherwise(
        label
    )
    for value, name in INTERVAL_NAMES.items():
        label = F.when(seconds == value, name).otherwise(label)
    return label


def _short(number: Column) -> Column:
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(
        number.cast("string")
    )


def likely_interval(
    df: DataFrame,
    timestamp: str,
    *,
    order: str = "_ord",
    sample_limit: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Most frequent positive step between consecutive readings in source order.

    ``keys, interval_seconds, matching_steps, label``; ties go to the step seen first.
    """
    rows = df.select(*cols(keys), col(order).alias("_ord"), col(timestamp).alias("__t")).where(
        col("__t").isNotNull()
    )
    if sample_limit is not None:
        rows = rows.orderBy("_ord").limit(sample_limit)
    rows = rows.withColumn("__u", F.unix_micros(col("__t").cast("timestamp")))
    pairs = successive_pairs(rows, keys, "_ord", ["__u", "_ord"])
    step = F.col("next.__u") - F.col("prev.__u")
    steps = pairs.where(step > 0).groupBy(*cols(keys), step.alias("__d")).agg(
        F.count("*").alias("__n"), F.min("next._ord").alias("__seen")
    )
    best = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__seen"), F.col("__d").alias("d")))
    seconds = (F.col("best.d") / 1_000_000).cast("double")
    return steps.groupBy(*cols(keys)).agg(best.alias("best")).where("best is not null").select(
        *cols(keys),
        seconds.alias("interval_seconds"),
        (-F.col("best.n")).alias("matching_steps"),
        interval_label(seconds).alias("label"),
    )


@dataclass(frozen=True)
class Preview:
    name: str
    start: int
    stop: int


def preview_ranges(rows: int, size: int = 5) -> list[Preview]:
    """One-based position ranges of the first, middle and last slices."""
    if rows == 0:
        return []
    middle = max(0, (rows - size) // 2) + 1
    return [
        Preview("First", 1, min(size, rows)),
        Preview("Middle", middle, min(middle + size - 1, rows)),
        Preview("Last", max(1, rows - size + 1), rows),
    ]


def preview_slices(
    df: DataFrame, *, order: str = "_ord", size: int = 5, width: int = CHUNK_ROWS
) -> DataFrame:
    """``slice, position`` and the row's columns for the first, middle and last rows.

    Chunk counts locate the few chunks that hold the wanted positions; only those are read
    in order.
    """
    require(df, order)
    chunked = with_chunk(df, order, width)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = chunk_offsets(chunked, rows=width).select("*", total.alias("__rows"))
    n = F.col("__rows")
    middle = F.greatest(F.lit(0), F.floor((n - size) / 2)) + 1
    ranges = F.array(
        F.struct(F.lit("First").alias("slice"), F.lit(1).cast("bigint").alias("a"),
                 F.least(F.lit(size), n).cast("bigint").alias("z")),
        F.struct(F.lit("Middle").alias("slice"), middle.cast("bigint").alias("a"),
                 F.least(middle + size - 1, n).cast("bigint").alias("z")),
        F.struct(F.lit("Last").alias("slice"),
                 F.greatest(F.lit(1), n - size + 1).cast("bigint").alias("a"),
                 n.cast("bigint").alias("z")),
    )
    wanted = counts.select("*", F.explode(ranges).alias("w")).where(
        (F.col("w.a") <= F.col("__before") + F.col("__n")) & (F.col("w.z") > F.col("__before"))
    )
    # Three ranges of a few rows touch at most 3 * size chunks, whatever the table's size.
    here = wanted.select("__chunk").distinct()
    inside = Window.partitionBy("__chunk").orderBy(col(order))
    rows = chunked.join(F.broadcast(here), "__chunk", "left_semi").withColumn(
        "__place", F.row_number().over(inside)
    )
    picked = rows.join(
        F.broadcast(wanted.select("__chunk", "__before", "w")), "__chunk"
    ).withColumn("position", (F.col("__place") + F.col("__before")).cast("bigint"))
    return picked.where(
        (F.col("position") >= F.col("w.a")) & (F.col("position") <= F.col("w.z"))
    ).select(F.col("w.slice"), "position", *cols(df.columns))


def column_profile(
    df: DataFrame, columns: Sequence[str] | None = None, *, order: str = "_ord",
    sample_limit: int | None = None,
) -> DataFrame:
    """Everything known about each column in one frame (one row per column)."""
    names = [n for n in (columns or df.columns) if n != order]
    shown = examples(df, names, order=order).groupBy("column").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "example"))), lambda e: e["example"]
        ).alias("examples")
    )
    return (
        column_counts(df, names)
        .join(infer_types(df, names, order=order, sample_limit=sample_limit), "column")
        .join(shown, "column", "left")
    )
