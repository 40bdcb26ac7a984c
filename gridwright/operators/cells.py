"""Missing markers, invalid numbers and null-row rules."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridwright.config import InvalidPolicy
from gridwright.functions import numeric
from gridwright.functions.names import col, dtype, is_float, is_text, require
from gridwright.operators.diagnostics import Diagnostics, watch, write_result

ROW_MODES = (
    "all_measurements_missing",
    "all_selected_missing",
    "selected_subset_missing",
    "any_required_missing",
    "below_present_threshold",
)


def marker_match(
    value: Column,
    kind: T.DataType,
    markers: Sequence[object],
    *,
    case_sensitive: bool = False,
    strip_text: bool = True,
) -> Column:
    """True where a cell equals a marker of its own type: text never matches a number."""
    if is_text(kind):
        words = [m for m in markers if isinstance(m, str)]
        words = sorted({w.strip() if strip_text else w for w in words})
        if not words:
            hit = F.lit(False)
        elif case_sensitive and not strip_text:
            hit = value.isin(words)
        else:
            # One anchored pattern gives up at the first character of an ordinary cell.
            edge = f"[{numeric.SPACE}]*" if strip_text else ""
            flags = "" if case_sensitive else "(?iu)"
            listed = "|".join(re.escape(w) for w in words)
            hit = value.rlike(f"{flags}^{edge}(?:{listed}){edge}\\z")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        numbers = [m for m in markers if isinstance(m, (int, float)) and not isinstance(m, str)]
        real = sorted({float(m) for m in numbers if not math.isnan(m)})
        left = value.cast("int") if isinstance(kind, T.BooleanType) else value
        hit = left.cast("double").isin(real) if real else F.lit(False)
        if is_float(kind):
            nan = any(math.isnan(m) for m in numbers)
            hit = F.when(F.isnan(value), F.lit(nan)).otherwise(hit)
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def normalize_nulls(
    df: DataFrame,
    markers: Sequence[object],
    columns: Sequence[str] | None = None,
    *,
    case_sensitive: bool = False,
    strip_text: bool = True,
    notes: Diagnostics | None = None,
) -> DataFrame:
    """Turn confirmed missing markers into nulls in the selected (default all) columns."""
    selected = list(columns) if columns else df.columns
    require(df, *selected)
    hits = {
        n: marker_match(
            col(n), dtype(df, n), markers, case_sensitive=case_sensitive, strip_text=strip_text
        )
        for n in selected
    }
    count = sum((F.count_if(h) for h in hits.values()), F.lit(0))
    df = watch(notes, df, "null_markers_normalized", count)
    return df.select(
        *[F.when(~hits[n], col(n)).alias(n) if n in hits else col(n) for n in df.columns]
    )


def _bad(df: DataFrame, name: str) -> Column:
    return col(name).isNotNull() & ~F.coalesce(
        numeric.is_number(col(name), dtype(df, name)), F.lit(False)
    )


def invalid_numbers(df: DataFrame, columns: Sequence[str], order: str = "_ord") -> DataFrame:
    """Rows ``<order>, column, source_value`` for every non-null cell that is not finite."""
    if not columns or len(set(columns)) != len(columns):
        raise ValueError("select unique numeric columns")
    require(df, order, *columns)
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("column"),
                col(n).cast("string").alias("source_value"),
                _bad(df, n).alias("bad"),
            )
            for n in columns
        ]
    )
    bad = F.filter(cells, lambda c: c["bad"])
    return df.select(col(order), F.explode(bad).alias("c")).select(
        col(order), F.col("c.column"), F.col("c.source_value")
    )


def resolve_invalid_numbers(
    df: DataFrame,
    columns: Sequence[str],
    policy: str = "null_and_continue",
    *,
    suffix: str = "_source",
    typed: bool = False,
    notes: Diagnostics | None = None,
    order: str = "_ord",
) -> DataFrame:
    """Apply a file-level policy to cells that are not finite numbers.

    Valid text stays text unless ``typed`` asks for DECIMAL. ``preserve_source`` always adds
    its companion columns, so the schema does not depend on the data. ``stop`` raises once, after
    all rows are seen, and names the first cell: the first such column, there the first row by
    ``order`` (by source order where the table has no such column).
    """
    if policy not in ("null_and_continue", "inspect", "stop", "preserve_source"):
        raise ValueError(f"unknown invalid-number policy {policy!r}")
    if policy == "preserve_source" and not suffix:
        raise ValueError("the preserved-source suffix must not be empty")
    if not columns or len(set(columns)) != len(columns):
        raise ValueError("select unique numeric columns")
    bad = {n: _bad(df, n) for n in columns}
    count = sum((F.count_if(b) for b in bad.values()), F.lit(0))
    df = watch(notes, df, "invalid_numeric_values", count)
    if policy == "inspect":
        return df
    if policy == "stop":
        df = _stopped_at_first(df, bad, order)
    out, extra = [], []
    for n in df.columns:
        if n not in bad:
            out.append(col(n))
            continue
        kind = dtype(df, n)
        good = numeric.to_decimal(col(n), kind) if typed else col(n)
        out.append(F.when(~bad[n], good).alias(n))
        if policy == "preserve_source":
            if f"{n}{suffix}" in df.columns:
                raise ValueError(f"column {n + suffix!r} already exists")
            extra.append(F.when(bad[n], col(n)).alias(f"{n}{suffix}"))
    return df.select(*out, *extra)


def _stopped_at_first(df: DataFrame, bad: dict[str, Column], order: str) -> DataFrame:
    """``df``, which raises when it is worked out if any cell is bad. The first bad row of each
    column is a mergeable minimum, found by a subquery of the same query."""
    place = col(order) if order in df.columns else F.monotonically_increasing_id()
    cells = df.select(
        place.alias("__at"),
        *[F.when(b, col(n).cast("string")).alias(f"__v{i}") for i, (n, b) in enumerate(bad.items())])
    first = [F.min_by(f"__v{i}", F.when(col(f"__v{i}").isNotNull(), col("__at"))) for i in range(len(bad))]
    message = F.coalesce(*[
        F.concat(F.lit(f"invalid number in {n}: "), f) for n, f in zip(bad, first)])
    found = cells.agg(message.alias("m")).scalar()
    return df.where(F.when(found.isNotNull(), F.raise_error(found).cast("boolean")).otherwise(True))


def null_row_match(mode: str, columns: Sequence[str], minimum_present: int | None = None) -> Column:
    """Rows a removal rule matches. An empty text is not null."""
    if mode not in ROW_MODES:
        raise ValueError(f"unknown null-row mode {mode!r}")
    if not columns or len(set(columns)) != len(columns):
        raise ValueError("select unique columns")
    missing = sum((col(n).isNull().cast("int") for n in columns), F.lit(0))
    if mode == "below_present_threshold":
        if minimum_present is None or not 0 <= minimum_present <= len(columns):
            raise ValueError("minimum_present must lie within the selected column count")
        return F.lit(len(columns)) - missing < minimum_present
    if minimum_present is not None:
        raise ValueError("minimum_present goes with the threshold mode")
    return missing > 0 if mode == "any_required_missing" else missing == len(columns)


def remove_null_rows(
    df: DataFrame,
    mode: str,
    columns: Sequence[str],
    minimum_present: int | None = None,
    *,
    notes: Diagnostics | None = None,
) -> DataFrame:
    require(df, *columns)
    match = null_row_match(mode, columns, minimum_present)
    df = watch(notes, df, "null_rows_removed", F.count_if(match))
    return df.where(~match)


def preview_null_rows(
    df: DataFrame,
    mode: str,
    columns: Sequence[str],
    minimum_present: int | None = None,
    order: str = "_ord",
) -> tuple[DataFrame, DataFrame]:
    """(ids of matching rows, one row of remove/remaining counts)."""
    match = null_row_match(mode, columns, minimum_present)
    counts = df.agg(
        F.count_if(match).alias("remove_count"), F.count_if(~match).alias("remaining_rows")
    )
    return df.where(match).select(col(order)), counts


def missingness(df: DataFrame) -> DataFrame:
    """Rows ``column, missing_count, row_count, missing_fraction, suggested`` from one pass."""
    names = df.columns
    totals = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(col(n).isNull()).alias(f"m{i}") for i, n in enumerate(names)],
    )
    records = F.array(
        *[
            F.struct(F.lit(n).alias("column"), F.col(f"m{i}").alias("missing_count"))
            for i, n in enumerate(names)
        ]
    )
    return totals.select("rows", F.explode(records).alias("r")).select(
        F.col("r.column"),
        F.col("r.missing_count"),
        F.col("rows").alias("row_count"),
        F.when(F.col("rows") > 0, F.col("r.missing_count") / F.col("rows"))
        .otherwise(F.lit(0.0))
        .alias("missing_fraction"),
        (~((F.col("rows") > 0) & (F.col("r.missing_count") == F.col("rows")))).alias("suggested"),
    )


def round_column(
    df: DataFrame,
    source: str,
    decimals: int,
    *,
    output: str | None = None,
    policy: InvalidPolicy = InvalidPolicy.NULL,
    notes: Diagnostics | None = None,
) -> DataFrame:
    """Half-up rounding to a DECIMAL column."""
    number = numeric.to_decimal(col(source), dtype(df, source))
    return write_result(
        df, source, output, numeric.round_half_up(number, decimals), numeric.DECIMAL, policy,
        "invalid_numeric_values", notes,
    )


def convert_concentration(
    df: DataFrame,
    source: str,
    conversion: str,
    *,
    output: str | None = None,
    policy: InvalidPolicy = InvalidPolicy.NULL,
    notes: Diagnostics | None = None,
) -> DataFrame:
    if conversion not in numeric.CONCENTRATION:
        raise ValueError(f"unknown conversion {conversion!r}")
    number = numeric.to_decimal(col(source), dtype(df, source), numeric.CONCENTRATION_INPUT)
    return write_result(
        df, source, output, numeric.concentration(number, conversion), numeric.DECIMAL, policy,
        "invalid_numeric_values", notes,
    )
