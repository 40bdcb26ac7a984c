"""Projections and column operations (metadata only, except the two that need counts)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gridwright.functions.names import col, cols, put, require
from gridwright.operators.ordering import with_position


def rename_column(df: DataFrame, source: str, output: str) -> DataFrame:
    require(df, source)
    if not output.strip():
        raise ValueError("a column name must not be blank")
    if output != source and output in df.columns:
        raise ValueError(f"column {output!r} already exists")
    return df.withColumnRenamed(source, output)


def reorder_columns(
    df: DataFrame, order: Sequence[str], *, append_unlisted: bool = True
) -> DataFrame:
    require(df, *order)
    if len(set(order)) != len(order):
        raise ValueError("reordered columns must be unique")
    rest = [n for n in df.columns if n not in set(order)]
    if rest and not append_unlisted:
        raise ValueError("reorder leaves out: " + ", ".join(rest))
    return df.select(*cols([*order, *rest]))


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    require(df, *names)
    if len(set(names)) != len(names):
        raise ValueError("selected columns must be unique")
    return df.select(*cols(names))


def add_empty_column(
    df: DataFrame, name: str, *, kind: str = "string", position: int | None = None
) -> DataFrame:
    return put(df, name, F.lit(None).cast(kind), position=position)


def duplicate_column(
    df: DataFrame, source: str, output: str, *, position: int | None = None
) -> DataFrame:
    require(df, source)
    return put(df, output, col(source), position=position)


def add_index_column(
    df: DataFrame,
    name: str = "Index",
    *,
    order: str = "_ord",
    start: int = 1,
    position: int = 0,
    keys: Sequence[str] = (),
    **chunking: int,
) -> DataFrame:
    """Contiguous index along ``order`` (per series when keys are given)."""
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    numbered = with_position(df, order, name, keys=keys, start=start, **chunking)
    names = list(df.columns)
    names.insert(position, name)
    return numbered.select(*cols(names))


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single non-null cell, from one aggregation."""
    if not df.columns:
        return []
    counts = df.agg(*[F.count(col(n)).alias(f"c{i}") for i, n in enumerate(df.columns)]).first()
    return [n for i, n in enumerate(df.columns) if counts[i] == 0]


def drop_empty_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    drop = set(empty_columns(df)) - set(keep)
    return df.select(*cols(n for n in df.columns if n not in drop))


def final_projection(
    df: DataFrame,
    exported: Sequence[tuple[str, str]],
    derived: Sequence[str] = (),
) -> DataFrame:
    """Exported columns under their output names, then the derived columns that exist."""
    require(df, *[source for source, _ in exported])
    names = [name for _, name in exported]
    if len(set(names)) != len(names):
        raise ValueError("exported names must be unique")
    present = [n for n in derived if n in df.columns]
    return df.select(*[col(s).alias(o) for s, o in exported], *cols(present))
