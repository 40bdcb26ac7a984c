"""Column-name helpers: names may hold dots, spaces or backticks, as in ``PM2.5``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[str]:
    """Quoted names, accepted wherever Spark takes columns (cheaper to build than Columns)."""
    return [quoted(n) for n in names]


def dtype(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(sorted(missing)))


def put(
    df: DataFrame, name: str, value: Column, *, replaces: str | None = None,
    position: int | None = None,
) -> DataFrame:
    """Replace ``replaces`` in place when it has this name, else append; never overwrite
    any other existing column."""
    if name == replaces:
        return df.select(*[value.alias(n) if n == name else quoted(n) for n in df.columns])
    if name in df.columns:
        raise ValueError(f"column {name!r} already exists")
    if not name.strip():
        raise ValueError("a column name must not be blank")
    where = len(df.columns) if position is None else position
    if not 0 <= where <= len(df.columns):
        raise ValueError(f"position {where} lies outside the table")
    out: list[str | Column] = [*cols(df.columns)]
    out.insert(where, value.alias(name))
    return df.select(*out)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DoubleType, T.FloatType))


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def is_instant(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType)


def is_wall(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampNTZType)
