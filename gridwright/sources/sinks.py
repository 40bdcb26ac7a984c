"""Sinks: missing-value policy, delimited text, staged publishing, period-partitioned output."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridwright.config import MissingOutput
from gridwright.functions.names import col, cols, dtype
from gridwright.functions.numeric import DECIMAL, NumberMask

# Text written for a missing cell.
SENTINELS = {MissingOutput.NA: "N/A", MissingOutput.MINUS_999: "-999"}


def missing_text(policy: MissingOutput | str, custom: object = None) -> str | None:
    policy = MissingOutput(policy)
    if (policy is MissingOutput.CUSTOM) != (custom is not None):
        raise ValueError("a custom sentinel goes with the custom policy")
    return str(custom) if policy is MissingOutput.CUSTOM else SENTINELS.get(policy)


def as_text(value: Column, kind: T.DataType) -> Column:
    """Delimited-file spelling of a value."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        fraction = F.unix_micros(value.cast("timestamp")) % 1_000_000
        text = F.when(fraction == 0, whole).otherwise(
            F.date_format(value.cast("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
        )
        return F.concat(text, F.lit("+00:00")) if isinstance(kind, T.TimestampType) else text
    return value.cast("string")


def apply_missing(
    df: DataFrame,
    policy: MissingOutput | str = MissingOutput.TRUE_NULL,
    custom: object = None,
    *,
    masks: Mapping[str, NumberMask] | None = None,
) -> DataFrame:
    """Text rendering of every column: number masks, then the missing-value sentinel."""
    sentinel = missing_text(policy, custom)
    out = []
    for n in df.columns:
        kind = dtype(df, n)
        mask = (masks or {}).get(n)
        if mask is not None and isinstance(kind, T.NumericType):
            text = mask.display(col(n).cast(DECIMAL), full_precision=True)
        else:
            text = as_text(col(n), kind)
        out.append((F.coalesce(text, F.lit(sentinel)) if sentinel is not None else text).alias(n))
    return df.select(*out)


def write_delimited(
    df: DataFrame,
    path: str,
    *,
    policy: MissingOutput | str = MissingOutput.TRUE_NULL,
    custom: object = None,
    masks: Mapping[str, NumberMask] | None = None,
    order: Sequence[str] = (),
    delimiter: str = ",",
    overwrite: bool = False,
    compression: str | None = None,
) -> None:
    """Write a folder of delimited files with a header each.

    With ``order`` the rows are range partitioned and sorted, so files follow each other in
    order without passing one task. They are staged beside the target first, and the copy goes
    afterwards: sampling the ranges would otherwise work the whole plan out a second time.
    """
    if order:
        with staged(df, path) as rows:
            write_delimited(
                rows.repartitionByRange(*cols(order)).sortWithinPartitions(*cols(order)), path,
                policy=policy, custom=custom, masks=masks, delimiter=delimiter,
                overwrite=overwrite, compression=compression,
            )
        return
    text = apply_missing(df, policy, custom, masks=masks)
    writer = text.write.mode("overwrite" if overwrite else "errorifexists")
    options = {"header": "true", "sep": delimiter, "escape": '"', "emptyValue": '""',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if compression:
        options["compression"] = compression
    writer.options(**options).csv(path)


def publish(df_writer, staging: str, target: str, spark, *, overwrite: bool = False) -> None:
    """All-or-nothing output: ``df_writer(staging)`` writes, then one rename publishes it. An old
    output is moved aside before that and comes back if the rename fails.

    Uses the cluster's own file-system client, so it works on any path Spark can write.
    """
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    source, goal = jvm.org.apache.hadoop.fs.Path(staging), jvm.org.apache.hadoop.fs.Path(target)
    fs = goal.getFileSystem(conf)
    if fs.exists(goal) and not overwrite:
        raise FileExistsError(target)
    try:
        df_writer(staging)
        fs.mkdirs(goal.getParent())
        old = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}__old_{uuid.uuid4().hex}")
        had = fs.exists(goal)
        if had and not fs.rename(goal, old):
            raise OSError(f"could not move the old output of {target} aside")
        if not fs.rename(source, goal):
            if had:
                fs.rename(old, goal)
            raise OSError(f"could not publish {target}")
        if had:
            fs.delete(old, True)
    except Exception:
        if fs.exists(source):
            fs.delete(source, True)
        raise


def write_periods(
    df: DataFrame,
    path: str,
    by: Sequence[str],
    order: Sequence[str],
    *,
    fmt: str = "parquet",
    overwrite: bool = False,
    copy: bool = True,
) -> None:
    """One folder per output (``by`` columns), rows ascending inside each.

    Range partitioning on (by, order) balances files whatever the size of one output: a
    period holding a third of the rows becomes many files in order, not one task. Rows are
    staged first, see ``write_delimited``; ``copy=False`` is for rows that are staged already.
    """
    place = [*cols(by), *cols(order)]
    with staged(df, path) if copy else nullcontext(df) as rows:
        rows = rows.repartitionByRange(*place).sortWithinPartitions(*place)
        writer = rows.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by)
        if fmt == "csv":
            writer = writer.options(
                header="true", escape='"', ignoreLeadingWhiteSpace="false",
                ignoreTrailingWhiteSpace="false",
            )
        writer.format(fmt).save(path)


@contextmanager
def staged(df: DataFrame, target: str) -> Iterator[DataFrame]:
    """A copy of ``df`` beside ``target``, on the same file system, that is deleted at the end."""
    spark = df.sparkSession
    path = f"{target.rstrip('/')}__rows_{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
