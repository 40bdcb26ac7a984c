"""Split & join over files: prepare sources, run, publish with a manifest and checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwright.config import Action, SourceSpec, SplitJoinSpec
from gridwright.errors import DataViolation
from gridwright.functions import zones
from gridwright.functions.names import col, cols
from gridwright.operators import splitjoin
from gridwright.sources import sinks
from gridwright.sources.verify import content_digest
from gridwright.sources.delimited import DelimitedOptions, read_delimited


@dataclass
class SplitJoinRun:
    """Rows ready to write, the columns that name an output, and the manifest."""

    rows: DataFrame
    outputs: list[str]
    manifest: DataFrame


def snapshot(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """Name, size and modification time of a source's files, to detect later changes."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    listing = fs.listStatus(where)
    return sorted((f.getPath().getName(), f.getLen(), str(f.getModificationTime())) for f in listing)


def read_sources(
    spark: SparkSession, sources: Sequence[SourceSpec], spec: SplitJoinSpec,
    options: DelimitedOptions = DelimitedOptions(),
) -> list[DataFrame]:
    """Scan, parse and number every source file set. Paths must differ."""
    paths = [s.path for s in sources]
    if not paths or None in paths:
        raise ValueError("every source needs a path")
    if len(set(paths)) != len(paths):
        raise ValueError("the same input cannot be added twice")
    return [
        splitjoin.prepare_source(read_delimited(spark, s.path, options), s, i, keys=spec.keys)
        for i, s in enumerate(sources)
    ]


def run_split_join(
    frames: Sequence[DataFrame], names: Sequence[str], spec: SplitJoinSpec
) -> SplitJoinRun:
    """Rows with ISO timestamps in the boundary zone, one ``output`` name per result table."""
    zone = zones.canonical_zone(spec.zone)
    rows = splitjoin.split_join(frames, spec)
    joined = f"Joined_{len(frames)}files"
    split = spec.action is Action.SPLIT_TIME or (
        spec.regroup and spec.action in (Action.JOIN_TIME, Action.JOIN_FIELDS)
    )
    if spec.action in (Action.JOIN_TIME, Action.JOIN_FIELDS):
        name = F.lit(joined)
    else:
        labels = F.array(*[F.lit(f"S{i + 1}_{n}") for i, n in enumerate(names)])
        name = F.get(labels, col("_src"))
    if split:
        name = F.concat(name, F.lit("_"), col("period_label"))
    elif spec.action is Action.SPLIT_FIELDS:
        name = F.concat(name, F.lit("_"), col("group"))
    rows = rows.select("*", name.alias("output"))
    by = ["output"]
    if split:
        for edge in ("period_start", "period_end"):
            rows = rows.withColumn(edge, zones.iso_text(col(edge), zone))
        by += ["period_start", "period_end"]
    listed = list_outputs(rows, by, zone)
    text = zones.iso_text(col("_ts"), zone).alias("Timestamp")
    hidden = {"_ts", "period_label", "group"}
    shown = rows.select(text, col("_ts"), *[col(n) for n in rows.columns if n not in hidden])
    return SplitJoinRun(shown, by, listed)


def list_outputs(rows: DataFrame, by: Sequence[str], zone: str) -> DataFrame:
    """The manifest of output rows with ISO times in a zone."""
    listed = splitjoin.manifest(rows, by)
    for edge in ("first_timestamp", "last_timestamp"):
        listed = listed.withColumn(edge, zones.iso_text(col(edge), zone))
    return listed


def publish_split_join(
    spark: SparkSession, run: SplitJoinRun, spec: SplitJoinSpec, target: str, *,
    fmt: str = "parquet", sources: Sequence[SourceSpec] = (), overwrite: bool = False,
) -> DataFrame:
    """Write one folder per output into a staging path, compare what was written cell by cell
    (by digests) with the rows it was written from, then rename it into place. The plan runs
    once: everything else reads its staged rows. Returns the manifest."""
    empty_ok = spec.action in (Action.JOIN_TIME, Action.JOIN_FIELDS) and not spec.regroup
    zone = zones.canonical_zone(spec.zone)
    before = {s.path: snapshot(spark, s.path) for s in sources if s.path}
    order = [n for n in ("_ts", "_src", "_ord") if n in run.rows.columns]
    staging = f"{target.rstrip('/')}__pending"

    def write(path: str) -> None:
        names = run.rows.columns
        with sinks.staged(run.rows.select("*", col("output").alias("result")), path) as rows:
            listed = list_outputs(rows, run.outputs, zone)
            splitjoin.check_outputs(listed, spec.max_outputs, allow_none=empty_ok)
            listed.coalesce(1).write.json(f"{path}/manifest")
            sinks.write_periods(rows, f"{path}/data", ["result"], order, copy=False)
            digests = [
                df.groupBy("output").agg(F.struct(*content_digest(df, names)).alias(name))
                for df, name in ((rows, "sent"), (spark.read.parquet(f"{path}/data"), "found"))
            ]
            wrong = digests[0].join(digests[1], "output", "full").where(
                ~col("sent").eqNullSafe(col("found")))
            if not wrong.isEmpty():
                raise DataViolation("an output failed reopen verification; nothing was published")
        for source, was in before.items():
            if snapshot(spark, source) != was:
                raise DataViolation(f"{source} changed during preparation")
        if fmt != "parquet":
            names = [n for n in run.rows.columns if n not in ("_ts", "_src", "_ord")]
            text = spark.read.parquet(f"{path}/data")
            sinks.write_periods(
                text.select("result", *cols(order), *cols(n for n in names if n != "output")),
                f"{path}/{fmt}", ["result"], order, fmt=fmt,
            )

    sinks.publish(write, staging, target, spark, overwrite=overwrite)
    return spark.read.json(f"{target}/manifest")
