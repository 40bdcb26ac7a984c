"""Registry of runnable queries: each builds a frame from the tables in a folder, most with an
equivalent SQL text for checking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from gridwright.functions.names import col
from gridwright.session import use_engine_settings

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, build: Build, sql: str | None = None) -> None:
    if name in REGISTRY:
        raise ValueError(f"query {name!r} is registered twice")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return flat(build(use_engine_settings(spark), folder))

    REGISTRY[name] = Query(run, sql)


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def wrap(build: Build) -> Build:
        register(name, build, sql)
        return build

    return wrap


def flat(df: DataFrame) -> DataFrame:
    """Result types that compare well across engines: instants as UTC wall clock."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            out.append(col(f.name).cast("timestamp_ntz").alias(f.name))
        elif isinstance(f.dataType, T.DecimalType):
            out.append(col(f.name).cast("double").alias(f.name))
        else:
            out.append(col(f.name))
    return df.select(*out)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Hourly series per event type: on-grid, with natural gaps.
HOURLY_SQL = """hourly AS (
  SELECT event_type, date_trunc('hour', ts) AS ts,
         sum(CAST(value AS DECIMAL(12,2))) AS reading, max(value) AS peak
  FROM events GROUP BY 1, 2)"""


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.groupBy(
        "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts")
    ).agg(
        F.sum(F.col("value").cast("decimal(12,2)")).alias("reading"), F.max("value").alias("peak")
    )


# Hourly instants over several years: sparse, crosses daylight-saving changes.
YEARS_SQL = """years AS (
  SELECT o_orderdate + to_hours(o_orderkey % 24) AS ts,
         sum(CAST(o_totalprice AS DECIMAL(14,2))) AS reading
  FROM orders GROUP BY 1)"""


def years(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (
        F.col("o_orderkey") % 24
    ) * F.lit(3_600_000_000)
    return o.groupBy(F.timestamp_micros(at).alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("reading")
    )


# One row per calendar day.
DAYS_SQL = """days AS (
  SELECT o_orderdate AS ts, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS reading
  FROM orders GROUP BY 1)"""


def days(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)")).alias("reading")
    )


# Text cells with missing markers and rubbish at fixed ids.
DIRTY_SQL = """dirty AS (
  SELECT event_id, event_type, ts,
         CASE WHEN event_id % 97 = 0 THEN 'N/A'
              WHEN event_id % 89 = 0 THEN ' -999 '
              WHEN event_id % 41 = 0 THEN 'bad'
              WHEN event_id % 37 = 0 THEN ''
              ELSE CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) END AS reading,
         CASE WHEN event_id % 31 = 0 THEN 'n/a'
              WHEN event_id % 29 = 0 THEN '1e2'
              WHEN event_id % 23 = 0 THEN NULL
              ELSE CAST(user_id AS VARCHAR) END AS level,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_type END AS station
  FROM events)"""


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    i = F.col("event_id")
    reading = (
        F.when(i % 97 == 0, "N/A").when(i % 89 == 0, " -999 ").when(i % 41 == 0, "bad")
        .when(i % 37 == 0, "").otherwise(F.col("value").cast("decimal(12,2)").cast("string"))
    )
    level = (
        F.when(i % 31 == 0, "n/a").when(i % 29 == 0, "1e2").when(i % 23 == 0, F.lit(None))
        .otherwise(F.col("user_id").cast("string"))
    )
    return e.select(
        "event_id", "event_type", "ts", reading.alias("reading"), level.alias("level"),
        F.when(i % 19 != 0, F.col("event_type")).alias("station"),
    )
