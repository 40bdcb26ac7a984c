"""Time the headline queries on one folder of tables; prints one JSON line.

``csv_daily_<rows>`` are the published baseline job from file to file: read a generated one-minute
CSV (every 97th row N/A), null the markers, ppm to ppb, daily means with the 75 % rule, write CSV.
Writing the source is not timed. They run in one session, so start-up is in none of them; the
growth from size to size is what compares.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query after one warm-up, the fastest counts; default 2),
BENCH_CSV_ROWS (default 100000,1000000,5000000; empty for none).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from datetime import timedelta

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from gridwright.catalog import REGISTRY  # noqa: E402
from gridwright.config import AveragingConfig, FieldRule, Stage, day  # noqa: E402
from gridwright.operators.averaging import average  # noqa: E402
from gridwright.plans.average import AveragePlan, prepare  # noqa: E402
from gridwright.session import build_session  # noqa: E402
from gridwright.sources import delimited, sinks  # noqa: E402

HEADLINE = (
    "clean_convert_average_daily",  # the published baseline job's shape
    "flagship_daily_mean",
    "average_day_completeness",
    "average_clock_8h",
    "average_day_zone_new_york",
    "average_season",
    "statistic_median",
    "statistic_energy_average_leq",
    "incremental_two_of_three",
    "completeness_records",
    "gap_missing_timestamps",
    "gap_rows_generated",
    "gap_duplicate_rows",
    "join_fields_outer",
    "join_time_first",
    "split_time_output_manifest",
    "invalid_number_cells",
    "nulls_from_confirmed_markers",
    "datetime_iso_minute",
    "zone_localize_first",
    "column_index",
    "profile_column_counts",
    "recipe_average",
    "recipe_reformat",
)


def write_minutes(spark, path: str, rows: int) -> None:
    i = F.col("id")
    reading = lambda text: F.when(i % 97 == 0, "N/A").otherwise(text)
    spark.range(rows).select(
        F.date_format(F.timestamp_seconds(1_704_067_200 + i * 60), "yyyy-MM-dd HH:mm").alias("Timestamp"),
        reading(F.format_string("%.2f", 10 + (i % 400) / 10)).alias("PM2.5"),
        reading(F.format_string("%.4f", 0.01 + (i % 50) / 10_000)).alias("NO2_ppm"),
        F.lit("Station A").alias("Station"),
    ).write.option("header", "true").csv(path)


def csv_daily(spark, source: str, target: str) -> None:
    config = AveragingConfig(
        "Timestamp", timedelta(minutes=1), "UTC",
        (FieldRule("PM2.5"), FieldRule("NO2_ppm", output_name="NO2_ppb")), (Stage(day()),))
    df = delimited.read_delimited(spark, source, ordinal=None)
    df = prepare(df, AveragePlan(config, markers=("N/A",)))
    df = df.withColumn("NO2_ppm", F.col("NO2_ppm") * 1000)
    sinks.write_delimited(average(df, config).table, target)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
            "spark.log.level": "ERROR",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINE:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            REGISTRY[name].build(spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if attempt and (best is None or spent < best):
                best = spent
        times[name] = round(best if best is not None else spent, 4)
    base = tempfile.mkdtemp(prefix="spark-")
    for size in filter(None, os.environ.get("BENCH_CSV_ROWS", "100000,1000000,5000000").split(",")):
        write_minutes(spark, f"{base}/{size}", int(size))
        spent = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            csv_daily(spark, f"{base}/{size}", f"{base}/{size}-out{attempt}")
            spent.append(time.perf_counter() - start)
        times[f"csv_daily_{size}"] = round(min(spent[1:] or spent), 4)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "event_rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
