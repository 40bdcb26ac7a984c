"""Reopen verification and processing evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridwright.functions.names import col
from gridwright.operators.diagnostics import Diagnostics

CHECKS = "check string, passed boolean, warning boolean, detail string"


def time_like(names: Sequence[str]) -> str | None:
    """First column that looks like a time axis by name."""
    for n in names:
        low = n.casefold()
        if "time" in low or low in ("date", "period_start"):
            return n
    return None


def content_digest(df: DataFrame, names: Sequence[str] | None = None) -> list[Column]:
    """Order-free digest aggregates: row count, sum and xor of row hashes.

    Cells are compared as text, and null differs from empty text.
    """
    cells = [
        F.coalesce(F.concat(F.lit("="), col(n).cast("string")), F.lit("~"))
        for n in (names or df.columns)
    ]
    row = F.xxhash64(*cells)
    # Two 32-bit halves are summed so the total cannot overflow below 2^31 rows per half.
    return [
        F.count("*").alias("rows"),
        F.sum(row.cast("decimal(20,0)")).alias("hash_sum"),
        F.bit_xor(row).alias("hash_xor"),
    ]


def _readable(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    zulu = F.regexp_replace(text, "Z$", "+00:00")
    return zulu.try_cast("timestamp").isNotNull()


def verify_output(
    actual: DataFrame, expected: DataFrame, *, order: Sequence[str] = ()
) -> tuple[DataFrame, str]:
    """(one row per check, status) for a re-read output against the frame it was written from.

    Status: Passed, Passed with warnings or Failed. Both frames are digested where they lie;
    only the two digests reach the driver.
    """
    spark = actual.sparkSession
    rows = [
        (
            "Column names and order", actual.columns == expected.columns, False,
            f"expected {len(expected.columns)} columns, found {len(actual.columns)}",
        ),
        (
            "No duplicate Index column",
            sum(n.casefold() == "index" for n in actual.columns) <= 1, False, "",
        ),
    ]
    axis = time_like(actual.columns)
    extra = []
    if axis is not None:
        place = [col(n) for n in order] or [col(axis)]
        key = F.struct(*place)
        extra = [
            F.min_by(col(axis), key).alias("first"), F.max_by(col(axis), key).alias("last")
        ]
    found = actual.agg(*content_digest(actual), *extra).first()
    wanted = expected.agg(*content_digest(expected)).first()
    rows.append(
        (
            "Row count", found["rows"] == wanted["rows"], False,
            f"expected {wanted['rows']}, found {found['rows']}",
        )
    )
    same = (found["hash_sum"], found["hash_xor"]) == (wanted["hash_sum"], wanted["hash_xor"])
    rows.append(("Values and null representation", same, False, ""))
    if axis is None or not found["rows"]:
        rows.append(("First and last timestamp", True, True, "no time-like column to check"))
    else:
        ends = spark.createDataFrame(
            [(None if v is None else str(v),) for v in (found["first"], found["last"])], "v string"
        )
        ok = ends.where(~F.coalesce(_readable(F.col("v")), F.lit(False))).count() == 0
        rows.append(
            ("First and last timestamp", ok, False, f"first={found['first']}; last={found['last']}")
        )
    return spark.createDataFrame(rows, CHECKS), status(rows)


def status(checks: Sequence[tuple]) -> str:
    if any(not passed and not warning for _, passed, warning, _ in checks):
        return "Failed"
    return "Passed with warnings" if any(warning for _, _, warning, _ in checks) else "Passed"


def differing_rows(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of either side missing from the other; run only after a digest mismatch."""
    left = actual.select(*[col(n).cast("string").alias(n) for n in actual.columns])
    right = expected.select(*[col(n).cast("string").alias(n) for n in expected.columns])
    return left.exceptAll(right).select(F.lit("unexpected").alias("side"), "*").unionByName(
        right.exceptAll(left).select(F.lit("missing").alias("side"), "*")
    )


# Evidence field of each diagnostic code.
EVIDENCE = {
    "gap_rows_generated": "generated_gap_rows",
    "null_rows_removed": "removed_rows",
    "invalid_numeric_values": "invalid_values",
    "invalid_temporal_values": "invalid_values",
    "custom_format_invalid": "invalid_values",
    "values_rejected": "rejected_averages",
}


def processing_evidence(
    spark,
    *,
    input_rows: int,
    input_columns: Sequence[str],
    output_rows: int,
    output_columns: Sequence[str],
    notes: Diagnostics | None = None,
    counts: Mapping[str, int] | None = None,
    stages: Sequence[str] = (),
    warnings: Sequence[str] = (),
    errors: Sequence[str] = (),
) -> DataFrame:
    """One row of counts describing a run, ready to be written as JSON beside the data."""
    totals = dict.fromkeys(sorted(set(EVIDENCE.values())), 0)
    for code, n in {**(notes.counts() if notes else {}), **(counts or {})}.items():
        if code in EVIDENCE:
            totals[EVIDENCE[code]] += n
    row = (
        input_rows, output_rows, len(input_columns), len(output_columns),
        ", ".join(output_columns), *totals.values(), list(stages), list(warnings), list(errors),
    )
    schema = (
        "input_rows bigint, output_rows bigint, input_columns int, output_columns int, "
        "output_order string, " + ", ".join(f"{n} bigint" for n in totals)
        + ", stages array<string>, warnings array<string>, errors array<string>"
    )
    return spark.createDataFrame([row], schema)
