"""Queries over columns, null markers, invalid numbers, null rows and number formats."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from gridwright.catalog.base import DIRTY_SQL, dirty, query, table
from gridwright.config import InvalidPolicy
from gridwright.functions.numeric import NumberMask, to_decimal
from gridwright.operators import calculated, cells, columns
from gridwright.functions.names import col, dtype

NUMERIC_SHAPE = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def number(c):
    """SQL: a text cell as DOUBLE, null when it is not a number."""
    return f"CASE WHEN regexp_matches(trim({c}), {NUMERIC_SHAPE}) THEN CAST(trim({c}) AS DOUBLE) END"


# Columns.
@query("column_rename", "SELECT event_id, value AS reading, user_id FROM events")
def rename(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value", "user_id")
    return columns.rename_column(e, "value", "reading")


@query("column_reorder", "SELECT value, ts, event_id, user_id FROM events")
def reorder(spark, folder):
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "value")
    return columns.reorder_columns(e, ["value", "ts"])


@query("column_select", "SELECT o_orderdate, o_totalprice FROM orders")
def select(spark, folder):
    return columns.select_columns(table(spark, folder, "orders"), ["o_orderdate", "o_totalprice"])


@query("column_add_empty", "SELECT event_id, CAST(NULL AS VARCHAR) AS note, value FROM events")
def add_empty(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value")
    return columns.add_empty_column(e, "note", position=1)


@query("column_duplicate", "SELECT event_id, value, value AS raw_value FROM events")
def duplicate(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value")
    return columns.duplicate_column(e, "value", "raw_value", position=2)


@query(
    "column_index",
    'SELECT row_number() OVER (ORDER BY o_orderkey) AS "Index", o_orderkey, o_totalprice FROM orders',
)
def index(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    # A narrow chunk so that numbering is stitched over many chunks even on small tables.
    return columns.add_index_column(o, order="o_orderkey", width=512)


@query(
    "column_index_sparse_key",
    """SELECT o_orderkey * 1099511627689 AS place, row_number() OVER (ORDER BY o_orderkey) AS "Index" FROM orders""",
)
def sparse_index(spark, folder):
    """An index along a key whose values are far apart."""
    place = (F.col("o_orderkey") * F.lit(1099511627689)).alias("place")
    o = table(spark, folder, "orders").select(place)
    return columns.add_index_column(o, order="place", width=512)


@query(
    "column_index_per_series",
    "SELECT event_id, event_type, 99 + row_number() OVER (PARTITION BY event_type ORDER BY event_id)"
    " AS place FROM events",
)
def index_per_series(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type")
    return columns.add_index_column(
        e, "place", order="event_id", start=100, position=2, keys=["event_type"], width=512
    )


@query("column_drop_empty", "SELECT event_id, value, CAST(NULL AS VARCHAR) AS kept FROM events")
def drop_empty(spark, folder):
    e = table(spark, folder, "events").select("event_id", "value")
    wide = columns.add_empty_column(columns.add_empty_column(e, "gone"), "kept")
    return columns.drop_empty_columns(wide, keep=["kept"])


@query(
    "column_final_projection",
    'SELECT ts AS "When", value AS "PM2.5", ts - INTERVAL 30 MINUTE AS "When Start" FROM events',
)
def project(spark, folder):
    e = table(spark, folder, "events").withColumn(
        "When Start", F.col("ts") - F.expr("interval 30 minutes")
    )
    return columns.final_projection(
        e, [("ts", "When"), ("value", "PM2.5")], ["When Start", "When Mid"]
    )


# Missing markers.
MARKERS = ["n/a", "", "-999", -999, float("nan")]


@query(
    "nulls_from_confirmed_markers",
    f"""WITH {DIRTY_SQL}
SELECT event_id, CASE WHEN lower(trim(reading)) IN ('n/a', '', '-999') THEN NULL ELSE reading END AS reading,
       CASE WHEN lower(trim(level)) IN ('n/a', '', '-999') THEN NULL ELSE level END AS level,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value
FROM dirty JOIN events USING (event_id)""",
)
def markers(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading", "level")
    raw = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_id") % 14 == 0, F.lit(-999.0))
        .when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
        .alias("value"),
    )
    return cells.normalize_nulls(df.join(raw, "event_id"), MARKERS)


@query(
    "nulls_case_sensitive_unstripped",
    f"""WITH {DIRTY_SQL}
SELECT event_id, CASE WHEN reading IN ('N/A', '-999') THEN NULL ELSE reading END AS reading,
       CASE WHEN level IN ('N/A', '-999') THEN NULL ELSE level END AS level FROM dirty""",
)
def markers_exact(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading", "level")
    return cells.normalize_nulls(
        df, ["N/A", "-999"], case_sensitive=True, strip_text=False
    )


# Invalid numbers.
@query(
    "invalid_number_cells",
    f"""WITH {DIRTY_SQL}
SELECT event_id, 'reading' AS "column", reading AS source_value FROM dirty
WHERE reading IS NOT NULL AND ({number('reading')}) IS NULL
UNION ALL
SELECT event_id, 'level', level FROM dirty WHERE level IS NOT NULL AND ({number('level')}) IS NULL""",
)
def invalid_cells(spark, folder):
    return cells.invalid_numbers(dirty(spark, folder), ["reading", "level"], "event_id")


@query(
    "invalid_numbers_to_null",
    f"""WITH {DIRTY_SQL}
SELECT event_id, CASE WHEN ({number('reading')}) IS NOT NULL THEN reading END AS reading FROM dirty""",
)
def invalid_null(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading")
    return cells.resolve_invalid_numbers(df, ["reading"])


@query(
    "invalid_numbers_preserved",
    f"""WITH {DIRTY_SQL}
SELECT event_id, {number('reading')} AS reading, {number('level')} AS level,
       CASE WHEN ({number('reading')}) IS NULL THEN reading END AS reading_source,
       CASE WHEN ({number('level')}) IS NULL THEN level END AS level_source FROM dirty""",
)
def invalid_preserved(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading", "level")
    return cells.resolve_invalid_numbers(
        df, ["reading", "level"], "preserve_source", typed=True
    )


@query("invalid_numbers_inspected", f"WITH {DIRTY_SQL} SELECT event_id, reading FROM dirty")
def invalid_inspect(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading")
    return cells.resolve_invalid_numbers(df, ["reading"], "inspect")


@query("invalid_numbers_stop_on_clean_data", "SELECT event_id, CAST(user_id AS VARCHAR) AS who FROM events")
def invalid_stop(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("who"))
    return cells.resolve_invalid_numbers(df, ["who"], "stop")


@query(
    "invalid_numbers_stop",
    f"""WITH {DIRTY_SQL} SELECT name AS column_name, CASE WHEN bad > 0 THEN 'refused' ELSE 'accepted' END AS outcome FROM (
 SELECT 'reading' AS name, count(*) FILTER (WHERE trim(coalesce(reading, '')) <> '' AND ({number('reading')}) IS NULL) AS bad FROM dirty
 UNION ALL SELECT 'user', count(*) FILTER (WHERE user_id IS NULL) FROM events)""",
)
def invalid_stop_on_dirty_data(spark, folder):
    found = []
    clean = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("user"))
    for df, name in ((dirty(spark, folder), "reading"), (clean, "user")):
        try:
            cells.resolve_invalid_numbers(df, [name], "stop").select(name).write.format("noop").mode(
                "overwrite").save()
            found.append((name, "accepted"))
        except Exception as error:  # the refusal is what is asked for
            found.append((name, "refused" if name in str(error) else f"failed: {error}"))
    return spark.createDataFrame(found, "column_name string, outcome string")


@query(
    "invalid_numbers_stop_at_first_cell",
    f"""WITH {DIRTY_SQL}, b AS (SELECT event_id, reading FROM dirty
 WHERE trim(coalesce(reading, '')) <> '' AND ({number('reading')}) IS NULL)
SELECT (SELECT 'invalid number in reading: ' || min_by(reading, event_id) FROM b) AS up,
 (SELECT 'invalid number in reading: ' || max_by(reading, event_id) FROM b) AS down,
 (SELECT 'invalid number in copy: ' || min_by('x' || event_id, event_id) FROM dirty) AS other""",
)
def invalid_stop_first(spark, folder):
    """The message names the first cell by column, then by row, in either order of the rows. Blank
    cells are confirmed as missing first; unconfirmed, they would be invalid numbers as well."""
    d = cells.normalize_nulls(dirty(spark, folder), [""], ["reading"])
    d = d.withColumn("copy", F.concat(F.lit("x"), F.col("event_id").cast("string")))
    asked = (
        (["reading", "copy"], F.col("event_id")), (["reading", "copy"], -F.col("event_id")),
        (["copy", "reading"], F.col("event_id")))
    found = []
    for columns, order in asked:
        rows = cells.resolve_invalid_numbers(d.withColumn("_ord", order), columns, "stop")
        try:
            rows.write.format("noop").mode("overwrite").save()
            found.append(None)
        except Exception as error:  # the refusal is what is asked for
            found.append(re.search(r"invalid number in [^\n]*?(?= SQLSTATE|\n|$)", str(error))[0].strip())
    return spark.createDataFrame([tuple(found)], "up string, down string, other string")


# Null rows and missingness.
THREE = f"""{DIRTY_SQL},
n AS (SELECT event_id, {number('reading')} AS a, {number('level')} AS b, station AS c FROM dirty)"""


def three(spark, folder):
    d = dirty(spark, folder)
    return cells.resolve_invalid_numbers(
        d.select("event_id", F.col("reading").alias("a"), F.col("level").alias("b"),
                 F.col("station").alias("c")),
        ["a", "b"], typed=True,
    )


ROW_RULES = {
    "any_required_missing": ("a IS NULL OR b IS NULL OR c IS NULL", None),
    "all_measurements_missing": ("a IS NULL AND b IS NULL AND c IS NULL", None),
    "all_selected_missing": ("a IS NULL AND b IS NULL AND c IS NULL", None),
    "selected_subset_missing": ("a IS NULL AND b IS NULL AND c IS NULL", None),
    "below_present_threshold": (
        "(a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT < 2", 2,
    ),
}

for mode, (rule, least) in ROW_RULES.items():

    @query(
        f"rows_removed_{mode}",
        f"WITH {THREE} SELECT event_id, a, b, c FROM n WHERE NOT ({rule})",
    )
    def removed(spark, folder, mode=mode, least=least):
        return cells.remove_null_rows(three(spark, folder), mode, ["a", "b", "c"], least)


@query(
    "rows_removal_preview",
    f"WITH {THREE} SELECT event_id FROM n WHERE a IS NULL OR b IS NULL OR c IS NULL",
)
def removal_preview(spark, folder):
    rows, _ = cells.preview_null_rows(
        three(spark, folder), "any_required_missing", ["a", "b", "c"], order="event_id"
    )
    return rows


@query(
    "rows_removal_counts",
    f"""WITH {THREE} SELECT count(*) FILTER (WHERE a IS NULL OR b IS NULL OR c IS NULL) AS remove_count,
 count(*) FILTER (WHERE NOT (a IS NULL OR b IS NULL OR c IS NULL)) AS remaining_rows FROM n""",
)
def removal_counts(spark, folder):
    _, counts = cells.preview_null_rows(
        three(spark, folder), "any_required_missing", ["a", "b", "c"], order="event_id"
    )
    return counts


@query(
    "column_missingness",
    f"""WITH {THREE},
u AS (SELECT 'event_id' AS "column", event_id IS NULL AS m FROM n
      UNION ALL SELECT 'a', a IS NULL FROM n UNION ALL SELECT 'b', b IS NULL FROM n
      UNION ALL SELECT 'c', c IS NULL FROM n UNION ALL SELECT 'void', true FROM n)
SELECT "column", count(*) FILTER (WHERE m) AS missing_count, count(*) AS row_count,
       count(*) FILTER (WHERE m) / count(*)::DOUBLE AS missing_fraction, NOT bool_and(m) AS suggested
FROM u GROUP BY 1""",
)
def missing(spark, folder):
    return cells.missingness(columns.add_empty_column(three(spark, folder), "void"))


# Numbers.
@query(
    "number_parse",
    f"WITH {DIRTY_SQL} SELECT event_id, {number('reading')} AS a, {number('level')} AS b FROM dirty",
)
def parse_numbers(spark, folder):
    df = dirty(spark, folder)
    return df.select(
        "event_id", to_decimal(col("reading"), dtype(df, "reading")).alias("a"),
        to_decimal(col("level"), dtype(df, "level")).alias("b"),
    )


@query(
    "number_round_half_up",
    """SELECT l_orderkey, l_linenumber,
 CAST(floor(abs(CAST(l_extendedprice * 100 AS BIGINT)) / 10 + 0.5) / 10 AS DOUBLE) AS l_extendedprice,
 CAST(floor(l_quantity / 10 + 0.5) * 10 AS DOUBLE) AS tens FROM lineitem""",
)
def rounding(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity"
    )
    df = cells.round_column(df, "l_extendedprice", 1)
    return cells.round_column(df, "l_quantity", -1, output="tens").drop("l_quantity")


@query(
    "number_round_policies",
    f"""WITH {DIRTY_SQL}
SELECT event_id, round(CAST({number('reading')} AS DECIMAL(18,4)), 1)::DOUBLE AS reading,
       CASE WHEN ({number('reading')}) IS NULL THEN reading END AS reading_source FROM dirty""",
)
def rounding_policy(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading")
    return cells.round_column(df, "reading", 1, policy=InvalidPolicy.PRESERVE)


@query(
    "concentration_ppm_ppb",
    """SELECT event_id, CAST(CAST(value AS DECIMAL(18,4)) * 1000 AS DOUBLE) AS no2_ppb,
 CAST(CAST(value AS DECIMAL(18,4)) * 0.001 AS DOUBLE) AS back_ppm FROM events""",
)
def concentration(spark, folder):
    df = table(spark, folder, "events").select("event_id", F.col("value").alias("no2_ppm"))
    df = cells.convert_concentration(df, "no2_ppm", "ppb_to_ppm", output="back_ppm")
    df = cells.convert_concentration(df, "no2_ppm", "ppm_to_ppb", output="no2_ppb")
    return df.drop("no2_ppm")


@query(
    "calculated_field",
    f"""WITH {DIRTY_SQL}
SELECT event_id, round((({number('reading')}) + 3) * (({number('level')}) / 2), 6) + 0 AS score,
       round(({number('reading')}) / nullif(event_id % 5, 0), 6) + 0 AS ratio FROM dirty""",
)
def calculated_field(spark, folder):
    x, y = calculated.field("reading"), calculated.field("level")
    df = dirty(spark, folder).select("event_id", "reading", "level")
    df = df.withColumn("fifth", F.col("event_id") % 5)
    df = calculated.add_calculated(df, "score", (x + 3) * (y / 2))
    df = calculated.add_calculated(df, "ratio", x / calculated.field("fifth"))
    return df.select(
        "event_id", F.round(F.col("score").cast("double"), 6).alias("score"),
        F.round(F.col("ratio").cast("double"), 6).alias("ratio"),
    )


@query(
    "linear_field",
    f"WITH {DIRTY_SQL} SELECT event_id, round(2.5 * ({number('reading')}) + 1, 6) AS scaled FROM dirty",
)
def linear(spark, folder):
    df = dirty(spark, folder).select("event_id", "reading")
    df = calculated.add_linear(df, "reading", "scaled", "2.5", 1)
    return df.select("event_id", F.round(F.col("scaled").cast("double"), 6).alias("scaled"))


# Localised numbers: grouped text with a decimal comma, made from prices.
EURO = "translate(printf('%,.2f', o_totalprice), ',.', '.,')"


def euro(spark, folder):
    o = table(spark, folder, "orders")
    text = F.translate(F.format_number(F.col("o_totalprice").cast("decimal(14,2)"), 2), ",.", ".,")
    odd = F.when(F.col("o_orderkey") % 50 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    return o.select("o_orderkey", odd.alias("price"))


@query(
    "localised_number_parse",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 50 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE)"
    " END AS price FROM orders",
)
def localised(spark, folder):
    mask = NumberMask("#,##0.00", ",")
    return euro(spark, folder).select("o_orderkey", mask.parse(F.col("price")).alias("price"))


@query(
    "mask_number_round",
    "SELECT o_orderkey, CAST(floor(CAST(o_totalprice AS DECIMAL(14,2)) * 10 + 0.5) / 10 AS DOUBLE) AS price,"
    " CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS kept FROM orders",
)
def mask_round(spark, folder):
    o = table(spark, folder, "orders")
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return o.select(
        "o_orderkey", NumberMask("0.0").rounded(price).alias("price"),
        NumberMask("0.0", preserve=True).rounded(price).alias("kept"),
    )


@query(
    "mask_number_display",
    """SELECT o_orderkey,
 CASE WHEN length(w) > 3 THEN regexp_replace(w, '(\\d{1,3})(\\d{3})$', '\\1.\\2') ELSE w END || ',' || f AS grouped,
 lpad(w, 8, '0') || regexp_replace('.' || f, '\\.?0{1,2}$', '') AS padded
FROM (SELECT o_orderkey, CAST(c // 100 AS VARCHAR) AS w, lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS f
      FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))""",
)
def mask_display(spark, folder):
    o = table(spark, folder, "orders")
    price = F.col("o_totalprice").cast("decimal(14,2)")
    return o.select(
        "o_orderkey", NumberMask("#,##0.00", ",").display(price).alias("grouped"),
        NumberMask("00000000.##").display(price).alias("padded"),
    )
