"""Profiling, delimited sources, sinks and verification over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import Window, functions as F

from gridwright.catalog.base import DIRTY_SQL, dirty, query, table
from gridwright.catalog.cells import number
from gridwright.functions.numeric import NumberMask
from gridwright.operators import ordering, profile, splitjoin
from gridwright.session import shared_folder
from gridwright.sources import delimited, sinks, verify

CLEAN = "lower(trim({c})) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan', '-999', '-999.0')"


def texts(spark, folder):
    """Dirty text with a regional date and a boolean column."""
    d = dirty(spark, folder)
    i = F.col("event_id")
    return d.select(
        i.alias("_ord"), "reading", "level", "station",
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        F.concat(F.lit("0"), (i % 9 + 1).cast("string"), F.lit("/0"), (i % 8 + 1).cast("string"),
                 F.lit("/2024")).alias("day"),
        F.when(i % 2 == 0, "Yes").otherwise("no").alias("flag"),
        F.concat(F.lit("note "), i.cast("string")).alias("note"),
        F.lit("").alias("void"),
    )


NAMES = ("reading", "level", "station", "stamp", "day", "flag", "note", "void")
TEXTS_SQL = f"""{DIRTY_SQL}, texts AS (
  SELECT event_id AS _ord, reading, level, station, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
         '0' || (event_id % 9 + 1) || '/0' || (event_id % 8 + 1) || '/2024' AS "day",
         CASE WHEN event_id % 2 = 0 THEN 'Yes' ELSE 'no' END AS flag, 'note ' || event_id AS note,
         '' AS void FROM dirty),
long AS (SELECT _ord, "column", v FROM (
  {' UNION ALL '.join(f"SELECT _ord, '{n}' AS " + '"column"' + f", {chr(34)}{n}{chr(34)} AS v FROM texts" for n in NAMES)}))"""

MISSING = "coalesce(trim(v), '') = ''"
MARKER = "lower(trim(v)) IN ('na', 'n/a', 'null', 'none', 'nan', '-999', '-999.0')"


@query(
    "profile_column_counts",
    f"""WITH {TEXTS_SQL}
SELECT "column", count(*) FILTER (WHERE {MISSING}) AS blank_count,
       count(*) FILTER (WHERE {MARKER}) AS marker_count, count(*) AS row_count,
       CAST(round(CAST(count(*) FILTER (WHERE {MISSING} OR {MARKER}) AS DECIMAL(18,6)) * 100 / count(*), 2) AS DOUBLE)
         AS missing_percent,
       count(*) FILTER (WHERE {MISSING}) = count(*) AS entirely_empty
FROM long GROUP BY 1""",
)
def counts(spark, folder):
    return profile.column_counts(texts(spark, folder), NAMES)


@query(
    "profile_missing_markers",
    f"""WITH {TEXTS_SQL} SELECT trim(v) AS marker, count(*) AS "count" FROM long WHERE {MARKER} GROUP BY 1""",
)
def markers(spark, folder):
    return profile.missing_markers(texts(spark, folder), NAMES)


@query(
    "profile_semantic_types",
    f"""WITH {TEXTS_SQL},
u AS (SELECT "column", trim(v) AS v FROM long WHERE NOT ({MISSING}) AND NOT ({MARKER})),
f AS (SELECT "column", count(*) AS n,
  bool_and(lower(v) IN ('true', 'yes', 'y', 'false', 'no', 'n')) AS bools,
  avg(regexp_matches(v, '^[+-]?[0-9]+$')::INT) AS ints,
  avg((({number('v')}) IS NOT NULL)::INT) AS nums,
  avg((coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%m/%d/%Y')) IS NOT NULL)::INT) AS moments,
  bool_or(contains(v, ':')) AS timed,
  bool_and(regexp_matches(v, '^0[0-9]/0[0-9]/[0-9]{{4}}$')) AS slashes, count(DISTINCT v) AS k
  FROM u GROUP BY 1)
SELECT "column", CASE WHEN bools THEN 'Boolean' WHEN ints >= 0.95 THEN 'Integer' WHEN nums >= 0.95 THEN 'Decimal'
   WHEN moments >= 0.8 AND timed THEN 'DateTime' WHEN moments >= 0.8 THEN 'Date'
   WHEN k <= 20 AND n >= 5 THEN 'Category' ELSE 'Text' END AS inferred_type,
  CAST(CASE WHEN bools THEN 1.0 WHEN ints >= 0.95 THEN ints WHEN nums >= 0.95 THEN nums
   WHEN moments >= 0.8 THEN moments WHEN k <= 20 AND n >= 5 THEN 0.8 ELSE 0.9 END AS DOUBLE) AS confidence,
  coalesce(slashes, false) AND moments >= 0.8 AS ambiguous_regional,
  k AS unique_count, n FROM f
UNION ALL SELECT "column", 'Empty', 1.0, false, 0, 0 FROM (SELECT DISTINCT "column" FROM long)
WHERE "column" NOT IN (SELECT "column" FROM f)""",
)
def types(spark, folder):
    return profile.infer_types(texts(spark, folder), NAMES)


@query(
    "profile_examples",
    f"""WITH {TEXTS_SQL},
u AS (SELECT "column", trim(v) AS v, min(_ord) AS o FROM long WHERE NOT ({MISSING}) AND NOT ({MARKER}) GROUP BY 1, 2),
r AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY o) AS place FROM u)
SELECT "column", CAST(place AS INTEGER) AS place, v AS example FROM r WHERE place <= 3""",
)
def examples(spark, folder):
    return profile.examples(texts(spark, folder), NAMES)


@query(
    "profile_likely_interval",
    """WITH l AS (SELECT o_orderkey, epoch(o_orderdate) - epoch(lag(o_orderdate) OVER (ORDER BY o_orderkey)) AS d FROM orders),
n AS (SELECT d, count(*) AS n, min(o_orderkey) AS seen FROM l WHERE d > 0 GROUP BY 1)
SELECT CAST(d AS DOUBLE) AS interval_seconds, n AS matching_steps,
 CASE WHEN d = 86400 THEN '1 day' ELSE CAST(d / 3600 AS BIGINT) || ' hours' END AS label
FROM n ORDER BY n DESC, seen LIMIT 1""",
)
def interval(spark, folder):
    return profile.likely_interval(
        table(spark, folder, "orders"), "o_orderdate", order="o_orderkey"
    )


@query(
    "profile_preview_slices",
    """WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS position,
 count(*) OVER () AS n FROM orders)
SELECT 'First' AS slice, position, o_orderkey, o_totalprice FROM r WHERE position <= 5
UNION ALL SELECT 'Middle', position, o_orderkey, o_totalprice FROM r
WHERE position BETWEEN (n - 5) // 2 + 1 AND (n - 5) // 2 + 5
UNION ALL SELECT 'Last', position, o_orderkey, o_totalprice FROM r WHERE position > n - 5""",
)
def previews(spark, folder):
    o = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return profile.preview_slices(o, order="o_orderkey", width=512)


# Files: whole tables written to the shared folder, then read by the operator under test.
def delimited_events(spark, folder, options=delimited.DelimitedOptions()):
    path = shared_folder(spark, "events-csv")
    df = dirty(spark, folder).select(
        F.col("event_id").alias(" id "), F.col("event_type").alias("kind"),
        F.col("reading"), F.col("station"),
    )
    sinks.write_delimited(df, path, delimiter=options.delimiter)
    return path


SCAN_SQL = f"""WITH {DIRTY_SQL}
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS kind, reading, coalesce(station, '') AS station FROM dirty"""


@query("scan_delimited", SCAN_SQL)
def scan(spark, folder):
    return delimited.read_delimited(
        spark, delimited_events(spark, folder), ordinal=None
    )


@query("scan_delimited_tabs", SCAN_SQL)
def scan_tabs(spark, folder):
    options = delimited.DelimitedOptions(delimiter="\t")
    path = delimited_events(spark, folder, options)
    return delimited.read_delimited(spark, path, options, ordinal=None)


def ragged(spark, folder):
    """Lines of two to four fields plus blank lines, one per order."""
    path = shared_folder(spark, "ragged")
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    full = [k.cast("string"), F.col("o_orderpriority"), F.lit('"a,b"'), F.lit("tail")]
    line = (
        F.when(k % 10 == 0, F.concat_ws(",", *full[:2]))
        .when(k % 10 == 1, F.concat_ws(",", *full))
        .when(k % 10 == 2, F.lit(",,"))
        .otherwise(F.concat_ws(",", *full[:3]))
    )
    o.select(line.alias("value")).write.text(path)
    return path


RAGGED = delimited.DelimitedOptions(header=False)


@query(
    "scan_ragged_rows",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority,
 CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'a,b' END AS note FROM orders WHERE o_orderkey % 10 <> 2""",
)
def scan_ragged(spark, folder):
    return delimited.read_delimited(
        spark, ragged(spark, folder), RAGGED, names=["id", "priority", "note"], ordinal=None
    )


@query(
    "scan_field_counts",
    """SELECT CAST(CASE o_orderkey % 10 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 3 END AS INTEGER) AS field_count,
 count(*) AS row_count FROM orders GROUP BY 1""",
)
def field_counts(spark, folder):
    return delimited.field_count_report(spark, ragged(spark, folder), RAGGED)


def batch(spark, folder):
    """One delimited file set per order priority; one of them with another layout."""
    from gridwright.session import shared_folder as fresh

    base = fresh(spark, "batch")
    o = table(spark, folder, "orders")
    good = o.select("o_orderpriority", "o_orderkey", "o_totalprice")
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    for place, name in enumerate(names):
        part = good.where(F.col("o_orderpriority") == name).drop("o_orderpriority")
        if place == 2:
            part = part.select("o_totalprice", "o_orderkey")
        sinks.write_delimited(part, f"{base}/{place}")
    return [f"{base}/{p}" for p in range(len(names))]


@query(
    "scan_batch_compatibility",
    """SELECT CAST(CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS INTEGER) AS place, o_orderpriority <> '3-MEDIUM' AS compatible,
 CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'ordered column names do not match the reference schema' END AS reason
FROM (SELECT DISTINCT o_orderpriority FROM orders)""",
)
def compatibility(spark, folder):
    found = delimited.batch_compatibility(spark, batch(spark, folder))
    place = F.regexp_extract("file", r"/(\d)/[^/]*$", 1).cast("int")
    # A source may consist of several part files; all of one source agree.
    return found.groupBy(place.alias("place")).agg(
        F.bool_and("compatible").alias("compatible"), F.min("reason").alias("reason")
    )


@query(
    "scan_batch_reasons",
    """WITH r AS (SELECT count(*) AS n FROM region),
v AS (SELECT * FROM (VALUES ('delimiter', ['delimiter does not match the reference file']),
 ('empty', ['the file is empty']), ('good', []), ('header', ['ordered column names do not match the reference schema',
  'header detection does not match the reference file']),
 ('kind', ['file type is csv; expected txt']), ('names', ['ordered column names do not match the reference schema']),
 ('quote', ['quote-character behavior does not match the reference file']), ('reference', [])) AS t(source, reasons))
SELECT source, array_to_string(reasons, '; ') AS reason, len(reasons) = 0 AS compatible FROM v, r WHERE n > 0""",
)
def reasons(spark, folder):
    """One file for each reason, written from a table, an empty file among them."""
    base = shared_folder(spark, "reasons")
    r = table(spark, folder, "region").select(
        F.col("r_regionkey").cast("string").alias("k"), F.col("r_name").alias("n"))
    layouts = {
        "reference": ("key,name", '{k},"{n}"'), "good": ("key,name", '{k},"{n}"'),
        "names": ("name,key", '{k},"{n}"'), "delimiter": ("key;name", '{k};"{n}"'),
        "quote": ("key,name", "{k},'{n}'"), "header": ("9,x", '{k},"{n}"'), "empty": (None, "")}
    paths = []
    for source, (head, line) in layouts.items():
        pieces = re.split(r"(\{k\}|\{n\})", line)
        text = F.concat(*[F.col(p[1]) if p in ("{k}", "{n}") else F.lit(p) for p in pieces])
        lines = r.select(F.col("k").alias("place"), text.alias("value"))
        lines = lines.unionAll(spark.createDataFrame([("", head)], "place string, value string"))
        lines = lines.where(F.lit(head is not None)).repartition(1).sortWithinPartitions("place")
        lines.select("value").write.text(f"{base}/{source}")
        paths.append(f"{base}/{source}")
    sinks.write_delimited(r.select(F.col("k").alias("key"), F.col("n").alias("name")).coalesce(1), f"{base}/kind")
    found = delimited.batch_compatibility(spark, [*paths, f"{base}/kind"])
    source = F.regexp_extract("file", r"/([a-z]+)/[^/]*$", 1)
    return found.select(
        source.alias("source"), F.coalesce("reason", F.lit("")).alias("reason"), "compatible").distinct()


@query(
    "scan_isolated_sources",
    f"""WITH {DIRTY_SQL},
s AS (SELECT 'part ' || (event_id % 10) AS source, event_id, reading FROM dirty),
b AS (SELECT source, count(*) AS problems FROM s WHERE event_id % 41 = 0 AND event_id % 20 = 0 GROUP BY 1)
SELECT source, count(*) AS input_rows, any_value(b.problems) IS NULL AS passed,
 coalesce(any_value(b.problems), 0) AS problems FROM s LEFT JOIN b USING (source) GROUP BY 1""",
)
def isolated(spark, folder):
    df = dirty(spark, folder).select(
        F.concat(F.lit("part "), (F.col("event_id") % 10).cast("string")).alias("source"),
        "event_id", "reading",
    )
    bad = df.where((F.col("event_id") % 41 == 0) & (F.col("event_id") % 20 == 0))
    return delimited.isolate_bad_sources(df, bad, "source")[1]


# Sinks.
for policy, shown, custom in (
    ("true_null", "NULL", None), ("na", "'N/A'", None), ("minus_999", "'-999'", None),
    ("custom", "'none'", "none"),
):

    @query(
        f"sink_missing_{policy}",
        f"""WITH {DIRTY_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(level, {shown}) AS level,
 coalesce(station, {shown}) AS station FROM dirty""",
    )
    def missing(spark, folder, policy=policy, custom=custom):
        df = dirty(spark, folder).select("event_id", "level", "station")
        return sinks.apply_missing(df, policy, custom)


@query(
    "sink_delimited_lines",
    f"""WITH {DIRTY_SQL} SELECT event_id || ',' || CASE WHEN reading = '' THEN '""' ELSE reading END || ','
 || coalesce(station, '') || ',"a ""quoted"", cell"' AS line FROM dirty""",
)
def lines(spark, folder):
    """The lines that the writer leaves in its files, without headers."""
    df = dirty(spark, folder).select(
        "event_id", "reading", "station", F.lit('a "quoted", cell').alias("note")
    )
    path = shared_folder(spark, "lines")
    sinks.write_delimited(df, path)
    written = spark.read.text(path).select(F.col("value").alias("line"))
    return written.where(F.col("line") != ",".join(df.columns))


@query(
    "sink_number_masks",
    """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
 replace(CAST(CAST(round(o_totalprice * 100) AS BIGINT) // 100 AS VARCHAR) || ',' ||
 lpad(CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 AS VARCHAR), 2, '0'), ' ', '') AS price FROM orders""",
)
def masks(spark, folder):
    df = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price")
    )
    return sinks.apply_missing(df, masks={"price": NumberMask("0.00", ",")})


@query(
    "sink_written_and_verified",
    """WITH e AS (SELECT count(*) AS n, count(ts) AS m FROM events)
SELECT 'Column names and order' AS "check", true AS passed, 'expected 4 columns, found 4' AS detail FROM e
UNION ALL SELECT 'No duplicate Index column', true, '' FROM e
UNION ALL SELECT 'Row count', true, 'expected ' || n || ', found ' || n FROM e
UNION ALL SELECT 'Values and null representation', true, '' FROM e
UNION ALL SELECT 'First and last timestamp', m > 0, '' FROM e""",
)
def verified(spark, folder):
    df = table(spark, folder, "events").select(
        F.col("ts").alias("Time"), "event_id", "event_type",
        F.when(F.col("event_id") % 19 != 0, F.col("value")).alias("value"),
    )
    path = shared_folder(spark, "verified")
    sinks.write_delimited(df, path)
    actual = delimited.read_delimited(spark, path, ordinal=None, keep_empty_text=False)
    checks, _ = verify.verify_output(actual, sinks.apply_missing(df))
    counted = F.col("check").isin("Row count", "Column names and order")
    return checks.select("check", "passed", F.when(counted, F.col("detail")).otherwise("").alias("detail"))


@query(
    "scan_row_ordinals",
    """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ordinals, CAST(0 AS BIGINT) AS n_disordered FROM orders""",
)
def ordinals(spark, folder):
    """Ordinals of a scan: one per row, ascending in the order of each partition's rows."""
    o = ordering.with_ordinal(
        table(spark, folder, "orders").select("o_orderkey").sortWithinPartitions("o_orderkey"))
    by_part = Window.partitionBy(F.shiftright("_ord", 33)).orderBy("o_orderkey")
    late = F.col("_ord") <= F.lag("_ord").over(by_part)
    return o.select("_ord", late.alias("late")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("_ord").alias("n_ordinals"),
        F.count_if("late").alias("n_disordered"))


@query(
    "sink_periods_manifest",
    """SELECT strftime(ts, '%Y-%m-%d') AS "day", count(*) AS "rows", min(ts) AS first_timestamp,
 max(ts) AS last_timestamp FROM events GROUP BY 1""",
)
def periods(spark, folder):
    e = table(spark, folder, "events").select(
        "ts", "event_id", "value", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")
    )
    path = shared_folder(spark, "periods")
    sinks.write_periods(e, path, ["day"], ["ts", "event_id"])
    back = spark.read.schema("ts timestamp_ntz, event_id bigint, value double, day string").parquet(path)
    return splitjoin.manifest(back, ["day"], "ts")
