"""Ordered work without one task per series.

Consecutive-row logic is cut by the values of the order column: a *chunk* is a range of values
as wide as the wanted row count, so a chunk of unique whole numbers never holds more rows than
that, however sparse, clustered or far out the values are. Nothing is estimated and the table is
not read for it. Chunks form a tree: a level's summaries (counts, or first and last rows) are dealt by
wider and wider ranges, and the widest leave at most some thousands to one task. A key that owns
a third of the data is therefore spread over many tasks, and sparse values cost two more
shuffles of summaries instead of one long window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from gridwright.functions.names import col, cols, dtype, require

CHUNK_ROWS = 1 << 20
#: Summaries that the widest ranges of 64-bit values leave to one task, as a power of two.
TOP_BITS = 12


def with_ordinal(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Source-order id at scan: unique, ascending inside a file, dense inside a partition."""
    return df.withColumn(name, F.monotonically_increasing_id())


def order_number(df: DataFrame, order: str) -> Column:
    """A BIGINT that never falls where ``order`` rises, and differs where whole numbers do."""
    kind, value = dtype(df, order), col(order)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return value.cast("bigint")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value.cast("decimal(38,18)") * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint")
    # The bits of a double rise with it, but fall for negative ones.
    bits = F.java_method(
        F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + 0.0).cast("bigint")
    return F.when(value.isNotNull(), F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits))


def with_chunk(
    df: DataFrame, order: str, rows: int = CHUNK_ROWS, name: str = "__chunk"
) -> DataFrame:
    """Append a chunk number that never falls along the order column; a chunk holds at most
    ``rows`` different whole numbers."""
    placed = df.withColumn(name, order_number(df, order))
    return placed.withColumn(name, F.expr(_range_of(name, rows)))


def _range_of(number: str, width: int) -> str:
    """Floor division as SQL text that also holds for the lowest BIGINTs."""
    return f"({number} DIV {width}L - CAST({number} < 0 AND {number} % {width}L != 0 AS BIGINT))"


def _fan(rows: int) -> int:
    """Chunks in a range of the next level, so that two levels leave ``TOP_BITS`` bits."""
    left = max(0, 64 - TOP_BITS - (rows.bit_length() - 1))
    return 1 << -(-left // 2)


def _lookup(rows: DataFrame, facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """Join one-row-per-group facts to rows; null keys meet as well."""
    right = facts.select(*[col(k).alias(f"__on{i}") for i, k in enumerate(on)],
                         *[c for c in facts.columns if c not in on])
    same = [col(k).eqNullSafe(col(f"__on{i}")) for i, k in enumerate(on)]
    return rows.join(right, same).drop(*[f"__on{i}" for i in range(len(on))])


def chunk_offsets(
    chunked: DataFrame, keys: Sequence[str] = (), rows: int = CHUNK_ROWS
) -> DataFrame:
    """``keys, __chunk, __n, __before``: rows of each chunk and rows of the key before it.

    Prefix sums climb three levels: inside ranges of chunks, ranges of ranges, and the key."""
    fan, named = _fan(rows), cols(keys)
    table = chunked.groupBy(*named, "__chunk").agg(F.count("*").alias("__n")).withColumnRenamed(
        "__chunk", "__r0")
    tables = []
    for level in range(3):
        above = f"__r{level + 1}"
        if level < 2:
            table = table.selectExpr("*", f"{_range_of(f'__r{level}', fan)} AS {above}")
        group = ", ".join([*named, *([above] if level < 2 else [])]) or "1"
        before = (f"coalesce(sum(__n) OVER (PARTITION BY {group} ORDER BY __r{level} "
                  "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
        tables.append(table.selectExpr("*", f"{before} AS __b{level}"))
        if level < 2:
            table = table.groupBy(*named, above).agg(F.sum("__n").alias("__n"))
    upper = _lookup(tables[1].drop("__n"), tables[2].drop("__n"), [*keys, "__r2"])
    whole = _lookup(tables[0], upper.drop("__r2"), [*keys, "__r1"])
    return whole.selectExpr(
        *named, "__r0 AS __chunk", "__n", "__b0 + __b1 + __b2 AS __before")


def successive_pairs(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    carry: Sequence[str],
    *,
    width: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows ``keys, prev, next``: every pair of neighbours in order, as structs of ``carry``.

    ``order`` must be unique within a key. Pairs inside a chunk come from a window over it; its
    first and last rows go on to the next wider range, and so on up to the key."""
    require(df, *keys, order, *carry)
    fan = _fan(width)
    named = cols(keys)
    rows = with_chunk(
        df.select(*named, col(order).alias("__o"), F.struct(*cols(carry)).alias("__c")), "__o", width,
        name="__r0")
    # SQL text: hundreds of expression objects would take longer to make than small tables to read.
    found = None
    for level in range(4):
        group = ", ".join([*named, *([f"__r{level}"] if level < 3 else [])]) or "1"
        inside = f"OVER (PARTITION BY {group} ORDER BY __o)"
        lacking = "true" if level == 0 else "__lacks"
        rows = rows.selectExpr(
            *named, "__o", "__c", *([f"__r{level}"] if level < 3 else []), f"{lacking} AS __lacked",
            f"lag(__c) {inside} AS prev", f"lead(__o) {inside} IS NULL AS __closes")
        pairs = rows.where("__lacked AND prev IS NOT NULL").selectExpr(*named, "prev", "__c AS next")
        found = pairs if found is None else found.unionByName(pairs)
        if level == 3:
            break
        # Both ends of a range meet others; only its first row still lacks the row before it.
        rows = rows.where("prev IS NULL OR __closes").selectExpr(
            *named, "__o", "__c", "__lacked AND prev IS NULL AS __lacks",
            *([f"{_range_of(f'__r{level}', fan)} AS __r{level + 1}"] if level < 2 else []))
    return found


def with_position(
    df: DataFrame,
    order: str,
    output: str,
    *,
    keys: Sequence[str] = (),
    start: int = 1,
    width: int = CHUNK_ROWS,
) -> DataFrame:
    """Append a contiguous 1, 2, 3 … position along a unique column.

    Chunk counts give each chunk its offset, so numbering needs one shuffle by (keys, chunk)
    and no global sort.
    """
    require(df, order, *keys)
    rows = with_chunk(df, order, width)
    offsets = chunk_offsets(rows, keys, width).drop("__n")
    inside = Window.partitionBy(*cols(keys), col("__chunk")).orderBy(col(order))
    numbered = rows.withColumn("__place", F.row_number().over(inside))
    joined = _lookup(numbered, offsets, [*keys, "__chunk"])
    position = col("__place") + col("__before") + F.lit(start - 1)
    return joined.select(*cols(df.columns), position.cast("bigint").alias(output))


def salted(df: DataFrame, by: Column, buckets: int, name: str = "__salt") -> DataFrame:
    return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))


def replicated(df: DataFrame, buckets: int, name: str = "__salt") -> DataFrame:
    """Repeat a small side once per salt bucket."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))


def join_members(
    rows: DataFrame, groups: DataFrame, on: Sequence[str], spread: Column, buckets: int = 16
) -> DataFrame:
    """Inner join of rows with one-row-per-group facts, salted so that a group of copies
    holding a large share of the rows is worked on by many tasks."""
    joined = salted(rows, spread, buckets).join(
        replicated(groups, buckets), [*on, "__salt"], "inner"
    )
    return joined.drop("__salt")


def with_single_row(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Append the columns of a one-row frame to every row; no rows when it is empty.

    The facts are a scalar subquery: worked out once and shipped as a literal.
    """
    names = facts.columns
    value = facts.select(F.struct(*cols(names)).alias("__facts")).scalar()
    joined = rows.select("*", value.alias("__facts")).where(F.col("__facts").isNotNull())
    return joined.select(
        *cols(rows.columns), *[F.col(f"__facts.`{n}`").alias(n) for n in names]
    )


def refused_if_any(rows: DataFrame, found: DataFrame, kind: str) -> DataFrame:
    """``rows``, which raise when they are worked out if ``found`` has any row. The count is a
    scalar subquery of the same query: no job runs before."""
    n = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    message = F.concat(F.lit(f"{kind}: "), n.cast("string"))
    return rows.where(F.when(n > 0, F.raise_error(message).cast("boolean")).otherwise(True))
