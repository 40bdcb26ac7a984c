"""Exact top-k inner products with vector-approximation files.

* **Classes.** Equal vectors form one class with its ``top + 1`` smallest ids; more can never be
  among the best of a query. A vector that a third of all rows share is one candidate.
* **Index.** Classes are dealt to shards of about ``SHARD`` vectors. A shard cuts every dimension
  into ``CELLS`` cells of equal row counts and keeps one byte per component beside the cells' edges.
* **Scan.** Each block of ``QUERIES`` distinct query vectors meets each shard. From the cells alone
  follow a highest and a lowest possible score of every pair. A pair stays if its highest score
  reaches the k-th best lowest score seen so far, later the k-th best of all shards.
* **Reading.** Exact vectors are read in the order of their bound: first the ``FIRST`` best bounded ones
  of each query, then those alone whose bound still reaches the k-th exact score. What is left
  after that cannot be among the best, so the result is certain.

The work is queries times rows by the contract; queries never meet the rows of other lengths.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do
rows with a null id; equal rows count once; rows of one id with different vectors are rows of their own, and
only the query's own row is left out; vectors are compared with those of their length, empty ones
score 0; a score that does not fit a long takes no part; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.llm.common import stored

#: Vectors of a shard, distinct query vectors of a block, cells of a dimension.
SHARD, QUERIES, CELLS = 16_384, 1024, 64
#: Vectors of a shard that one product of matrices takes.
STRIP = 2048
#: Exact vectors of a query that are read at first.
FIRST = 12
#: Copies of a block's results where they meet the query rows, since many rows may share a vector.
COPIES = 16


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): distinct rows with all components as floor(256 x)."""
    wide = table.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    return (
        wide.where(F.col("vec_id").isNotNull() & finite)
        .select("vec_id", F.transform("x", lambda e: F.floor(F.lit(256.0) * e)).alias("v"))
        .distinct())


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def _dealt(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _numbers(column, dims: int) -> np.ndarray:
    """A list column as a matrix."""
    flat = column.combine_chunks().flatten()
    return np.asarray(flat, np.int64).reshape(len(column), dims)


def build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """One shard of the index: slots, cell numbers and each cell's lowest and highest value."""
    dims, shard = (k.as_py() for k in key)
    values = _numbers(rows["v"], dims)
    ordered, size = np.sort(values, axis=0), len(values)
    marks = ordered[np.arange(1, CELLS) * size // CELLS]
    low = np.vstack((ordered[:1], marks))
    high = np.maximum(np.vstack((marks - 1, ordered[-1:])), low)
    cells = np.empty((size, dims), np.uint8)
    for d in range(dims):
        cells[:, d] = np.searchsorted(marks[:, d], values[:, d], side="right")
    return pa.table({
        "dims": pa.array([dims], pa.int64()), "shard": pa.array([shard], pa.int64()),
        "slots": [np.asarray(rows["slot"], np.int64).tobytes()], "cells": [cells.tobytes()],
        "low": [low.tobytes()], "high": [high.tobytes()]})


def pack_queries(key: tuple, rows: pa.Table) -> pa.Table:
    dims, block = (k.as_py() for k in key)
    return pa.table({
        "dims": pa.array([dims], pa.int64()), "block": pa.array([block], pa.int64()),
        "asked": [np.asarray(rows["asked"], np.int64).tobytes()],
        "vectors": [_numbers(rows["v"], dims).tobytes()]})


def scanner(top: int):
    """The scan of one shard for one block of queries."""
    schema = pa.schema([("asked", pa.int64()), ("block", pa.int64()), ("slot", pa.int64()),
                        ("most", pa.float64()), ("least", pa.float64())])

    def scan(key: tuple, shard: pa.Table, queries: pa.Table) -> pa.Table:
        if not shard.num_rows or not queries.num_rows:
            return schema.empty_table()
        dims, _, block = (k.as_py() for k in key)
        get = lambda table, name, kind: np.frombuffer(table[name][0].as_py(), kind)
        slots, asked = get(shard, "slots", np.int64), get(queries, "asked", np.int64)
        cells = get(shard, "cells", np.uint8).reshape(len(slots), dims)
        low = get(shard, "low", np.int64).reshape(CELLS, dims).astype(np.float64)
        high = get(shard, "high", np.int64).reshape(CELLS, dims).astype(np.float64)
        wanted = get(queries, "vectors", np.int64).reshape(len(asked), dims).astype(np.float64)
        middle, half, size = (low + high) / 2, (high - low) / 2, np.abs(wanted)
        # Room for rounding where sums leave the exact range of doubles.
        room = (size @ np.maximum(np.abs(low), np.abs(high)).max(axis=0))[:, None] * dims * 2.0**-50
        best = np.full((len(asked), top), -np.inf)
        dimension, kept = np.arange(dims), []
        for first in range(0, len(slots), STRIP):
            strip = cells[first : first + STRIP]
            score = wanted @ middle[strip, dimension].T
            reach = size @ half[strip, dimension].T + room
            least = score - reach
            if least.shape[1] > top:
                strongest = np.partition(least, -top, axis=1)[:, -top:]
            else:
                strongest = least
            best = np.sort(np.concatenate((best, strongest), axis=1), axis=1)[:, -top:]
            most = score + reach
            query, row = np.nonzero(most >= best[:, :1])
            kept.append((query, row + first, most[query, row], least[query, row]))
        query, row, most, least = (np.concatenate(x) for x in zip(*kept, strict=True))
        stay = most >= best[query, 0]
        return pa.Table.from_arrays(
            [pa.array(asked[query[stay]]), pa.array(np.full(stay.sum(), block, np.int64)),
             pa.array(slots[row[stay]]), pa.array(most[stay]), pa.array(least[stay])],
            schema=schema)

    return scan


def candidates(classes: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(asked, block, slot, most, least) of the pairs that the cells of all shards leave open."""
    shards, blocks = _blocks(classes.count(), SHARD), _blocks(queries.count(), QUERIES)
    index = stored(
        classes.select(F.size("v").cast("long").alias("dims"), "slot", "v",
                       _dealt("slot", shards).alias("shard"))
        .groupBy("dims", "shard").applyInArrow(
            build_shard, "dims long, shard long, slots binary, cells binary, low binary, high binary"),
        "cells")
    packed = (
        queries.select(F.size("v").cast("long").alias("dims"), "asked", "v",
                       _dealt("asked", blocks).alias("block"))
        .groupBy("dims", "block").applyInArrow(
            pack_queries, "dims long, block long, asked binary, vectors binary"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    on = ("dims", "shard", "block")
    return (
        index.withColumn("block", every(blocks)).groupBy(*on)
        .cogroup(packed.withColumn("shard", every(shards)).groupBy(*on))
        .applyInArrow(scanner(top), "asked long, block long, slot long, most double, least double"))


def exact(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """(asked, score, vec_id, same): exact scores of all ids of the paired classes. A vector is sent
    once to each block of queries that asks for it."""
    needed = pairs.select("slot", "block").distinct()
    read = classes.join(needed, "slot").select("slot", "block", F.col("v").alias("w"), "ids")
    product = F.aggregate(
        F.zip_with("v", "w", lambda a, b: F.try_multiply(a, b)), F.lit(0).cast("long"),
        lambda total, x: F.try_add(total, x))
    return (
        pairs.select("asked", "block", "slot").join(queries, "asked").join(read, ["slot", "block"])
        .select("asked", product.alias("score"), F.explode("ids").alias("vec_id"),
                (F.col("v") == F.col("w")).alias("same"))
        .where("score is not null"))


def best_of(scores: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id", "same")
    return scores.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def nearest(rows: DataFrame, wanted: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best partners of the rows (vec_id, v) that are
    ``wanted``."""
    top = k + 1  # the query itself may be one of them
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    classes = stored(
        rows.withColumn("nth", nth).where(F.col("nth") <= top)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .withColumn("slot", F.monotonically_increasing_id()), "classes")
    asking = rows.where(wanted)
    queries = stored(
        asking.select("v").distinct().withColumn("asked", F.monotonically_increasing_id()), "queries")

    of_query = Window.partitionBy("asked")
    sure = F.nth_value("least", top).over(
        of_query.orderBy(F.desc("least")).rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))
    place = F.row_number().over(of_query.orderBy(F.desc("most"), "slot"))
    pairs = stored(
        candidates(classes, queries, top).withColumn("sure", sure)
        .where(F.col("sure").isNull() | (F.col("most") >= F.col("sure")))
        .withColumn("place", place), "pairs")
    first = stored(
        best_of(exact(pairs.where(F.col("place") <= FIRST), queries, classes), top), "first")
    bar = first.where(F.col("place") == top).select("asked", F.col("score").alias("bar"))
    rest = (
        pairs.where(F.col("place") > FIRST).join(bar, "asked", "left")
        .where(F.col("bar").isNull() | (F.col("most") >= F.col("bar"))))
    found = best_of(
        first.drop("place").unionByName(exact(rest, queries, classes)), top)
    hits = found.groupBy("asked").agg(
        F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("hits"))

    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))
    answers = hits.join(queries, "asked").select("v", "hits", copy.alias("copy"))
    own = lambda h: (h["vec_id"] == F.col("query_id")) & h["same"]
    return (
        asking.select(F.col("vec_id").alias("query_id"), "v", _dealt("vec_id", COPIES).alias("copy"))
        .join(answers, ["v", "copy"])
        .select("query_id", F.posexplode(
            F.slice(F.filter("hits", lambda h: ~own(h)), 1, k)).alias("rank", "hit"))
        .select("query_id", (F.col("rank") + 1).cast("int").alias("rank"),
                F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")))


SQL = """
WITH w AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding,
 lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
 FROM w AS q JOIN w AS c ON len(q.v) = len(c.v) AND (q.vec_id <> c.vec_id OR q.v <> c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= 5"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored(
        whole_vectors(spark.read.parquet(f"{folder}/embeddings.parquet")), "vectors")
    return nearest(rows, F.col("vec_id") % 50 == 0)
