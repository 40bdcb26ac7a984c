"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document is its set of word shingles. Documents with equal sets form a class, which takes part
once. Each class has a sketch of ``COORDINATES`` values filled by rounds of hashed bin placement:
in round i < t every shingle falls into a random bin with the value (i, hash), in round t + j into
bin j, so after 2t rounds at the latest all bins are filled; equal coordinates estimate the
Jaccard similarity with Chernoff-type bounds. Bands of ``ROWS`` coordinates give buckets. With 32
bands of 4, a pair at 0.85 shares no bucket with probability 5e-11, at 0.8 with 5e-8.

No bucket is expanded into all pairs. First every class is verified against one hub (the class
with most copies of its buckets). Links give components. A bucket that still holds several
components is compared in blocks: rows outside the bucket's largest component against all rows of
other components, first by their sketches (one byte a coordinate), then the few that are close by
their full sets, inside a task of which only the links come out. Buckets with the same members are
compared once. Sets are compared as sorted 64-bit shingle hashes.

Defined results: a text without words has an empty set and no links; with fewer words than a
shingle takes, the whole sequence is the one shingle; rows with a null id are left out of the
linking (component null, kept); rows that share an id are linked as one document would be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm import rolling as R
from gridwright.llm.common import (
    arrow_map, documents, id_and_text, longs, stored, text_passes,
)

BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
#: Shingles that one side of a block comparison holds on average.
BLOCK_SHINGLES = 1 << 16
#: Sketches that one side of a block comparison holds on average.
BLOCK_ROWS = 2048
_ROUNDS = R.mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
_COLUMN = R.mix(np.arange(1001, 1001 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and the n + 1 offsets of the rows."""
    low = R.LOWER[raw]
    starts, ends = R.word_bounds(low, at)
    unit_at = np.searchsorted(starts, at)
    values = R.Rolling(R.word_values(low, starts, ends))
    count = np.diff(unit_at)
    shingles = np.where(count == 0, 0, np.maximum(count - k + 1, 1))
    row = np.repeat(np.arange(len(count)), shingles)
    first = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    first += unit_at[row]
    hashes = values.some(first, np.minimum(first + k, unit_at[row + 1]))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    hashes, row = hashes[keep], row[keep]
    return hashes, np.searchsorted(row, np.arange(len(count) + 1))


def sketches(hashes: np.ndarray, at: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """(rows, t) sketch values; rows with an empty set stay at the largest value."""
    rows = len(at) - 1
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(rows * t, empty, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(at))
    for i in range(2 * t):
        if not len(row):
            break
        value = R.mix(hashes + _ROUNDS[i])
        if i < t:
            place = ((value >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        else:
            place = i - t
        packed = (np.uint64(i) << np.uint64(56)) | (R.mix(value) >> np.uint64(8))
        np.minimum.at(out, row * t + place, packed)
        open_rows = (out.reshape(rows, t) == empty).any(axis=1)
        go = open_rows[row]
        hashes, row = hashes[go], row[go]
    return out.reshape(rows, t)


def described(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, s1, s2, bands, sketch): the set's size, its fingerprint, its buckets
    and one byte of each sketch value. Rows whose set a smaller id of their batch has leave the
    bands and the sketch out."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        null = np.asarray(batch.column(0).is_null())
        ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        seen: set[tuple[int, int]] = set()
        for first, last, raw, at in text_passes(batch):
            hashes, set_at = shingle_sets(raw, at, k)
            size = np.diff(set_at)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(R.mix(hashes))))
            other = np.concatenate(
                (np.zeros(1, np.uint64), np.cumsum(R.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))))
            )
            s1 = R.mix(total[set_at[1:]] - total[set_at[:-1]] + size.astype(np.uint64))
            s2 = other[set_at[1:]] - other[set_at[:-1]]
            fresh = np.zeros(last - first, bool)
            for i in np.lexsort((ids[first:last],)):
                mark = (int(s1[i]), int(s2[i]))
                if size[i] and not null[first + i] and mark not in seen:
                    seen.add(mark)
                    fresh[i] = True
            pick = np.flatnonzero(fresh)
            lengths = size[pick]
            flat = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            flat += np.repeat(set_at[:-1][pick], lengths)
            sketch = sketches(hashes[flat], np.concatenate(([0], np.cumsum(lengths))))
            bands = R.mix(
                (sketch * _COLUMN).reshape(len(pick), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
            )
            place = np.concatenate(([0], np.cumsum(fresh * BANDS)))
            narrow = (sketch & np.uint64(255)).astype(np.uint8)
            short = np.full(last - first, None, object)
            short[pick] = [row.tobytes() for row in narrow]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[first:last], mask=null[first:last]),
                    pa.array(size.astype(np.int64)), longs(s1), longs(s2),
                    pa.ListArray.from_arrays(
                        pa.array(place.astype(np.int32)), longs(bands.reshape(-1))
                    ),
                    pa.array(short, pa.binary()),
                ],
                ["doc_id", "n_shingles", "s1", "s2", "bands", "sketch"],
            )

    return arrow_map(
        docs.select("doc_id", "text"), work,
        "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, sketch binary",
    )


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over (a, b) links; large-star and small-star
    rounds until nothing changes, each written to the shared folder."""
    edges = stored(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges if not larger else edges.unionByName(edges.select(
            F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if larger:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))

    def state(edges: DataFrame):
        return tuple(edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    while before[0]:
        edges = star(edges, True).where("a != b").distinct()
        edges = stored(star(edges, False).where("a != b").distinct(), "links")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _similar(common, size_a, size_b, percent: int):
    return 100 * common >= percent * (size_a + size_b - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            x = np.frombuffer(left.as_buffer(), np.uint64)
            y = np.frombuffer(right.as_buffer(), np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            if 100 * len(small) < percent * len(large):
                keep.append(False)
                continue
            at = np.minimum(np.searchsorted(large, small), len(large) - 1)
            keep.append(bool(_similar((large[at] == small).sum(), len(x), len(y), percent)))
        yield batch.select([0, 1]).filter(pa.array(keep))

    one = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    # Few hubs have many pairs; adaptive skew handling splits them.
    two = one.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return arrow_map(two.select("a", "b", "x", "y"), work, "a long, b long")


def in_blocks(members: DataFrame, weight, per_block: int) -> DataFrame:
    """Deal the members of buckets with several components into block pairs (i, j): rows outside
    the bucket's main component (``outer``) meet all rows of the bucket. A block holds rows of
    about ``per_block`` weight."""
    of_part = members.groupBy("bucket", "component").agg(F.sum(weight).alias("weight"))
    most = F.max(F.struct("weight", "component"))
    of_bucket = of_part.groupBy("bucket").agg(
        most["component"].alias("main"), most["weight"].alias("main_weight"),
        F.sum("weight").alias("all_weight"), F.count(F.lit(1)).alias("parts"))
    many = of_bucket.where("parts > 1")
    blocks = lambda c: F.greatest(
        F.lit(1), F.ceil(c / F.lit(per_block)).cast("int"))
    placed = members.join(many, "bucket").select(
        "bucket", "node", "component", "main", blocks(F.col("all_weight")).alias("n_all"),
        blocks(F.col("all_weight") - F.col("main_weight")).alias("n_out"),
    )
    h = F.xxhash64("node")
    own_all, own_out = F.pmod(h, "n_all").cast("int"), F.pmod(h, "n_out").cast("int")
    # As one of all rows: to each outer block. As an outer row: to each block of all rows.
    as_any = placed.select(
        "bucket", "node", "component", own_all.alias("i"), F.lit(False).alias("outer"),
        F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("j"))
    as_outer = placed.where("component != main").select(
        "bucket", "node", "component",
        F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("i"),
        F.lit(True).alias("outer"), own_out.alias("j"))
    return as_any.unionByName(as_outer)


def close_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The members whose sketch agrees with one of another component of their bucket in at least
    as many coordinates as a pair at the threshold does, less six standard deviations: such a pair
    is missed with a probability of about 1e-9."""
    share = percent / 100
    least = COORDINATES * share - 6 * (COORDINATES * share * (1 - share)) ** 0.5

    def close(key, table):
        outer = np.asarray(table.column("outer"))
        part = np.asarray(table.column("component"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(
            len(part), COORDINATES)
        hit = np.zeros(len(part), bool)
        inner = np.flatnonzero(~outer)
        for i in np.flatnonzero(outer):
            same = (sketch[inner] == sketch[i]).sum(axis=1)
            near = inner[(same >= least) & (part[inner] != part[i])]
            hit[near] = True
            hit[i] = len(near) > 0
        return table.select(["bucket", "node"]).filter(pa.array(hit))

    dealt = in_blocks(members, F.lit(1), BLOCK_ROWS).join(sketches, "node").select(
        "bucket", "i", "j", "outer", "node", "component", "sketch")
    found = dealt.groupBy("bucket", "i", "j").applyInArrow(close, "bucket long, node long")
    return members.join(found.distinct(), ["bucket", "node"], "left_semi")


def block_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components of one bucket. ``members``: bucket, node, component."""
    dealt = in_blocks(members, F.col("n_shingles"), BLOCK_SHINGLES).join(sets, "node").select(
        "bucket", "i", "j", "outer", "node", "component", "shingles")

    def compare(key, table):
        outer = np.asarray(table.column("outer"))
        node, part = np.asarray(table.column("node")), np.asarray(table.column("component"))
        values = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        inner = np.flatnonzero(~outer)
        sizes = np.array([len(values[i]) for i in inner])
        a, b = [], []
        if len(inner):
            flat = np.concatenate([values[i] for i in inner])
            edges = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            for i in np.flatnonzero(outer):
                mine = values[i]
                at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
                common = np.add.reduceat((mine[at] == flat).astype(np.int64), edges)
                hit = _similar(common, sizes, len(mine), percent) & (part[inner] != part[i])
                # One link to each other component is enough.
                _, once = np.unique(part[inner][hit], return_index=True)
                a += [part[i]] * len(once)
                b += list(part[inner][hit][once])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def linked(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; links where
    100 * |A and B| >= percent * |A or B| of the distinct k-word shingles."""
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("a shingle has at least one word, a similarity is above 0 up to 100")
    rows = stored(described(docs, k), "described")
    classes = stored(
        rows.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
            F.count(F.lit(1)).alias("copies"),
            F.max_by("bands", F.size("bands")).alias("bands"),
            F.max_by("sketch", F.size("bands")).alias("sketch")),
        "classes")
    banded = classes.select("node", "copies", "n_shingles", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("copies", "node"))["node"].alias("hub"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("n > 1")
    # A bucket with the same members as another one is the same work: one of them stays.
    shared = shared.groupBy("members", "n").agg(
        F.min(F.struct("bucket", "hub")).alias("b")).select("b.bucket", "b.hub")
    buckets = stored(
        banded.join(shared, "bucket").select("bucket", "hub", "node", "copies", "n_shingles"),
        "buckets")
    first = buckets.where("node != hub").groupBy("node").agg(F.min("hub").alias("hub"))
    wanted = buckets.select("node").distinct()

    def set_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, raw, at in text_passes(batch):
            hashes, set_at = shingle_sets(raw, at, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[a:b],
                 pa.array([hashes[x:y].tobytes() for x, y in zip(set_at[:-1], set_at[1:])],
                          pa.binary())],
                ["node", "shingles"])

    # The wanted ids grow with the input: the same sort-merge join at every size.
    texts = docs.select(F.col("doc_id").alias("node"), "text").join(
        wanted.hint("merge"), "node", "left_semi")
    sets = stored(arrow_map(texts, set_rows, "node long, shingles binary"), "sets")
    pairs = first.select(F.col("node").alias("a"), F.col("hub").alias("b"))
    found = components(verified(pairs, sets, percent))

    # A bucket of two whose pair is verified has nothing left to compare.
    hubs = first.withColumnRenamed("hub", "first_hub")
    settled = buckets.join(hubs, "node", "left").groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("first_hub") == F.col("hub")).alias("done"),
    ).where("n = 2 and done = 1").select("bucket")
    unsettled = buckets.join(settled, "bucket", "left_anti")
    members = unsettled.join(found, "node", "left").select(
        "bucket", "node", "n_shingles", F.coalesce("component", "node").alias("component"))
    near = stored(close_members(members, classes.select("node", "sketch"), percent), "near")
    more = components(block_links(near, sets, percent))
    parts = wanted.join(found, "node", "left").select(
        "node", F.coalesce("component", "node").alias("part"))
    labels = parts.join(more.withColumnRenamed("node", "part"), "part", "left").select(
        "node", F.coalesce("component", "part").alias("label"))
    by_class = classes.select("s1", "s2", "node").join(labels, "node", "left").select(
        "s1", "s2", F.coalesce("label", "node").alias("label"))
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(by_class, ["s1", "s2"], "left")
    label = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("label"))
    return out.select(
        "doc_id", "n_shingles", F.coalesce(label, "doc_id").alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM n UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b),
m AS (SELECT doc_id, min(m) AS m FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.m, t.doc_id) AS component_id,
 coalesce(m.m, t.doc_id) = t.doc_id AS kept FROM t LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def query(spark, folder: str) -> DataFrame:
    return linked(id_and_text(documents(spark, folder)))
