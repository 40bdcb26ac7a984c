"""Substring dedup by words: seed and extend on winnowed anchors.

Documents are joined on the hash of winnowed anchors of ``k`` words, so any two equal windows of
``size`` words meet in the same anchor. The seed is extended both ways to the anchor's block,
the stretch of all windows that choose it. Equal blocks are settled by the join. Where blocks
with one anchor differ, because the match ends inside, their windows are compared one by one,
which gives the match's exact ends. Neighbouring windows that go are one maximal repeat.

Defined results: a null or empty text has no words and stays as it is; a null id is neither
smaller nor larger than another, so nothing of such a row is removed; rows with one id are no
copies of each other; words before byte 0x20 other than white space count as words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm import repeats, rolling as R
from gridwright.llm.common import arrow_map, id_and_text, longs, stored, text_passes


def anchors(docs: DataFrame, units: repeats.Units) -> DataFrame:
    """(key, content, doc_id, done): one row per anchor block and batch; ``done`` rows have an
    earlier document with the same block in their batch."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column(0)).astype(np.int64)
        parts = []
        for first, _, raw, at in text_passes(batch):
            _, _, values, unit_at = units.sequence(raw, at)
            found = R.blocks(R.Rolling(values), unit_at, units.size, units.k)
            parts.append((found.key, found.content, ids[first + found.row]))
        key, content, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new, head = repeats.first_of_equal(doc, key, content)
        key, content, doc = key[order], content[order], doc[order]
        new[1:] |= doc[1:] != doc[:-1]
        done = head < doc
        yield pa.RecordBatch.from_arrays(
            [longs(key[new]), longs(content[new]), pa.array(doc[new]), pa.array(done[new])],
            ["key", "content", "doc_id", "done"],
        )

    known_ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return arrow_map(known_ids, work, "key long, content long, doc_id long, done boolean")


def seeds(docs: DataFrame, units: repeats.Units) -> DataFrame:
    """(doc_id, content, kind) of all blocks that go as a whole or are to be compared."""
    rows = stored(anchors(docs, units), "anchors")
    open_rows = rows.where(~F.col("done")).select("key", "content", "doc_id")
    shared = (
        open_rows.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("low"),
             F.max("content").alias("high"))
        .where("n > 1").select("key", (F.col("low") != F.col("high")).alias("differ"))
    )
    # The anchor join: hot keys are split by adaptive skew handling.
    joined = open_rows.join(shared, "key")
    earliest = F.min("doc_id").over(Window.partitionBy("key", "content"))
    met = joined.withColumn("earliest", earliest).select(
        "doc_id", "content",
        F.when(F.col("earliest") < F.col("doc_id"), F.lit(repeats.WHOLE))
        .when(F.col("differ"), F.lit(repeats.PROBE_RIGHT)).alias("kind"),
    ).where("kind is not null")
    local = rows.where("done").select("doc_id", "content", F.lit(repeats.WHOLE).alias("kind"))
    return met.unionByName(local)


def remove_repeats(docs: DataFrame, size: int = 50, k: int = 25) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_units, n_removed, n_spans and kept: the words
    that no window of ``size`` words shared with an earlier document covers."""
    if not 0 < k <= size:
        raise ValueError("an anchor is at least one word and at most a window")
    units = repeats.Units(words=True, size=size, k=k, split=size + 1)
    known = stored(repeats.by_document(seeds(docs, units)), "blocks")
    windows = repeats.probe_windows(docs, known.select("doc_id", "probe_left", "probe_right"), units)
    return repeats.remove(docs, known, repeats.later_windows(windows), units)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY 1),
r AS (SELECT DISTINCT doc_id, i FROM g JOIN f USING (k) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM r),
b AS (SELECT doc_id, list(j) AS gone, count(*) AS n,
 count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM c AS e WHERE e.doc_id = c.doc_id AND e.j = c.j - 1)) AS runs
 FROM c GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, coalesce(runs, 0) AS n_spans,
 sha256(array_to_string(CASE WHEN n IS NULL THEN w
  ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN b USING (doc_id)"""


def query(spark, folder: str) -> DataFrame:
    from gridwright.llm.common import documents

    out = remove_repeats(id_and_text(documents(spark, folder)))
    return out.select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed",
        F.sha2("kept", 256).alias("kept_sha256"), "n_spans",
    )
