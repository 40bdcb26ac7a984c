"""Shared steps of the operators that remove passages which an earlier document holds.

A document is a row of units: words, or the bytes of its text. Every window of ``size`` units
belongs to the block of its winnowed anchor (see ``rolling``). A block whose whole content
starts in an earlier document goes as a whole. Blocks that share an anchor but differ are
*probed*: their windows are compared one by one. All answers name contents by hash, so a
document id may come in several rows, and repeated passages of one document are all met.

Anchors and windows are reduced inside each Arrow batch before they are shuffled: of equal ones
the smallest id goes on, the others have their answer at once. A passage that a third of all
documents share therefore costs a row per batch, not a row per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm import rolling as R
from gridwright.llm.common import arrow_map, longs, text_bytes, passes

#: What is known of a block: it goes as a whole; windows whose anchor lies at least / less than
#: ``split`` units behind their start are to be compared.
WHOLE, PROBE_LEFT, PROBE_RIGHT = 1, 2, 4
#: Bits of a hash by which lists of hashes are first searched.
LOW_BITS = (1 << 18) - 1


@dataclass(frozen=True)
class Units:
    """What a unit is, the window's length, the anchor's length and the probe's split point."""

    words: bool
    size: int
    k: int
    split: int

    def sequence(self, raw: np.ndarray, at: np.ndarray):
        """(unit starts, unit ends, unit values, unit offsets of the rows)."""
        if not self.words:
            return None, None, R.BYTE_VALUES[raw], at
        starts, ends = R.word_bounds(raw, at)
        return starts, ends, R.word_values(raw, starts, ends), np.searchsorted(starts, at)

    def second(self, raw: np.ndarray, starts, ends, values: np.ndarray) -> np.ndarray:
        """Unit values of the second lane."""
        return R.word_values(raw, starts, ends, 1) if self.words else values


def first_of_equal(row_id: np.ndarray, *keys: np.ndarray):
    """Sort by the keys, then by id. Returns (order, new group marks, first id of the group)."""
    # Most first keys are single: only the others are sorted by all keys.
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = first[1:] == first[:-1]
    tied = np.flatnonzero(same[1:] | same[:-1])
    part = order[tied]
    order[tied] = part[np.lexsort((row_id[part], *[k[part] for k in keys[::-1]]))]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(new) - 1
    return order, new, row_id[order][new][group] if len(order) else row_id[order]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an array column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(column.flatten()).astype(np.int64, copy=False)
    return flat, np.concatenate(([0], np.cumsum(lengths)))


def _window_starts(found: R.Blocks, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All window starts of the picked blocks, and the index of each one's block."""
    first, count = found.first[pick], (found.last - found.first)[pick] + 1
    block = np.repeat(np.flatnonzero(pick), count)
    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(first, count) + shift, block


def _member(values: np.ndarray, rows: np.ndarray, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each value is in the list of its row."""
    out = np.zeros(len(values), bool)
    if not len(flat):
        return out
    # Low bits of the hashes leave few values; these are looked up among all lists, then by row.
    low = np.zeros(LOW_BITS + 1, bool)
    low[flat & LOW_BITS] = True
    near = np.flatnonzero(low[values & LOW_BITS])
    known, place = np.unique(flat, return_inverse=True)
    at_known = np.minimum(np.searchsorted(known, values[near]), len(known) - 1)
    hit = known[at_known] == values[near]
    near, at_known = near[hit], at_known[hit]
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[near] = np.isin(at_known * len(at) + rows[near], place * len(at) + of)
    return out


def probe_windows(docs: DataFrame, known: DataFrame, units: Units) -> DataFrame:
    """(w1, w2, doc_id, done) of the windows to compare. ``done`` ones are known to go: the
    batch holds an earlier document with the window."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column(0).fill_null(0)).astype(np.int64)
        raw, at = text_bytes(batch.column(1))
        left, left_at = _lists(batch.column(2))
        right, right_at = _lists(batch.column(3))
        kept = []
        wanted = (np.diff(left_at) + np.diff(right_at)) > 0
        for first, last in passes(at):
            if not wanted[first:last].any():
                continue
            text = raw[at[first] : at[last]]
            starts, ends, values, unit_at = units.sequence(text, at[first : last + 1] - at[first])
            lane = R.Rolling(values, 0)
            other = R.Rolling(units.second(text, starts, ends, values), 1)
            found = R.blocks(lane, unit_at, units.size, units.k)
            content = found.content.view(np.int64)
            is_left = _member(
                content, found.row, left[left_at[first] : left_at[last]],
                left_at[first : last + 1] - left_at[first],
            )
            is_right = _member(
                content, found.row, right[right_at[first] : right_at[last]],
                right_at[first : last + 1] - right_at[first],
            )
            start, block = _window_starts(found, is_left | is_right)
            behind = found.anchor[block] - start >= units.split
            use = np.where(behind, is_left[block], is_right[block])
            start, block = start[use], block[use]
            kept.append(
                (
                    ids[first + found.row[block]],
                    lane.some(start, start + units.size),
                    other.some(start, start + units.size),
                )
            )
        if not kept:
            return
        doc, w1, w2 = (np.concatenate(x) for x in zip(*kept, strict=True))
        order, new, head = first_of_equal(doc, w1, w2)
        doc, w1, w2 = doc[order], w1[order], w2[order]
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        done = head < doc
        for a in range(0, len(doc), 100_000):
            part = np.flatnonzero(fresh[a : a + 100_000]) + a
            yield pa.RecordBatch.from_arrays(
                [longs(w1[part]), longs(w2[part]), pa.array(doc[part]), pa.array(done[part])],
                ["w1", "w2", "doc_id", "done"],
            )

    joined = docs.select("doc_id", "text").join(known, "doc_id", "left")
    return arrow_map(
        joined.select("doc_id", "text", "probe_left", "probe_right"), work,
        "w1 long, w2 long, doc_id long, done boolean",
    )


def by_document(found: DataFrame) -> DataFrame:
    """(doc_id, content, kind bits) rows as one row of lists per document."""

    def having(bit: int, name: str):
        kept = F.when(F.col("kind").bitwiseAND(F.lit(bit)) != 0, F.col("content"))
        return F.collect_set(kept).alias(name)

    return found.groupBy("doc_id").agg(
        having(WHOLE, "whole"), having(PROBE_LEFT, "probe_left"),
        having(PROBE_RIGHT, "probe_right"),
    )


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, windows): the windows of each document that an earlier one holds."""
    place = F.when(F.col("done"), F.xxhash64("doc_id", "w1")).otherwise(F.col("w1"))
    group = Window.partitionBy("place", "w2", "done")
    earliest = F.min("doc_id").over(group)
    rows = windows.withColumn("place", place).withColumn("earliest", earliest)
    return (
        rows.where(F.col("done") | (F.col("earliest") < F.col("doc_id")))
        .groupBy("doc_id").agg(F.collect_set("w1").alias("windows"))
    )


def remove(docs: DataFrame, known: DataFrame, windows: DataFrame, units: Units) -> DataFrame:
    """Documents without the passages: n_units, n_removed, n_spans, kept (words joined by one space,
    or the remaining bytes) and every column of ``docs`` but those that have such a name, ``whole``
    or ``windows``."""
    docs = docs.drop("n_units", "n_removed", "n_spans", "kept", "whole", "windows")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, at = text_bytes(batch.column(batch.schema.get_field_index("text")))
        whole, whole_at = _lists(batch.column(batch.schema.get_field_index("whole")))
        late, late_at = _lists(batch.column(batch.schema.get_field_index("windows")))
        wanted = (np.diff(whole_at) + np.diff(late_at)) > 0
        rows = batch.num_rows
        size, gone, spans = (np.zeros(rows, np.int64) for _ in range(3))
        kept: list[bytes] = []
        for first, last in passes(at):
            text, text_at = raw[at[first] : at[last]], at[first : last + 1] - at[first]
            starts, ends, values, unit_at = units.sequence(text, text_at)
            size[first:last] = np.diff(unit_at)
            plain = text.tobytes()
            covered = None
            if wanted[first:last].any():
                lane = R.Rolling(values, 0)
                found = R.blocks(lane, unit_at, units.size, units.k)
                full = _member(
                    found.content.view(np.int64), found.row,
                    whole[whole_at[first] : whole_at[last]],
                    whole_at[first : last + 1] - whole_at[first],
                )
                start, block = _window_starts(found, ~full & wanted[first:last][found.row])
                one = _member(
                    lane.some(start, start + units.size).view(np.int64), found.row[block],
                    late[late_at[first] : late_at[last]],
                    late_at[first : last + 1] - late_at[first],
                )
                covered = R.cover(
                    lane.size,
                    np.concatenate((found.first[full], start[one])),
                    np.concatenate((found.last[full], start[one])) + units.size,
                )
            for row in range(last - first):
                mine = slice(unit_at[row], unit_at[row + 1])
                if covered is None or not wanted[first + row] or not covered[mine].any():
                    whole_row = plain[text_at[row] : text_at[row + 1]]
                    kept.append(b" ".join(whole_row.split()) if units.words else whole_row)
                    continue
                hidden = covered[mine]
                gone[first + row] = hidden.sum()
                spans[first + row] = len(R.runs(hidden)[0])
                if units.words:
                    left = np.flatnonzero(~hidden) + mine.start
                    kept.append(b" ".join([plain[starts[i] : ends[i]] for i in left]))
                else:
                    kept.append(text[mine][~hidden].tobytes())
        out = {
            n: batch.column(i)
            for i, n in enumerate(batch.schema.names)
            if n not in ("whole", "windows")
        }
        out["n_units"], out["n_removed"], out["n_spans"] = map(pa.array, (size, gone, spans))
        out["kept"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_pydict(out)

    joined = docs.join(known.select("doc_id", "whole"), "doc_id", "left").join(
        windows, "doc_id", "left"
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(
        joined.select(*docs.columns, "whole", "windows"), work,
        f"{schema}, n_units long, n_removed long, n_spans long, kept binary",
    )
