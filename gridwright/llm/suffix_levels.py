"""Substring dedup by bytes on a logarithmic family of suffix arrays.

Suffixes are sampled at winnowed anchors, so that any two equal windows of ``size`` bytes have
their anchor at the same place. A sampled suffix is one 64-bit key (anchor, bytes before it,
bytes from it on) plus the hash of its block, the stretch of all windows that choose the anchor.
Spark deals the suffixes out by anchor. Within a part they come in the order of document ids, in
batches. Each new batch is sorted (its suffix array), merge-scanned against the levels that are
there for long matches, and then becomes a level; levels of equal size merge, so a part with n
batches has at most log2(n) + 1 of them and each suffix moves log2(n) times.

A long match reaches at least ``size`` bytes over its anchor, so its suffixes agree either in the
``split`` bytes before the anchor or in the ``size - split + 1`` bytes from the anchor on. An
equal block of an earlier document settles a block as a whole; other matches are compared window
by window. Matches never cross documents.

A common anchor with very many different blocks in one Arrow batch (``HOT``) is not sent: its
blocks are compared window by window at once and one marker row makes all others of that anchor
do the same. This bounds what an anchor sends to HOT rows per batch and loses nothing.

Defined results: a null text is empty; nothing of a row with a null id is removed, and it removes
nothing elsewhere; rows with one id are no copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import repeats, rolling as R
from gridwright.llm.common import arrow_map, documents, id_and_text, longs, stored, text_passes

#: Different blocks of one anchor in one Arrow batch from which on the anchor is hot.
HOT = 1024
#: Suffixes that make a new batch.
BATCH_ROWS = 1 << 16
#: Row kinds on their way to the levels; the first two are bits of repeats.
OPEN, MARKER = 0, 8
BOTH = repeats.PROBE_LEFT | repeats.PROBE_RIGHT
_16 = np.uint64(16)


def suffixes(docs: DataFrame, units: repeats.Units) -> DataFrame:
    """(key, content, doc_id, kind): one row per block and batch; rows that the batch settles
    carry their answer as kind."""
    ahead = units.size - units.split + 1

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = np.asarray(batch.column(0)).astype(np.int64)
        parts = []
        for first, _, raw, at in text_passes(batch):
            lane = R.Rolling(R.BYTE_VALUES[raw])
            found = R.blocks(lane, at, units.size, units.k)
            # A side that no window of the block covers is filled from the block's own hash: equal
            # blocks have equal keys wherever they stand, and such a side meets no other one.
            left = found.anchor - found.first >= units.split
            right = found.anchor - found.last < units.split
            before = np.where(
                left, lane.some(found.anchor - units.split * left, found.anchor), found.content
            )
            after = np.where(
                right, lane.some(found.anchor, found.anchor + ahead * right),
                found.content << _16,
            )
            key = (
                (found.key & np.uint64(0xFFFFFFFF00000000))
                | ((before >> np.uint64(48)) << _16)
                | (after >> np.uint64(48))
            )
            parts.append((key, found.content, ids[first + found.row]))
        key, content, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new, head = repeats.first_of_equal(doc, key, content)
        key, content, doc = key[order], content[order], doc[order]
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        kind = np.where(head < doc, repeats.WHOLE, OPEN).astype(np.int8)
        anchor = key >> np.uint64(32)
        _, group, count = np.unique(anchor, return_inverse=True, return_counts=True)
        opened = np.bincount(group, weights=new & (kind == OPEN), minlength=len(count)) > HOT
        hot = opened[group] & (kind == OPEN)
        kind[hot] = BOTH
        key, content, doc, kind = (x[fresh] for x in (key, content, doc, kind))
        if opened.any():
            mark = np.flatnonzero(opened)
            where = np.searchsorted(anchor, np.unique(anchor)[mark])
            key = np.concatenate((key, (anchor[where] << np.uint64(32))))
            content = np.concatenate((content, np.zeros(len(mark), np.uint64)))
            doc = np.concatenate((doc, np.full(len(mark), np.iinfo(np.int64).min)))
            kind = np.concatenate((kind, np.full(len(mark), MARKER, np.int8)))
        yield pa.RecordBatch.from_arrays(
            [longs(key), longs(content), pa.array(doc), pa.array(kind)],
            ["key", "content", "doc_id", "kind"],
        )

    known_ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return arrow_map(known_ids, work, "key long, content long, doc_id long, kind byte")


class Level:
    """A sorted run of suffixes: one per block, with the first document that has it."""

    def __init__(self, key, content, doc, seen):
        order = np.lexsort((content, key))
        self.key, self.content, self.doc, self.seen = (
            x[order] for x in (key, content, doc, seen)
        )
        self.left = self.key >> _16  # sorted as well
        right = self._right(self.key)
        self.by_right = np.argsort(right, kind="stable")
        self.right = right[self.by_right]

    @staticmethod
    def _right(key: np.ndarray) -> np.ndarray:
        return (key & np.uint64(0xFFFFFFFF00000000)) | (key & np.uint64(0xFFFF))

    def __len__(self) -> int:
        return len(self.key)

    def merge(self, other: Level) -> Level:
        return Level(*(
            np.concatenate((getattr(self, n), getattr(other, n)))
            for n in ("key", "content", "doc", "seen")
        ))

    def equal(self, key: np.ndarray, content: np.ndarray) -> np.ndarray:
        """Place of the equal suffix, or -1."""
        at = np.full(len(key), -1, np.int64)
        if not len(self):
            return at
        lo = np.searchsorted(self.key, key, "left")
        hi = np.searchsorted(self.key, key, "right")
        # Blocks of one key are sorted by content: few, so step through them together.
        todo = np.flatnonzero(lo < hi)
        low, high = lo[todo], hi[todo]
        while len(todo):
            mid = (low + high) // 2
            value = self.content[mid]
            hit = value == content[todo]
            at[todo[hit]] = mid[hit]
            low = np.where(value < content[todo], mid + 1, low)
            high = np.where(value > content[todo], mid, high)
            go = ~hit & (low < high)
            todo, low, high = todo[go], low[go], high[go]
        return at

    def matches(self, key: np.ndarray, bit: int):
        """(which new suffixes match on one side, places of level suffixes that had no match on
        that side before)."""
        if not len(self):
            return np.zeros(len(key), bool), np.zeros(0, np.int64)
        own, wanted = (
            (self.left, key >> _16) if bit == repeats.PROBE_LEFT else (self.right, self._right(key))
        )
        lo = np.searchsorted(own, wanted, "left")
        found = (lo < len(own)) & (own[np.minimum(lo, len(own) - 1)] == wanted)
        place = np.unique(lo[found])
        if bit == repeats.PROBE_RIGHT:
            place = self.by_right[place]
        # Two suffixes of one side's value are seen already: the later one met the earlier one.
        return found, place[(self.seen[place] & bit) == 0]


class Family:
    """The levels of one part, smallest last."""

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.hot = np.zeros(0, np.uint64)

    def add(self, key, content, doc) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge-scan a batch whose ids are not below those before; yields (doc, content, kind)."""
        order, new, head = repeats.first_of_equal(doc, key, content)
        key, content, doc = key[order], content[order], doc[order]
        later = head < doc
        yield doc[later], content[later], np.full(later.sum(), repeats.WHOLE, np.int8)
        key, content, doc = key[new], content[new], doc[new]
        fresh = np.ones(len(key), bool)
        for level in self.levels:
            at = level.equal(key, content)
            old = at >= 0
            fresh &= ~old
            later = old & (level.doc[at] < doc)
            yield doc[later], content[later], np.full(later.sum(), repeats.WHOLE, np.int8)
        key, content, doc = key[fresh], content[fresh], doc[fresh]
        seen = np.zeros(len(key), np.int8)
        for bit in (repeats.PROBE_LEFT, repeats.PROBE_RIGHT):
            side = key >> _16 if bit == repeats.PROBE_LEFT else Level._right(key)
            _, group, count = np.unique(side, return_inverse=True, return_counts=True)
            met = count[group] > 1
            for level in self.levels:
                found, place = level.matches(key, bit)
                met |= found
                yield level.doc[place], level.content[place], np.full(len(place), bit, np.int8)
                level.seen[place] |= bit
            seen[met] |= bit
        if len(self.hot):
            seen[np.isin(key >> np.uint64(32), self.hot)] |= BOTH
        some = seen > 0
        yield doc[some], content[some], seen[some]
        self.levels.append(Level(key, content, doc, seen))
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            small = self.levels.pop()
            self.levels.append(self.levels.pop().merge(small))


def long_matches(docs: DataFrame, units: repeats.Units) -> DataFrame:
    """(doc_id, content, kind) of all blocks that go as a whole or are to be compared."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, waiting, rows = Family(), [], 0

        def out(doc, content, kind):
            for a in range(0, len(doc), 100_000):
                b = a + 100_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[a:b]), longs(content[a:b]), pa.array(kind[a:b])],
                    ["doc_id", "content", "kind"],
                )

        def flush():
            key, content, doc = (np.concatenate(x) for x in zip(*waiting, strict=True))
            for found in family.add(key, content, doc):
                yield from out(*found)

        for batch in batches:
            key, content, doc, kind = (np.asarray(c) for c in batch.columns)
            key, content = key.view(np.uint64), content.view(np.uint64)
            marks = kind == MARKER
            if marks.any():  # they sort before all others
                family.hot = np.union1d(family.hot, key[marks] >> np.uint64(32))
            done = ~marks & (kind != OPEN)
            yield from out(doc[done], content[done], kind[done])
            is_open = kind == OPEN
            waiting.append((key[is_open], content[is_open], doc[is_open]))
            rows += int(is_open.sum())
            if rows >= BATCH_ROWS:
                yield from flush()
                waiting, rows = [], 0
        if waiting:
            yield from flush()

    anchor = F.shiftrightunsigned("key", 32)
    settled = (F.col("kind") != OPEN) & (F.col("kind") != MARKER)
    dealt = suffixes(docs, units).repartition(
        F.when(settled, F.xxhash64("doc_id", "content")).otherwise(anchor)
    )
    return dealt.sortWithinPartitions((F.col("kind") == MARKER).desc(), "doc_id").mapInArrow(
        scan, "doc_id long, content long, kind byte"
    )


def remove_repeats(docs: DataFrame, size: int = 50, k: int = 12) -> DataFrame:
    """``docs`` (doc_id, text and any others) with n_units, n_removed, n_spans and kept: the bytes
    that no string of ``size`` bytes shared with an earlier document covers."""
    if not 0 < k <= size:
        raise ValueError("an anchor is at least one byte and at most a window")
    units = repeats.Units(words=False, size=size, k=k, split=(size - k) // 2)
    known = stored(repeats.by_document(long_matches(docs, units)), "blocks", tidy=True)
    windows = repeats.probe_windows(docs, known.select("doc_id", "probe_left", "probe_right"), units)
    return repeats.remove(docs, known, repeats.later_windows(windows), units)


def query(spark, folder: str) -> DataFrame:
    out = remove_repeats(id_and_text(documents(spark, folder)))
    return out.select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
