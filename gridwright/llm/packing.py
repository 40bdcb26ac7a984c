"""Packing by lexical retrieval (BM25) over shards of related pieces.

Each document becomes token ids plus one end id. Full windows of a long document are sequences of
their own; what is left (less than a window) is a piece to be packed. BM25 weights use the document
frequencies and the mean length of the whole table; terms in half of the pieces or more have no
weight.

* **Shards.** A bounded sample of ``LEADERS`` pieces stands for the table's topics. Every piece is
  scored against all leaders and sorted by its best and second leader (leaders in a tour from each
  to the most similar one left), then by the smallest hash of its informative terms, so that copies
  are neighbours. Neighbours in this order, ``shard_documents`` at a time, form a shard: all shards
  are of one size, whatever the topics' sizes are, and a piece's lexical neighbours lie in its own.
* **Windows.** A shard has one inverted index. In order, each unused piece becomes a seed; its best
  unused neighbours (its query are all its terms of positive weight) fill the window; where no
  unused piece of the shard scores above 0, the next unused pieces do. The last one is cut at the
  window's end and its rest is a seed later on, so windows are full. A shard's last, partial window
  is written as sequences whose lengths are powers of two, which need no padding.

Work and memory: one pass to cut, one to score against the leaders, one range exchange; a task
holds one shard. The driver sees the frequencies of the vocabulary and the leaders.

Defined results: a null or empty text is the end id alone; each id lies in one piece; rows with
equal ids (null ones too) are packed as separate documents; an empty table gives no pieces; other columns play no
part.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import rolling as R
from gridwright.llm.common import arrow_map, documents, id_and_text, stored

WINDOW, END = 2048, 1
#: Pieces that stand for the topics of a table.
LEADERS = 512
#: Terms in more than this share of the pieces do not tell topics apart.
COMMON = 0.125
K1, B = 1.2, 0.75
#: The tokenizer's pattern (public_tokenizers.PATTERN), written so that a run of one kind of characters
#: is never tried again character by character; it splits every text alike.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s"
#: Code points up to which both tokenizers split texts by the same Unicode tables.
PLAIN = 0x24F


@lru_cache(maxsize=2)
def encoders(vocabulary: str, ranks: str):
    """The tokenizer of a vocabulary, and a faster encoder of the same merges by rank."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary)
    exact.encode_special_tokens = True
    with open(ranks, "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(
        "packing", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return exact, fast


def default_files() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken")


def token_ids(text: str, exact, fast) -> np.ndarray:
    """Ids as the tokenizer gives them. Texts of Latin letters go through the rank encoder, which
    has the same merges; others, where Unicode tables could differ, through the tokenizer."""
    if text.isascii() or np.frombuffer(
        text.encode("utf-32-le", "surrogatepass"), np.uint32
    ).max(initial=0) <= PLAIN:
        ids = fast.encode_ordinary(text)
    else:
        ids = exact.encode(text, add_special_tokens=False).ids
    ids.append(END)
    return np.frombuffer(array("I", ids), np.uint32)  # several times faster than from the list


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(docs: DataFrame, files: tuple[str, str] | None) -> DataFrame:
    """Full windows (no ids kept) and rests (with ids) of all documents."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        exact, fast = encoders(*(files or default_files()))
        doc = batch.column(0).to_pylist()
        columns: list[list] = [[] for _ in range(6)]
        size = 0

        def out() -> pa.RecordBatch:
            types = [pa.int64()] * 5 + [pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for row, item in enumerate(batch.column(1)):
            ids = token_ids(item.as_py() or "", exact, fast)
            total = len(ids)
            for start in range(0, total, WINDOW):
                piece = ids[start : start + WINDOW]
                code = crc(piece)
                full = len(piece) == WINDOW
                narrow = piece.astype("<u2") if piece.max() < 65536 else piece.astype("<u4")
                for c, v in zip(columns, (
                    doc[row], start, len(piece), code, total,
                    None if full else narrow.tobytes()), strict=True):
                    c.append(v)
                size += 0 if full else len(piece)
            if size > 1 << 20 or len(columns[0]) > 50_000:
                yield out()
                columns, size = [[] for _ in range(6)], 0
        if columns[0]:
            yield out()

    return arrow_map(docs.select("doc_id", "text"), work, f"{PIECE}, ids binary")


class Stats:
    """Pieces, mean length and document frequency of each token id over a whole table."""

    def __init__(self, n: int, mean: float, df: np.ndarray):
        self.n, self.mean, self.df = n, mean, df
        self.idf = np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0)

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        norm = K1 * (1 - B + B * length / self.mean)
        return (self.idf[term] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)


def runs_of_ids(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a piece in order, and where each distinct one begins."""
    ordered = np.sort(piece, kind="stable")  # a radix sort for ids of 16 bits
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered, first


def terms(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct token ids of a piece and how often each occurs."""
    ordered, first = runs_of_ids(piece)
    at = np.flatnonzero(first)
    return ordered[at].astype("<u4"), (np.concatenate((at[1:], [len(ordered)])) - at).astype("<u4")


def distinct(piece: np.ndarray) -> np.ndarray:
    """The first half of ``terms``."""
    ordered, first = runs_of_ids(piece)
    return ordered[first]


class Index:
    """BM25 inverted index of pieces; documents and terms are dense numbers. Frequencies are those
    of ``stats``, by default of the pieces themselves."""

    def __init__(self, pieces: list[np.ndarray], query_terms: int | None = None):
        pairs = [terms(p) for p in pieces]
        length = np.array([len(p) for p in pieces])
        df = np.bincount(np.concatenate([t for t, _ in pairs]))
        self.build(pairs, length, Stats(len(pieces), length.mean(), df), query_terms)

    @classmethod
    def of(cls, pairs: list[tuple[np.ndarray, np.ndarray]], length: np.ndarray, stats: Stats):
        new = cls.__new__(cls)
        new.build(pairs, length, stats, None)
        return new

    def build(self, pairs, length: np.ndarray, stats: Stats, query_terms: int | None) -> None:
        n = len(pairs)
        doc = np.repeat(np.arange(n), [len(t) for t, _ in pairs])
        token = np.concatenate([t for t, _ in pairs]).astype(np.int64)
        tf = np.concatenate([f for _, f in pairs])
        order = np.lexsort((doc, token))
        self.doc, token, tf = doc[order], token[order], tf[order]
        self.weight = stats.weights(token, tf, length[self.doc]).astype(float)
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        self.at = np.append(np.flatnonzero(new), len(token))
        number = np.cumsum(new) - 1
        idf = stats.idf[token[new]]
        self.count, self.steps = n, np.arange(len(token))
        # A piece's query: its terms of positive weight, highest inverse frequency first.
        order = np.lexsort((number, -idf[number], self.doc))
        useful = idf[number][order] > 0
        of, query = self.doc[order][useful], number[order][useful]
        start = np.searchsorted(of, np.arange(n + 1))
        self.query = [
            query[a : b if query_terms is None else min(b, a + query_terms)]
            for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)
        ]

    def scores(self, piece: int) -> np.ndarray:
        terms = self.query[piece]
        if not len(terms):
            return np.zeros(self.count)
        first, count = self.at[terms], self.at[terms + 1] - self.at[terms]
        place = np.repeat(first - np.cumsum(count) + count, count)
        place += self.steps[: len(place)]
        return np.bincount(self.doc.take(place), self.weight.take(place), self.count)

    def drop(self, used: np.ndarray) -> None:
        """Leave out the postings of used pieces; their queries stay."""
        keep = ~used[self.doc]
        self.at = np.concatenate(([0], np.cumsum(keep)))[self.at]
        self.doc, self.weight = self.doc[keep], self.weight[keep]


def best_unused(score: np.ndarray, used: np.ndarray, some: int = 32) -> list[int]:
    """The next unused pieces that score above 0, best last; empty when there are none."""
    score = np.where(used, 0, score)
    some = min(some, len(score))
    best = np.argpartition(-score, some - 1)[:some]
    best = best[score[best] > 0]
    return best[np.lexsort((best, -score[best]))][::-1].tolist()


Segment = tuple[int, int, int]


def fill(lengths: list[int], index: Index) -> Iterator[list[Segment]]:
    """Sequences of (piece, start in it, length): full windows, then powers of two."""
    n, used, next_unused = len(lengths), np.zeros(len(lengths), bool), 0
    rests: deque[Segment] = deque()  # (piece, start, end)
    left, indexed = n, n

    def unused(piece: int) -> Segment:
        nonlocal left
        used[piece], left = True, left - 1
        return piece, 0, lengths[piece]

    def in_order() -> int | None:
        nonlocal next_unused
        while next_unused < n and used[next_unused]:
            next_unused += 1
        return next_unused if next_unused < n else None

    while True:
        rest: Segment | None
        if rests:
            rest = rests.popleft()
        elif in_order() is None:
            return
        else:
            rest = unused(next_unused)
        seed, window, room = rest[0], [], WINDOW
        score, ranked = None, []
        while room:
            if rest is None:
                if 8 * left < 7 * indexed:
                    index.drop(used)
                    indexed = left
                if score is None:
                    score = index.scores(seed)
                ranked = ranked or best_unused(score, used)
                following = ranked.pop() if ranked else in_order()
                if following is not None:
                    rest = unused(following)
                elif rests:
                    rest = rests.popleft()
                else:
                    break
            piece, start, end = rest
            take = min(room, end - start)
            window.append((piece, start, take))
            room -= take
            rest = (piece, start + take, end) if start + take < end else None
        if rest is not None:
            rests.append(rest)
        if not room:
            yield window
            continue
        # Nothing is left in the shard: powers of two, largest first.
        left = WINDOW - room
        for size in (1 << b for b in range(left.bit_length() - 1, -1, -1)):
            if left & size:
                sequence = []
                while size:
                    piece, start, have = window.pop(0)
                    take = min(size, have)
                    sequence.append((piece, start, take))
                    size -= take
                    if take < have:
                        window.insert(0, (piece, start + take, have - take))
                yield sequence


def piece_ids(data: bytes, length: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * length else "<u4")


def piece_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(piece, token id) of all distinct tokens of the pieces of a batch."""
    ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
    lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
    found = [distinct(piece_ids(x, n)) for x, n in zip(ids, lengths, strict=True)]
    piece = np.repeat(np.arange(len(found)), [len(t) for t in found])
    return piece, np.concatenate(found).astype(np.int64)


def statistics(rests: DataFrame) -> Stats:
    """Counts over all pieces; the result has one number for each id of the vocabulary."""

    def frequencies(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        df = np.bincount(piece_terms(batch)[1])
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    found = arrow_map(rests.select("ids", "length"), frequencies, "term long, df long").groupBy(
        "term").agg(F.sum("df").alias("df")).toArrow()
    n, mean = rests.agg(F.count(F.lit(1)), F.avg("length")).first()
    term = found["term"].to_numpy()
    df = np.zeros(term.max(initial=0) + 1, np.int64)
    df[term] = found["df"].to_numpy()
    return Stats(n, mean or 1.0, df)


class Leaders:
    """Inverted index of the informative terms of sample pieces."""

    def __init__(self, pieces: list[np.ndarray], stats: Stats):
        self.informative = (stats.df <= COMMON * stats.n) & (stats.idf > 0)
        if stats.n < 1 / COMMON:
            self.informative = stats.idf > 0
        pairs = [terms(p) for p in pieces]
        leader = np.repeat(np.arange(len(pairs)), [len(t) for t, _ in pairs])
        token, tf = (np.concatenate(x).astype(np.int64) for x in zip(*pairs, strict=True))
        keep = self.informative[token]
        leader, token, tf = leader[keep], token[keep], tf[keep]
        order = np.argsort(token, kind="stable")
        self.token, self.leader = token[order], leader[order]
        length = np.array([len(p) for p in pieces])
        self.weight = stats.weights(self.token, tf[order], length[self.leader])
        self.count = len(pieces)
        # Leaders of one topic follow each other: from each on to the most similar one left.
        score = self.scores(leader, token, self.count)
        score += score.T
        self.rank, now = np.full(self.count + 1, self.count), 0
        for place in range(self.count):
            self.rank[now] = place
            score[:, now] = -1
            now = int(score[now].argmax())

    def scores(self, piece: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
        """BM25 of ``n`` pieces, given as (piece, informative token), with all leaders."""
        first = np.searchsorted(self.token, token)
        count = np.searchsorted(self.token, token, "right") - first
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        return np.bincount(
            np.repeat(piece, count) * self.count + self.leader[at], self.weight[at], n * self.count
        ).reshape(n, self.count)

    def places(self, piece: np.ndarray, token: np.ndarray, n: int) -> list[np.ndarray]:
        """Ranks of the best and the second leader and the smallest term hash of ``n`` pieces."""
        keep = self.informative[token]
        piece, token = piece[keep], token[keep]
        mark = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(mark, piece, (R.mix(token.astype(np.uint64)) >> np.uint64(1)).astype(np.int64))
        score = self.scores(piece, token, n)
        rows, found = np.arange(n), []
        for _ in range(2):
            best = score.argmax(axis=1)
            found.append(self.rank[np.where(score[rows, best] > 0, best, self.count)])
            score[rows, best] = 0
        return [*found, mark]


def related(rests: DataFrame, stats: Stats) -> DataFrame:
    """The pieces with ``first``, ``second`` and ``mark``, the place of their topic."""
    spread = F.xxhash64("doc_id", "start", "ids_crc32")
    # The smallest hashes first: a list of ids from each task would grow with the tasks.
    marked = rests.withColumn("spread", spread)
    smallest = [r.spread for r in marked.select("spread").orderBy("spread").limit(LEADERS).collect()]
    sample = marked.where(F.col("spread") <= smallest[-1]).select(
        "ids", "length", "spread", "doc_id", "start").orderBy(
        "spread", "doc_id", "start").limit(LEADERS).collect()
    leaders = Leaders([piece_ids(r.ids, r.length) for r in sample], stats)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            found = leaders.places(*piece_terms(part), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *map(pa.array, found)],
                [*part.schema.names, "first", "second", "mark"])

    return arrow_map(rests, work, f"{PIECE}, ids binary, first long, second long, mark long")


PACKED = f"{PIECE}, sequence_id long, offset long, ids binary"


def windows(pieces: DataFrame, stats: Stats, shard_documents: int) -> DataFrame:
    """Packed pieces of sorted rests, shard by shard."""

    def packed_shard(rows: list[tuple], shard: int) -> pa.RecordBatch:
        own = [piece_ids(ids, length) for _, _, length, _, ids, _ in rows]
        lengths = [len(x) for x in own]
        index = Index.of([terms(x) for x in own], np.array(lengths), stats)
        out = [[] for _ in range(8)]
        for number, members in enumerate(fill(lengths, index)):
            offset = 0
            for piece, at, take in members:
                (doc, start, _, total, _, _), ids = rows[piece], own[piece][at : at + take]
                for c, v in zip(out, (
                        doc, start + at, take, crc(ids), total, 2 * (shard + number), offset,
                        ids.tobytes()), strict=True):
                    c.append(v)
                offset += take
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
            [c.split()[0] for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, shard = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A shard has at most 11 sequences more than pieces, and positions are unique.
                shard = row[-1] * 16 if shard is None else shard
                waiting.append(row)
                if len(waiting) == shard_documents:
                    yield packed_shard(waiting, shard)
                    waiting, shard = [], None
        if waiting:
            yield packed_shard(waiting, shard)

    order = ("first", "second", "mark", "ids_crc32", "doc_id", "start")
    ordered = pieces.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select(
        "doc_id", "start", "length", "doc_tokens", "ids",
        F.monotonically_increasing_id().alias("at")).mapInArrow(run, PACKED)


def packed(
    docs: DataFrame, files: tuple[str, str] | None = None, shard_documents: int = 2048,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (the piece's
    ids; null for a full window of one document, which ``start`` finds)."""
    table = stored(cut(docs, files), "packing-pieces")
    rests = table.where("ids is not null")
    whole = table.where("ids is null").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), F.lit(None).cast("binary").alias("ids"))
    stats = statistics(rests)
    if not stats.n:
        return whole
    pieces = stored(related(rests, stats), "packing-related")
    return windows(pieces, stats, shard_documents).unionByName(whole)


def query(spark, folder: str) -> DataFrame:
    return packed(id_and_text(documents(spark, folder))).drop("ids")
