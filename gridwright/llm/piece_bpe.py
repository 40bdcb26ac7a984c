"""SentencePiece encoding and decoding for merge-type vocabularies.

A text becomes symbols, one per character, after spaces turn into U+2581 with one in front. The
agenda holds all adjacent pairs whose concatenation is a piece; the best score goes first, at
equal scores the leftmost, until no pair is left. Characters outside the vocabulary fall back to
bytes. No piece holds U+2581 behind another character (checked when the model is loaded), so no
pair reaches over such a place and the text is cut there into chunks, which repeat a lot: each
distinct chunk is encoded once per pass. Short chunks of one length run their agendas side by
side in numpy, long ones have a heap of their own. New chunks are compared with the sentencepiece
library, and its ``decode`` turns the ids back into text.

Defined results: a null or empty text has the end id only and decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import arrow_map, documents, id_and_text

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Symbols up to which chunks are encoded side by side; chunks of a generation that is kept
#: between passes; characters of text in a pass.
SHORT, KEPT, PASS = 24, 500_000, 1 << 22


class Agenda:
    """Encoder of one model."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(lib.get_piece_size())
        special = [i for i in ids if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)]
        if any(lib.is_unused(i) for i in ids):
            raise ValueError("models with unused pieces are not supported")
        rest = set(ids) - set(special)
        piece = {lib.id_to_piece(i): i for i in rest}
        if any(MARK in p.lstrip(MARK) for p in piece):
            raise ValueError("a piece reaches over a word start")
        if any(c not in piece for p in piece for c in p):
            raise ValueError("a piece has a character that is none itself")
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = lib.eos_id()
        self.text = [b"%d" % i for i in ids]
        self.size = len(ids)
        self.char = np.full(0x110000, self.size, np.int64)
        for p, i in piece.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        _, rank = np.unique([-lib.get_score(i) for i in ids], return_inverse=True)
        self.pairs = {
            piece[p[:c]] * (self.size + 1) + piece[p[c:]]: (int(rank[i]), i)
            for p, i in piece.items()
            for c in range(1, len(p))
            if p[:c] in piece and p[c:] in piece
        }
        keys = np.array(sorted(self.pairs), np.int64)
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.none = len(rank) + 1
        self.rank = np.array([self.pairs[k][0] for k in keys.tolist()] + [self.none], np.int64)
        self.made = np.array([self.pairs[k][1] for k in keys.tolist()] + [0], np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * (self.size + 1) + right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return self.rank[at], self.made[at]

    def side_by_side(self, symbols: np.ndarray) -> list[list[int]]:
        """Final symbols of chunks of one length; rows are chunks."""
        rows, width = symbols.shape
        if width == 1:
            return symbols.tolist()
        done = np.full((rows, width), -1, np.int64)
        live = np.arange(rows)
        now = symbols.copy()
        rank, made = self._look(now[:, :-1], now[:, 1:])
        while True:
            best = rank.argmin(axis=1)
            every = np.arange(len(now))
            go = rank[every, best] < self.none
            done[live[~go], : now.shape[1]] = now[~go]
            now, rank, made, best, live = now[go], rank[go], made[go], best[go], live[go]
            if not len(now):
                break
            every = np.arange(len(now))
            now[every, best] = made[every, best]
            # Close the gap behind the pair: columns to its right move one to the left.
            column = np.arange(now.shape[1] - 1)
            now = np.where(column[None] <= best[:, None], now[:, :-1], now[:, 1:])
            if now.shape[1] == 1:
                done[live, :1] = now
                break
            column = np.arange(now.shape[1] - 1)
            take = column[None] < best[:, None]
            rank = np.where(take, rank[:, :-1], rank[:, 1:])
            made = np.where(take, made[:, :-1], made[:, 1:])
            for shift in (-1, 0):
                at = best + shift
                ok = (at >= 0) & (at < now.shape[1] - 1)
                at, who = at[ok], every[ok]
                rank[who, at], made[who, at] = self._look(now[who, at], now[who, at + 1])
            # Narrower rows carry the filler -1, which no pair has.
            if (now[:, -1] == -1).all():
                now, rank, made = now[:, :-1], rank[:, :-1], made[:, :-1]
        return [[x for x in r if x >= 0] for r in done.tolist()]

    def alone(self, symbols: list[int]) -> list[int]:
        """Final symbols of one long chunk, with a heap as the agenda."""
        symbols = list(symbols)
        before = list(range(-1, len(symbols) - 1))
        after = [*range(1, len(symbols)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                pair = self.pairs.get(symbols[left] * (self.size + 1) + symbols[right])
                if pair:
                    heapq.heappush(heap, (pair[0], left, right, symbols[left], symbols[right]))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, x, y = heapq.heappop(heap)
            if symbols[left] != x or symbols[right] != y or after[left] != right:
                continue
            symbols[left] = self.pairs[x * (self.size + 1) + y][1]
            symbols[right] = -1
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [x for x in symbols if x >= 0]

    def chunks(self, new: list[str]) -> list[list[int]]:
        """Ids of distinct chunks."""
        out: list[list[int]] = [[]] * len(new)
        lengths = np.array([len(c) for c in new])
        for width in np.unique(lengths):
            at = np.flatnonzero(lengths == width)
            text = "".join([new[i] for i in at])
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            symbols = self.char[code].reshape(len(at), width)
            if width <= SHORT:
                found = self.side_by_side(symbols)
            else:
                found = [self.alone(row) for row in symbols.tolist()]
            unknown = symbols.max(axis=1) == self.size
            for i, ids, odd in zip(at.tolist(), found, unknown.tolist(), strict=True):
                out[i] = self._with_bytes(new[i], ids) if odd else ids
        return out

    def _with_bytes(self, chunk: str, ids: list[int]) -> list[int]:
        out: list[int] = []
        strange = (c for c in chunk if self.char[ord(c)] == self.size)
        for i in ids:
            if i == self.size:
                out += [self.bytes[b] for b in next(strange).encode("utf-8", "replace")]
            else:
                out.append(i)
        return out

    def agrees(self, new: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library encodes the chunks alike."""
        texts = [c[1:].replace(MARK, " ") for c in new]
        theirs = self.library.encode(texts, num_threads=1)
        return [x == y or c == MARK for c, x, y in zip(new, ids, theirs, strict=True)]


@lru_cache(maxsize=2)
def agenda(model: str) -> Agenda:
    return Agenda(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded, library_agrees): ids in decimal joined by one space, end
    id last. ``model`` is a path on the executors; None asks the tokenizer package there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = agenda(model or default_model())
        known: dict[str, bytes] = {}
        older: dict[str, bytes] = {}
        odd: set[str] = set()
        for batch in batches:
            column = batch.column(1)
            first, rows = 0, batch.num_rows
            while first < rows:
                texts, size, last = [], 0, first
                while last < rows and (size < PASS or last == first):
                    texts.append(column[last].as_py() or "")
                    size += len(texts[-1])
                    last += 1
                cut = [
                    CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts
                ]
                if len(known) > KEPT:
                    known, older = {}, known
                new = list(dict.fromkeys(c for row in cut for c in row if c not in known))
                known.update((c, older[c]) for c in new if c in older)
                new = [c for c in new if c not in older]
                ids = coder.chunks(new)
                odd.update(
                    c for c, ok in zip(new, coder.agrees(new, ids), strict=True) if not ok
                )
                text = coder.text
                known.update(
                    (c, b" ".join([text[i] for i in x])) for c, x in zip(new, ids, strict=True)
                )
                end = [text[coder.end]]
                joined = [b" ".join([*map(known.__getitem__, row), *end]) for row in cut]
                fine = [not odd or odd.isdisjoint(row) for row in cut]
                whole = [list(map(int, j.split())) for j in joined]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        pa.array([len(w) for w in whole], pa.int64()),
                        pa.array([j.decode() for j in joined], pa.string()),
                        pa.array([coder.library.decode(w) for w in whole], pa.string()),
                        pa.array(fine),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded", "library_agrees"],
                )
                first = last

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids string, decoded string, library_agrees boolean"
    )


def query(spark, folder: str) -> DataFrame:
    out = encoded(id_and_text(documents(spark, folder)))
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "library_agrees",
    )
