"""Quality rules by line sequence labelling.

A document's lines that hold a word are a sequence. A linear-chain conditional random field with
the labels content and boilerplate scores each line by its features (length, symbols, capitals,
repetition and so on) and each pair of neighbours by their labels; Viterbi decoding finds the best
labelling. The share of words in content lines decides whether the document stays.

The weights are trained here, by gradient ascent on the likelihood: lines of labelled good
documents count as content, those of bad ones as boilerplate. The sample is bounded by two
documented parameters, ``train_documents`` labels of each kind (those with the smallest id hash)
and ``train_lines`` lines of each document. Without labels all weights are 0 and all is content.

Base rules: fewer than 50 words, or more than half of the words in repeated 3-word windows.

Defined results: a null text is empty and fails the base rules; lines without a word take no part;
words and lines are compared whole, by 64-bit hashes; each row is judged by itself, whatever its
id; a label whose id is null or in no document is not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm import rolling as R
from gridwright.llm.common import arrow_map, documents, id_and_text, text_passes

FEATURES = 14
CONTENT, BOILERPLATE = 0, 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _classes() -> dict[str, np.ndarray]:
    out = {}
    for name, chars in {
        "symbol": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)),
        "bang": b"!", "lower": bytes(range(97, 123)), "end": b".?!:;\"'", "web": b"{}/@=_\\",
    }.items():
        mask = np.zeros(256, bool)
        mask[list(chars)] = True
        out[name] = mask
    out["continued"] = np.zeros(256, bool)
    out["continued"][0x80:0xC0] = True
    return out


CLASS = _classes()


class Lines:
    """Words and lines of the rows of one pass, with the base counts of each row."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        rows = len(at) - 1
        starts, ends = R.word_bounds(raw, at)
        values = R.word_values(raw, starts, ends)
        word_at = np.searchsorted(starts, at)
        self.n_words = np.diff(word_at)
        row = np.repeat(np.arange(rows), self.n_words)
        sums = {n: np.concatenate(([0], np.cumsum(m[raw]))) for n, m in CLASS.items()}

        def per_row(count: np.ndarray) -> np.ndarray:
            return np.bincount(row, weights=count, minlength=rows).astype(np.int64)

        chars = (ends - starts) - (sums["continued"][ends] - sums["continued"][starts])
        self.word_chars = per_row(chars)
        self.n_symbols = sums["symbol"][at[1:]] - sums["symbol"][at[:-1]]

        # Words in 3-word windows that their row holds twice or more.
        seq = R.Rolling(values)
        count = max(len(values) - 2, 0)
        inside = np.arange(count) + 3 <= word_at[1:][row[:count]]
        window, window_row = seq.all(3)[inside], row[:count][inside]
        place = np.arange(count)[inside]
        order = np.lexsort((window, window_row))
        same = np.zeros(len(order) + 1, bool)
        same[1:-1] = (window[order][1:] == window[order][:-1]) & (
            window_row[order][1:] == window_row[order][:-1])
        twice = place[order[same[1:] | same[:-1]]]
        self.n_repeat_words = per_row(R.cover(len(values), twice, twice + 3))

        # Lines with a word: their words, bytes and rows.
        newline = np.concatenate(([0], np.cumsum(raw == 0x0A)))
        line_of_word = newline[starts] + row
        new = np.ones(len(starts), bool)
        new[1:] = line_of_word[1:] != line_of_word[:-1]
        self.first = np.flatnonzero(new)
        self.row = row[self.first]
        stop = np.append(self.first[1:], len(starts))
        edges = np.union1d(np.flatnonzero(raw == 0x0A), at)
        breaks = np.append(np.flatnonzero(raw == 0x0A), len(raw))
        a = np.maximum(
            np.concatenate(([0], breaks + 1))[np.searchsorted(breaks, starts[self.first])],
            at[self.row])
        b = edges[np.searchsorted(edges, starts[self.first], side="right")]
        whole = R.byte_strings(raw, a, b)
        order = np.lexsort((np.arange(len(whole)), whole, self.row))
        again = np.zeros(len(order), bool)
        again[order[1:]] = (whole[order][1:] == whole[order][:-1]) & (
            self.row[order][1:] == self.row[order][:-1])
        self.n_dup_lines = np.bincount(self.row, weights=again, minlength=rows).astype(np.int64)
        self.line_at = np.searchsorted(self.row, np.arange(rows + 1))

        # Features of each line.
        words = (stop - self.first).astype(float)
        self.words = words
        n = {k: (v[b] - v[a]).astype(float) for k, v in sums.items()}
        same_word = np.concatenate(
            ([0], np.cumsum(np.concatenate(([False], values[1:] == values[:-1])) & ~new)))
        letters = np.maximum(n["upper"] + n["lower"], 1)
        length = np.maximum(b - a, 1)
        mean = (np.concatenate(([0], np.cumsum(chars)))[stop]
                - np.concatenate(([0], np.cumsum(chars)))[self.first]) / words
        ended = CLASS["end"][raw[ends[stop - 1] - 1]]
        self.features = np.stack([
            np.ones(len(words)),
            np.minimum(n["symbol"] / words, 2),
            (n["symbol"] * 5 > words).astype(float),
            n["upper"] / letters,
            (2 * n["upper"] > letters).astype(float),
            np.minimum(n["bang"] / words, 2),
            (same_word[stop] - same_word[self.first]) / words,
            again.astype(float),
            ended.astype(float),
            (words < 3).astype(float),
            np.minimum(words, 40) / 40,
            n["digit"] / length,
            n["web"] / length,
            np.minimum(mean, 12) / 12,
        ], axis=1) if len(words) else np.zeros((0, FEATURES))


class Field:
    """Weights of the chain: features x labels, and label to label."""

    def __init__(self, lines: np.ndarray | None = None, pairs: np.ndarray | None = None):
        self.lines = np.zeros((FEATURES, 2)) if lines is None else lines
        self.pairs = np.zeros((2, 2)) if pairs is None else pairs

    @staticmethod
    def _grid(features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by falling length, so that the first ones are those that go on."""
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        return order, length[order], at[:-1][order]

    def decode(self, features: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Viterbi labels of all lines; ``at``: n + 1 line offsets of the rows."""
        score = features @ self.lines
        labels = np.zeros(len(score), np.int8)
        order, length, start = self._grid(features, at)
        most = int(length[0]) if len(length) else 0
        best, back = np.zeros((len(length), 2)), []
        live = len(length)
        for t in range(most):
            live = int(np.searchsorted(-length, -t, side="left"))
            own = score[start[:live] + t]
            if t:
                via = best[:live, :, None] + self.pairs[None]
                back.append(via.argmax(axis=1).astype(np.int8))
                best[:live] = via.max(axis=1) + own
            else:
                best[:live] = own
        state = best.argmax(axis=1).astype(np.int8)
        for t in range(most - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, side="left"))
            labels[start[:live] + t] = state[:live]
            if t:
                state[:live] = back[t - 1][np.arange(live), state[:live]]
        return labels

    def train(self, features, at, truth, rounds: int = 120, rate: float = 0.2, decay: float = 1e-3):
        """Adam on the mean log-likelihood of the label sequences."""
        order, length, start = self._grid(features, at)
        if not len(features):
            return self
        gold = np.zeros((len(truth), 2))
        gold[np.arange(len(truth)), truth] = 1
        own_pairs = np.zeros((2, 2))
        inner = np.ones(len(truth), bool)
        inner[at[:-1][np.diff(at) > 0]] = False
        here = np.flatnonzero(inner)
        np.add.at(own_pairs, (truth[here - 1], truth[here]), 1)
        wanted, total = features.T @ gold, len(features)
        weight = np.concatenate((self.lines.ravel(), self.pairs.ravel()))
        m, v = np.zeros_like(weight), np.zeros_like(weight)
        cut = FEATURES * 2
        for step in range(1, rounds + 1):
            lines, pairs = weight[:cut].reshape(FEATURES, 2), weight[cut:].reshape(2, 2)
            chance, both = self._marginals(features @ lines, pairs, length, start)
            slope = np.concatenate((
                (wanted - features.T @ chance).ravel(), (own_pairs - both).ravel())) / total
            slope -= decay * weight
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            weight = weight + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.lines, self.pairs = weight[:cut].reshape(FEATURES, 2), weight[cut:].reshape(2, 2)
        return self

    @staticmethod
    def _marginals(score, pairs, length, start):
        """Forward-backward: label chances of each line, summed chances of label pairs."""
        most, rows = int(length[0]), len(length)
        chance, both = np.zeros_like(score), np.zeros((2, 2))
        forward, norm = [], []
        a = None
        potential = np.exp(pairs)
        for t in range(most):
            live = int(np.searchsorted(-length, -t, side="left"))
            own = score[start[:live] + t]
            own = np.exp(own - own.max(axis=1, keepdims=True))
            a = own if t == 0 else (a[:live] @ potential) * own
            a = a / a.sum(axis=1, keepdims=True)
            forward.append(a)
            norm.append(own)
        b = np.ones((rows, 2))
        for t in range(most - 1, -1, -1):
            live = len(forward[t])
            p = forward[t] * b[:live]
            chance[start[:live] + t] = p / p.sum(axis=1, keepdims=True)
            if t:
                right = norm[t] * b[:live]
                joint = forward[t - 1][:live, :, None] * potential[None] * right[:, None, :]
                both += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                back = right @ potential.T
                b[:live] = back / back.sum(axis=1, keepdims=True)
        return chance, both


def trained(
    docs: DataFrame, labels: DataFrame, train_documents: int = 300, train_lines: int = 400
) -> Field:
    """A field fitted on a bounded sample of labelled documents."""
    good = F.col("quality")
    marked = labels.where(good.isin(0, 1) & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), good.cast("int").alias("good"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    sample = marked.where("good = 1").orderBy(*order).limit(train_documents).unionByName(
        marked.where("good = 0").orderBy(*order).limit(train_documents))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, raw, at in text_passes(batch):
            lines = Lines(raw, at)
            rows = [
                lines.features[x : min(x + train_lines, y)].tobytes()
                for x, y in zip(lines.line_at[:-1], lines.line_at[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[first:last], batch.column(2)[first:last],
                 pa.array(rows, pa.binary())], ["doc_id", "good", "lines"])

    # At most 2 * train_documents labels: a broadcast of known size.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    found = arrow_map(joined, work, "doc_id long, good int, lines binary").orderBy(
        "doc_id", "lines").limit(2 * train_documents).collect()
    parts = [np.frombuffer(r.lines, float).reshape(-1, FEATURES) for r in found]
    if not any(len(p) for p in parts):
        return Field()
    at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    truth = np.repeat([CONTENT if r.good else BOILERPLATE for r in found], np.diff(at))
    return Field().train(np.concatenate(parts), at, truth)


def judged(docs: DataFrame, field: Field, least_share: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share and kept; columns that have these names already are replaced."""
    docs = docs.drop(*COUNTS, "base_failed", "content_share", "kept")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, last, raw, at in text_passes(batch):
            x = Lines(raw, at)
            labels = field.decode(x.features, x.line_at)
            mine = np.bincount(
                x.row, weights=x.words * (labels == CONTENT), minlength=last - first)
            share = mine / np.maximum(x.n_words, 1)
            failed = (x.n_words < 50) | (100 * x.n_repeat_words > 50 * x.n_words)
            out = {n: batch.column(i)[first:last] for i, n in enumerate(batch.schema.names)}
            out |= {n: pa.array(getattr(x, n).astype(np.int64)) for n in COUNTS}
            out |= {"base_failed": pa.array(failed), "content_share": pa.array(share),
                    "kept": pa.array(~failed & (share >= least_share))}
            yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(
        docs, work, f"{schema}, {', '.join(n + ' long' for n in COUNTS)}, base_failed boolean, "
        "content_share double, kept boolean")


def query(spark, folder: str) -> DataFrame:
    docs = id_and_text(documents(spark, folder))
    field = trained(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return judged(docs, field).drop("text")
