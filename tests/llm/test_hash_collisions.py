"""Thue-Morse words and lines, on which polynomials modulo 2^64 collide for every base."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridwright.llm import line_labels, near_copies, rolling, substring_words, suffix_levels
from tests.llm import plain


def thue_morse(size):
    word = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[x] for x in word), "".join("ba"[x] for x in word)


@pytest.fixture(scope="module", params=[512, 2048, 4096])
def docs(request):
    a, b = thue_morse(request.param)
    words = " ".join(f"w{i}" for i in range(49))
    return [(1, f"{words} {a}"), (2, f"{words} {b}"), (3, f"{a} x y"), (4, f"{b} x y"),
            (5, f"{a}\n{b}\n{a}\n" + "more words here now\n" * 3), (6, f"{words} {a} end")]


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_words(frame, docs):
    out = substring_words.remove_repeats(frame(docs)).withColumn("h", F.sha2("kept", 256))
    assert rows(out, "doc_id", "n_units", "n_removed", "h") == sorted(plain.substring_words(docs))


def test_bytes(frame, docs):
    out = suffix_levels.remove_repeats(frame(docs)).withColumn("h", F.sha2("kept", 256))
    assert rows(out, "doc_id", "n_units", "n_removed", "n_spans", "h") == sorted(plain.substring_bytes(docs))


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_shingles(frame, docs, k, percent):
    out = near_copies.linked(frame(docs), k, percent)
    assert rows(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(
        plain.near_copies(docs, k, percent))


def test_lines(frame, docs):
    out = line_labels.judged(frame(docs), line_labels.Field())
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows(out, *names) == sorted(plain.quality(docs))


def test_lanes_of_words_are_independent():
    import numpy as np

    raw = np.frombuffer(b"one two " + b"x" * 300, np.uint8)
    starts, ends = rolling.word_bounds(raw, np.array([0, len(raw)]))
    first, second = (rolling.word_values(raw, starts, ends, lane) for lane in (0, 1))
    assert len(set(first.tolist()) | set(second.tolist())) == 6
