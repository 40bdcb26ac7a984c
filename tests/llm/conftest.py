from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gridwright.llm.common import ship_code

#: Column names that the operators use for their own results.
CLASHING = ("content", "kind", "key", "kept", "windows", "whole", "node", "component", "label")


@pytest.fixture(scope="session")
def frame(spark):
    """(id, text) pairs as a documents table with more columns."""
    ship_code(spark)

    def make(docs, parts: int = 3, extra: bool = False):
        df = spark.createDataFrame(list(docs), "doc_id long, text string").repartition(parts)
        if extra:
            df = df.withColumns({n: F.lit(1) for n in CLASHING})
        return df

    return make


@pytest.fixture(scope="session")
def corpus():
    """Copies, edits, shared passages, ties, nulls, empty and long texts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["é", "中", "the", "The", "of"]
    docs: list[tuple[int | None, str | None]] = []
    passages = [" ".join(rng.choices(words, k=rng.randint(45, 80))) for _ in range(4)]
    for i in range(60):
        body = rng.choices(words, k=rng.randint(1, 160))
        if i % 3 == 0:
            body.insert(rng.randrange(len(body) + 1), rng.choice(passages))
        docs.append((i * 7 % 101, rng.choice((" ", "\n")).join(body)))
    base = docs[4][1].split() + rng.choices(words, k=150)
    for i in range(30):
        edited = list(base)
        for _ in range(rng.randint(0, 8)):
            edited[rng.randrange(len(edited))] = rng.choice(words)
        docs.append((200 + i, " ".join(edited)))
    docs += [(300, docs[0][1]), (300, docs[0][1]), (300, docs[1][1]), (301, docs[0][1].upper())]
    docs += [(None, docs[0][1]), (None, None), (302, None), (303, ""), (304, " \n\t "), (305, "a")]
    docs += [(306, "go on " * 4000), (307, "go on " * 300), (308, "x" * 5000), (309, "x" * 70)]
    docs += [(310, "| menu | home |\n" * 60), (311, "CAPS!! NOW!! " * 30)]
    return docs
