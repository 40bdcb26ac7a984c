"""Turn repair, exact search and Merkle manifest against plain Python versions."""

from __future__ import annotations

import heapq
import math
import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from gridwright.llm import merkle_manifest as M
from gridwright.llm import turn_repair as T
from gridwright.llm import vector_cells as V
from tests.conftest import rows

WHITE = " \t\n\v\f\r"


# -- turn repair ----------------------------------------------------------------------------------


def plain_audit(word):
    """Cheapest edits by a search over (position, state) with cost and letters as the order."""
    end, heap, seen = len(word), [(0, "", 0, 0)], set()
    while heap:
        cost, letters, at, state = heapq.heappop(heap)
        if at == end and state in (0, 3):
            return cost, letters
        if (at, state) in seen:
            continue
        seen.add((at, state))
        wanted = 3 if state == 2 else 2
        ways = [(2, "I", at, wanted)]
        if at < end:
            who, cut = word[at].lower(), int(word[at].isupper())
            ways.append((3, "D", at + 1, state))
            if who != "x":
                ways.append((2 + cut, "R", at + 1, wanted))
                if who == "s" and state == 0:
                    ways.append((cut, "K", at + 1, 1))
                if who == ("a" if state == 2 else "u"):
                    ways.append((cut, "K", at + 1, wanted))
        for more, letter, next_at, next_state in ways:
            heapq.heappush(heap, (cost + more, letters + letter, next_at, next_state))


def plain_repair(turns):
    by = {}
    for conv, turn, role, text in turns:
        name = ["" if conv is None else str(conv), "" if turn is None else str(turn)]
        h = zlib.crc32(f"{name[0] or ' '}:{name[1] or ' '}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = by.setdefault(conv, [])
        if h == 1:
            text = ""
        if h == 2:
            text = "".join(c for c in text if c not in ".!?")
        if h == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for conv, mine in by.items():
        digest = lambda r: sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r)))
        seen, word, counts = set(), "", {"b": 0, "d": 0, "t": 0, "": 0}
        for _, role, text in mine:
            core = text.rstrip(WHITE)
            fault = ("b" if not core else "d" if (role, text) in seen
                     else "t" if core[-1] not in ".!?" else "")
            seen.add((role, text))
            counts[fault] += 1
            who = role[:1] if role[:1] in ("s", "u", "a") else "o"
            word += "x" if fault in ("b", "d") else who.upper() if fault else who
        cost, audit = plain_audit(word)
        state, left, done = 0, list(mine), []
        for letter in audit:
            wanted = 3 if state == 2 else 2
            row = left.pop(0) if letter != "I" else (None, None, "")
            if letter == "D":
                continue
            if letter == "K":
                state = 1 if row[1][0] == "s" else wanted
                done.append(f"{row[1]}:{row[2]}")
            else:
                state = wanted
                done.append(f"{'assistant' if wanted == 3 else 'user'}:{row[2]}")
        turns_known = [t for t, _, _ in mine if t is not None]
        gaps = max(turns_known) - min(turns_known) + 1 - len(set(turns_known)) if turns_known else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit,
                    sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(3)
    texts = ["Yes.", "No", "Why?", "  ", "", None, "A longer answer.\n", "cut off \t", "é。", "Go!"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    found = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 14)):
            weights = [8, 8, 2, 1, 1, 1, 1]
            role = rng.choices(roles, weights)[0] if rng.random() < 0.4 else roles[turn % 2]
            found.append((conv, None if rng.random() < 0.05 else turn, role, rng.choice(texts)))
    found += [(100, t, roles[t % 2], f"Turn {t}.") for t in range(700)]  # a long one
    for conv in range(200, 260):  # one very common conversation
        found += [(conv, 0, "user", "Hi."), (conv, 1, "assistant", "Hello."), (conv, 2, "user", "Bye.")]
    found += [(300, None, None, None), (301, 5, "user", "x" * 200_000), (302, 2**62, "user", "A.")]
    found += [(303, 1, "user", "Same."), (303, 1, "user", "Same."), (303, 1, "assistant", "Same.")]
    rng.shuffle(found)
    return found


@pytest.mark.parametrize("extra", [False, True])
def test_repair_equals_plain_version(spark, frame, talks, extra):
    turns = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    if extra:
        turns = turns.withColumns({n: F.lit("x") for n in ("conv", "word", "kind", "content", "copy", "part")})
    got = T.repair(turns.repartition(5))
    names = ("conv_id", *T.STATS, "cost", "audit", "repaired_sha256")
    assert rows(got.select(*names)) == plain_repair(talks)


def test_repair_of_an_empty_table(spark, frame):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.repair(turns).collect() == []


def test_conversation_without_rows_after_damage(spark, frame):
    gone = next((c, t) for c in range(200) for t in range(50) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    turns = spark.createDataFrame([(*gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in T.repair(turns).collect()] == [
        (gone[0], 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())]


def test_automaton_makes_each_shared_ending_once():
    rng = random.Random(1)
    words = {"".join(rng.choices("suaoSUAOx", k=rng.randint(0, 7))) for _ in range(3000)}
    automaton = T.Automaton()
    got = {w: automaton.take(w[::-1]) for w in sorted(words, key=lambda w: w[::-1])}
    assert got == {w: plain_audit(w) for w in words}
    assert automaton.made == len({w[i:] for w in words for i in range(len(w))})


# -- exact search ---------------------------------------------------------------------------------


def plain_nearest(vectors, k=5):
    known = set()
    for vec_id, x in vectors:
        if vec_id is not None and x is not None and all(e is not None and math.isfinite(e) for e in x):
            known.add((vec_id, tuple(math.floor(256 * e) for e in x)))
    out = []
    for q, v in known:
        if q % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in known
                      if len(w) == len(v) and (i, w) != (q, v)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found_nearest(spark, vectors, parts=3):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int")
    table = table.repartition(parts).withColumns({n: F.lit(1) for n in ("v", "slot", "asked", "block", "dims")})
    return rows(V.nearest(V.whole_vectors(table), F.col("vec_id") % 50 == 0))


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(9)
    centres = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(5)]
    found = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], 0) for i in range(900)]
    found += [(i, list(found[7][1]), 0) for i in range(900, 1300)]  # one very common vector
    found += [(1300, [0.5, 0.5], 0), (1301, [0.25, -0.5], 0), (1350, [], 0), (1351, [], 0)]
    found += [(1400, None, 0), (1401, [None] * 12, 0), (1450, [math.nan] * 12, 0), (1500, [math.inf] * 12, 0)]
    found += [(None, list(found[3][1]), 0), found[50], found[50], (100, list(found[8][1]), 0)]
    found += [(1550, [1e6 + i for i in range(12)], 0), (1600, [-x for x in found[4][1]], 0)]
    rng.shuffle(found)
    return found


def test_search_equals_plain_version(spark, frame, vectors):
    assert found_nearest(spark, vectors) == plain_nearest([v[:2] for v in vectors])


def test_search_over_many_small_shards_reads_few_vectors(spark, frame, vectors, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 100)
    monkeypatch.setattr(V, "QUERIES", 7)
    monkeypatch.setattr(V, "FIRST", 2)
    assert found_nearest(spark, vectors) == plain_nearest([v[:2] for v in vectors])


def test_cells_bound_all_scores(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    values = rng.integers(-90, 90, (3000, 8))
    key = tuple(pa.scalar(i) for i in (8, 0))
    shard = V.build_shard(key, pa.table({"slot": np.arange(3000), "v": list(values)}))
    queries = V.pack_queries(key, pa.table({"asked": np.arange(20), "v": list(values[:20])}))
    got = V.scanner(6)((*key, pa.scalar(0)), shard, queries).to_pandas()
    exact = values[:20] @ values.T
    score = exact[got.asked, got.slot]
    assert ((got.least <= score) & (score <= got.most)).all()
    for q in range(20):
        sixth = np.sort(exact[q])[-6]
        assert set(np.flatnonzero(exact[q] >= sixth)) <= set(got.slot[got.asked == q])
    assert len(got) < 20 * 3000 / 4


def test_search_of_few_rows(spark, frame):
    assert found_nearest(spark, []) == []
    assert found_nearest(spark, [(50, [1.0], 0)]) == []
    assert found_nearest(spark, [(50, [1.0], 0), (51, [-0.001], 0)]) == [(50, 1, 51, -256)]


# -- Merkle manifest ------------------------------------------------------------------------------


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return hashed(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([hashed(*last[i : i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i // 8 * 8
        yield level[start : start + 8], i - start
        i //= 8


def plain_manifest(docs):
    by = {}
    for doc_id, source, lang, n_chars, text in docs:
        by.setdefault(lang, []).append((doc_id, source, lang, n_chars, text))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees.append(plain_tree([plain_leaf(r) for r in by[lang]]))
    top, out = plain_tree([t[-1][0] for t in trees]), []
    for place, (lang, tree) in enumerate(zip(langs, trees)):
        for i, row in enumerate(by[lang]):
            steps = [*siblings(tree, i), *siblings(top, place)]
            proof = "".join(d for run, j in steps for k, d in enumerate(run) if k != j)
            digest = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                digest = plain_leaf((*row[:4], lowered))
            for run, j in steps:
                digest = hashed(*run[:j], digest, *run[j + 1 :])
            out.append((row[0], plain_leaf(row), tree[-1][0], top[-1][0], hashed(proof), digest,
                        digest == top[-1][0]))
    return sorted(out, key=repr)


def found_manifest(spark, docs, extra=False):
    table = spark.createDataFrame(
        docs, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    if extra:
        table = table.withColumns({n: F.lit(7) for n in ("tree", "idx", "n", "part", "leaf", "digest")})
    return rows(M.manifest(table).drop("n_siblings"))


@pytest.fixture(scope="module")
def leaves():
    rng = random.Random(2)
    langs = ["en"] * 12 + ["de", "fr", "", None, "É", "zz"]
    docs = [(i * 3 % 1009 - 20, f"s{i % 3}", rng.choice(langs), i, f"Some Text {i % 90} É") for i in range(700)]
    docs += [(5000 + i, None, f"l{i}", None, None) for i in range(20)]
    docs += [(None, "s", "en", 1, "A"), (None, "s", "en", 1, "A"), (7, "s", "en", 2, "Bee"), (7, "s", "en", 2, "bee")]
    docs += [(6000, "s", "en", 0, ""), (6001, "s", "en", 10**6, "Long Text " * 100_000)]
    return docs


def test_manifest_equals_plain_version(spark, frame, leaves, monkeypatch):
    want = plain_manifest(leaves)
    assert found_manifest(spark, leaves, extra=True) == want
    monkeypatch.setattr(M, "LEAVES", 37)  # partitions that start and end inside runs
    assert found_manifest(spark, leaves) == want


@pytest.mark.parametrize("size", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_of_one_language(spark, frame, size):
    docs = [(i, "s", "en", 3, f"Doc {i}") for i in range(size)]
    assert found_manifest(spark, docs) == plain_manifest(docs)


def test_missing_coordinates_are_minimal():
    for n, low, high in ((1, 0, 1), (8, 3, 4), (100, 17, 60), (600, 0, 600), (577, 500, 577)):
        digests = [hashed(str(i)) for i in range(n)]
        tree, asked = plain_tree(digests), list(M.missing(low, high, n))
        known = {(level, i): tree[level][i].encode() for level, i in asked}
        levels, root = M.climb([d.encode() for d in digests[low:high]], low, n, known)
        assert root.decode() == tree[-1][0]
        assert len(asked) == len(set(asked)) == sum(len(w) for _, w in levels) - sum(
            len(range(low // 8**k, -(-high // 8**k))) for k in range(len(levels)))
