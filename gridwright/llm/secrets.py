"""Secret scans: named patterns plus a token-efficiency test for random strings.

A tokenizer's vocabulary holds what is frequent in ordinary text, so words, names and code take
few tokens per character and random strings many. Runs of 20 or more key characters are cut at the
spans of named patterns. What is left of 20 or more is reported as ``random`` if its
characters-per-token ratio is at most ``ratio``; otherwise its stretches of parts between
separators (- _ / and the like) that reach this ratio are. Left out are known digests (hex of a
digest's length) and identifiers (UUIDs, numbers, letters-only parts that all take few tokens).

Defined results: a null text is empty; spans are code points of the whole match, end exclusive,
in order of start, then kind.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.common import arrow_map, documents, id_and_text

# The named patterns and their least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}

HINT = ("password", "passwd", "secret", "token", "api")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
NUMBER = re.compile(r"[0-9_+=/-]+")
WORDS = re.compile(r"[-_=+/]*[A-Za-z]+([_/+=-]+[A-Za-z]+)+[-_=+/]*")
PART = re.compile(rf"{UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
SEPARATORS, LEAST = "+/_=-", 20

Span = tuple[int, int, int]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """Encoder of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(
        "secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def named(text: str) -> list[Span]:
    """(start, kind, end) of the named patterns, sorted."""
    found: list[Span] = []
    low = text.lower()
    # Letters that only Unicode folding maps to ASCII cannot hide a hint: folding adds hints only.
    if any(h in low for h in HINT):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20
        ]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def excluded(run: str) -> bool:
    """Whether a run is a known digest or an identifier without words."""
    return bool(
        (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run))
        or UUID.fullmatch(run) or NUMBER.fullmatch(run)
    )


def outside(a: int, b: int, taken: list[Span], run: str) -> Iterator[tuple[int, int]]:
    """What named spans leave of a run from a to b, without the separators next to a span."""
    at, cuts = a, [(s, e) for s, _, e in taken if s < b and a < e]
    for s, e in [*cuts, (b, b)]:
        x, y = at, min(s, b)
        while at > a and x < y and run[x - a] in SEPARATORS:
            x += 1
        while y < b and x < y and run[y - 1 - a] in SEPARATORS:
            y -= 1
        if y - x >= LEAST:
            yield x, y
        at = max(at, e)


def stretches(run: str, parts: list[tuple[int, int, int]], ratio: float) -> Iterator[tuple[int, int]]:
    """Stretches of parts that take many tokens. A part adds ``ratio`` times its tokens less its
    characters; a single token, a number or a known identifier only lessens the sum. A stretch ends where the sum
    was largest before it fell below 0 or by 20."""
    weight = [
        (ratio * n if n > 1 and not excluded(run[a:b]) else 0) - (b - a) for a, b, n in parts]
    first = 0
    while first < len(parts):
        total, most, last = 0.0, 0.0, first
        for i in range(first, len(parts)):
            total += weight[i]
            if total < 0 or total < most - LEAST:
                break
            if total >= most:
                most, last = total, i
        a, b = parts[first][0], parts[last][1]
        if weight[first] >= 0 and b - a >= LEAST and not excluded(run[a:b]):
            # Padding belongs to the string before it.
            while b < len(run) and run[b] == "=" and not run[b:].strip("="):
                b += 1
            yield a, b
        first = last + 1


def random_runs(text: str, taken: list[Span], encode, ratio: float) -> list[Span]:
    out = []
    for m in CANDIDATE.finditer(text):
        for a, b in outside(m.start(), m.end(), taken, m[0]):
            run = text[a:b]
            if excluded(run) or not run.strip(SEPARATORS):
                continue
            parts = [(p.start(), p.end(), len(encode(p[0]))) for p in PART.finditer(run)]
            if WORDS.fullmatch(run):
                # Separators take a token each, so they do not count between words.
                letters, tokens = sum(y - x for x, y, _ in parts), sum(n for _, _, n in parts)
                whole = letters <= ratio * tokens and any(n > 1 for _, _, n in parts)
            else:
                whole = len(run) <= ratio * len(encode(run))
            found = [(0, len(run))] if whole else stretches(run, parts, ratio)
            out += [(a + x, 3, a + y) for x, y in found]
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, ratio: float = 2.1, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with base_spans, spans (text as above), n_assign, n_access, n_hex, n_random and
    masked: the text with every found span replaced by <secret>. Columns that have these names
    already are replaced."""
    docs = docs.drop("base_spans", "spans", "masked", *[f"n_{k}" for k in KINDS])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary or default_vocabulary()).encode_ordinary
        base, all_spans, masked = [], [], []
        counts: list[list[int]] = [[], [], [], []]
        for item in batch.column(batch.schema.get_field_index("text")):
            text = item.as_py() or ""
            own = named(text)
            spans = sorted(own + random_runs(text, own, encode, ratio))
            base.append(written(own))
            all_spans.append(written(spans))
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in spans))
            masked.append(mask(text, spans))
        out = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        out |= {"base_spans": pa.array(base, pa.string()), "spans": pa.array(all_spans, pa.string())}
        out |= {f"n_{k}": pa.array(c, pa.int64()) for k, c in zip(KINDS, counts, strict=True)}
        out["masked"] = pa.array(masked, pa.string())
        yield pa.RecordBatch.from_pydict(out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(
        docs, work,
        f"{schema}, base_spans string, spans string, n_assign long, n_access long, n_hex long, "
        "n_random long, masked string",
    )


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by <secret>."""
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark, folder: str) -> DataFrame:
    out = scanned(id_and_text(documents(spark, folder)))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_random",
    )
