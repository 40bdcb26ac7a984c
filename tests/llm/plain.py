"""Plain Python versions of the operators' results, for comparison on small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.I | re.A,
)


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def repeats(docs, cut, size):
    """(id, units, kept units, removed runs) of each document; ``cut``: text to units."""
    first = {}
    for d, t in docs:
        units = cut(t or "")
        for i in range(len(units) - size + 1 if d is not None else 0):
            key = units[i : i + size]
            first[key] = min(d, first.get(key, d))
    out = []
    for d, t in docs:
        units = cut(t or "")
        gone = [False] * len(units)
        for i in range(len(units) - size + 1 if d is not None else 0):
            if first[units[i : i + size]] < d:
                gone[i : i + size] = [True] * size
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, units, [u for u, g in zip(units, gone, strict=True) if not g], runs))
    return out


def substring_words(docs, size=50):
    return [
        (d, len(u), len(u) - len(k), sha(" ".join(k)))
        for d, u, k, _ in repeats(docs, lambda t: tuple(WORD.findall(t)), size)
    ]


def substring_bytes(docs, size=50):
    return [
        (d, len(u), len(u) - len(k), r, sha(bytes(k)))
        for d, u, k, r in repeats(docs, lambda t: t.encode(), size)
    ]


def near_copies(docs, k, percent):
    sets = []
    for d, t in docs:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same = docs[i][0] == docs[j][0] and sets[i] == sets[j]
            common = len(sets[i] & sets[j])
            if same or (common and 100 * common >= percent * len(sets[i] | sets[j])):
                if docs[i][0] is not None and docs[j][0] is not None:
                    parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [
        (d, len(s), least.get(top(i)), d is None or least[top(i)] == d)
        for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))
    ]


def quality(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w, seen, again = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        windows, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if windows[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        symbols = sum(c in "#*$%&|<>" for c in t)
        out.append((d, len(w), sum(map(len, w)), symbols, again, len(covered), failed))
    return out


def secrets(docs):
    out = []
    for d, t in docs:
        t = t or ""
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
        for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 20), (2, "[0-9a-f]+", 24)):
            found += [
                (m.start(), kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least
            ]
        names = ("assign", "access", "hex")
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
        count = Counter(k for _, k, _ in found)
        out.append((d, count[0], count[1], count[2], sha(text)))
    return out
