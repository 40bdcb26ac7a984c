"""Merkle manifest of a document table with octopus multiproofs.

Every row is a leaf: SHA-256 over its fields, each as ``-`` if null, else UTF-8 byte count, ``:``
and value. The leaves of one language ascend by document id and form a tree of runs of eight; the
languages' subroots form the top tree. Digests are hashed as lowercase hex text.

* **Positions** come from a range exchange: rows are sorted by (language, id, leaf) in ranges,
  counted per range, and each range starts at the sum of the counts before it.
* **Nodes** are worked out in rounds of three levels; a task sees at most 512 digests of a tree.
* **Proofs** of many leaves share most of their nodes. A leaf partition (``LEAVES`` neighbours of one
  language) walks from its leaves to the root and lists the coordinates that it can neither read
  nor derive: at most fourteen a level. One join fetches these for all partitions. The partition
  then derives the shared interiors once and expands a proof per leaf from them.

Defined results: a null id sorts first and is never tampered with; rows of one id are ordered by
their leaf, and equal rows are leaves of their own; a null language is a tree of its own, apart
from an empty one; a table of one row has its leaf as root and a proof without siblings; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.llm.common import arrow_map, documents, stored

#: Children of a node, and levels that one round works out.
WIDTH, LEVELS = 8, 3
#: Neighbouring leaves whose proofs are expanded together.
LEAVES = 3000
#: Copies of nodes above the second level in the join that fetches them, since all ask for these.
COPIES = 32
#: Name of the tree over the subroots; the trees of languages are "-" (null) or "=" and the name.
TOP = ""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = (bytes(range(65, 91)).decode(), bytes(range(97, 123)).decode())


def leaf_digest(text: Column | None = None) -> Column:
    """The 32 bytes of a row's leaf, with another text if one is given."""
    parts = []
    for name in FIELDS:
        kind = "long" if name in ("doc_id", "n_chars") else "string"
        value = F.col(name).cast(kind).cast("string")
        if name == "text" and text is not None:
            value = text
        coded = F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
        parts.append(F.coalesce(coded, F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, forged): ``forged`` is the leaf after tampering, null where untouched."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in FIELDS[1:]])
    lang = F.col("lang").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate(F.col("text").cast("string"), *LOWER)
    return rows.select(
        F.coalesce(F.concat(F.lit("="), lang), F.lit("-")).alias("tree"), "doc_id",
        leaf_digest().alias("leaf"), F.when(chosen, leaf_digest(lowered)).alias("forged"))


def numbered(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, the position inside its ``tree``, and ``n``, the tree's rows.

    ``order`` starts with ``tree``."""
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(sorted_rows.withColumn("at", F.monotonically_increasing_id()), label)
    placed = placed.withColumn("range", F.shiftright("at", 33))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
        .select("tree", "range", F.sum("rows").over(tree).alias("n"),
                (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    )
    return placed.join(starts, ["tree", "range"]).select(
        *rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


def count_at(n: int, level: int) -> int:
    """Nodes of a tree of ``n`` leaves at a level."""
    return -(-n // WIDTH**level)


def hashed(run: Sequence[bytes]) -> bytes:
    return sha256(b"".join(run)).hexdigest().encode()


def raised(level: int) -> Callable[[pa.Table], pa.Table]:
    """The nodes of up to ``LEVELS`` levels above one aligned block of a tree's ``level``."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        tree, n = table["tree"][0].as_py(), table["n"][0].as_py()
        first = table["idx"][0].as_py()
        digests = [d.hex().encode() for d in table["digest"].to_pylist()]
        out = []
        for above in range(level + 1, level + LEVELS + 1):
            if count_at(n, above - 1) == 1:
                break
            digests = [hashed(digests[i : i + WIDTH]) for i in range(0, len(digests), WIDTH)]
            first //= WIDTH
            out += [(above, first + i, bytes.fromhex(d.decode())) for i, d in enumerate(digests)]
        size = len(out)
        return pa.table({
            "tree": pa.array([tree] * size, pa.string()), "n": pa.array([n] * size, pa.int64()),
            "level": pa.array([o[0] for o in out], pa.int64()),
            "idx": pa.array([o[1] for o in out], pa.int64()),
            "digest": pa.array([o[2] for o in out], pa.binary())})

    return work


def interior_nodes(base: DataFrame, label: str) -> list[DataFrame]:
    """Tables (tree, n, level, idx, digest) of all nodes above ``base`` (tree, n, idx, digest)."""
    largest = base.agg(F.max("n")).first()[0] or 0
    found, level, span = [], 0, WIDTH**LEVELS
    while count_at(largest, level) > 1:

        block = F.floor(F.col("idx") / span).cast("long").alias("block")
        above = stored(
            base.groupBy("tree", block).applyInArrow(
                raised(level), "tree string, n long, level long, idx long, digest binary"), label)
        found.append(above)
        level += LEVELS
        more = F.ceil(F.col("n") / F.lit(float(WIDTH**level))) > 1
        base = above.where((F.col("level") == level) & more).select("tree", "n", "idx", "digest")
    return found


def missing(low: int, high: int, n: int) -> Iterator[tuple[int, int]]:
    """Coordinates (level, index) that the leaves [low, high) lack on their way to the root."""
    level, count = 0, n
    while count > 1:
        first, last = low // WIDTH * WIDTH, min(-(-high // WIDTH) * WIDTH, count)
        for idx in (*range(first, low), *range(high, last)):
            yield level, idx
        low, high = first // WIDTH, -(-last // WIDTH)
        level, count = level + 1, count_at(n, level + 1)


def coordinates(parts: DataFrame) -> DataFrame:
    """The minimal union of node coordinates of each leaf partition, and the root's. ``parts``:
    tree, part, low, high, n, place (of the tree among the trees), trees."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for row in batch.to_pylist():
            n, trees, who = row["n"], row["trees"], (row["tree"], row["part"])
            top = TOP if trees > 1 else row["tree"]
            size = trees if trees > 1 else n
            height = 0
            while count_at(size, height) > 1:
                height += 1
            out += [(*who, row["tree"], *c, "lang") for c in missing(row["low"], row["high"], n)]
            out += [(*who, TOP, *c, "top") for c in missing(row["place"], row["place"] + 1, trees)]
            out.append((*who, top, height, 0, "root"))
        columns = list(zip(*out, strict=True))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            ["asker", "part", "tree", "level", "idx", "role"])

    return arrow_map(
        parts.select("tree", "part", "low", "high", "n", "place", "trees"), work,
        "asker string, part long, tree string, level long, idx long, role string")


def climb(own: list[bytes], low: int, n: int, known: dict) -> tuple[list, bytes]:
    """Levels (first index, digests of whole runs) above neighbouring nodes, and the root."""
    levels, level = [], 0
    while count_at(n, level) > 1:
        count, high = count_at(n, level), low + len(own)
        first, last = low // WIDTH * WIDTH, min(-(-high // WIDTH) * WIDTH, count)
        whole = ([known[level, i] for i in range(first, low)] + own
                 + [known[level, i] for i in range(high, last)])
        levels.append((first, whole))
        own = [hashed(whole[i : i + WIDTH]) for i in range(0, len(whole), WIDTH)]
        low, level = first // WIDTH, level + 1
    return levels, own[0]


RESULT = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean, n_siblings long")


def expand(key: tuple, mine: pa.Table, fetched: pa.Table) -> pa.Table:
    """The proofs of one leaf partition from its leaves and the fetched nodes."""
    mine = mine.sort_by("idx")
    known: dict[str, dict] = {"lang": {}, "top": {}, "root": {}}
    for role, level, idx, digest in zip(
            *(fetched[c].to_pylist() for c in ("role", "level", "idx", "digest")), strict=True):
        known[role][level, idx] = digest.hex().encode()
    (root,) = known["root"].values()
    own = [d.hex().encode() for d in mine["leaf"].to_pylist()]
    low, n = mine["idx"][0].as_py(), mine["n"][0].as_py()
    place, trees = mine["place"][0].as_py(), mine["trees"][0].as_py()
    in_lang, subroot = climb(own, low, n, known["lang"])
    in_top, derived = climb([subroot], place, trees, known["top"])
    # Siblings above a node, shared by all leaves below it.
    tail, amount = {place: b""}, {place: 0}
    for depth in range(len(in_top) - 1, -1, -1):
        first, whole = in_top[depth]
        run = [w for i, w in enumerate(whole, first) if i != place // WIDTH**depth]
        tail[place] = b"".join(run) + tail[place]
        amount[place] += len(run)
    at_top = True
    for depth in range(len(in_lang) - 1, -1, -1):
        first, whole = in_lang[depth]
        below_tail, below_amount = {}, {}
        for i in range(len(whole)):
            start = i // WIDTH * WIDTH
            run = whole[start : start + WIDTH]
            above = place if at_top else (first + i) // WIDTH
            if above in tail:
                below_tail[first + i] = b"".join(run[: i - start] + run[i - start + 1 :]) + tail[above]
                below_amount[first + i] = len(run) - 1 + amount[above]
        tail, amount, at_top = below_tail, below_amount, False

    def fold(digest: bytes, idx: int) -> bytes:
        for (first, whole), at in path(idx):
            start = at // WIDTH * WIDTH - first
            run = whole[start : start + WIDTH]
            run[at % WIDTH] = digest
            digest = hashed(run)
        return digest

    def path(idx: int) -> Iterator[tuple]:
        for level in in_lang:
            yield level, idx
            idx //= WIDTH
        idx = place
        for level in in_top:
            yield level, idx
            idx //= WIDTH

    out = {name: [] for name in ("proof", "folded", "count")}
    for i, forged in enumerate(mine["forged"].to_pylist(), low):
        above = place if at_top else i
        out["proof"].append(sha256(tail[above]).hexdigest())
        out["count"].append(amount[above])
        changed = forged is not None and forged.hex().encode() != own[i - low]
        out["folded"].append((fold(forged.hex().encode(), i) if changed else derived).decode())
    size, expected = len(own), root.decode()
    return pa.table({
        "doc_id": mine["doc_id"], "leaf": [d.decode() for d in own],
        "subroot": [subroot.decode()] * size, "root": [expected] * size,
        "proof_sha256": out["proof"], "folded_root": out["folded"],
        "verified": [f == expected for f in out["folded"]],
        "n_siblings": pa.array(out["count"], pa.int64())})


def manifest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified and
    n_siblings. ``docs``: doc_id, source, lang, n_chars, text and any others."""
    rows = numbered(leaves(docs), ["tree", "doc_id", "leaf"], "leaves")
    base = rows.select("tree", "n", "idx", F.col("leaf").alias("digest"))
    inner = interior_nodes(base, "nodes")
    nodes = base.withColumn("level", F.lit(0).cast("long"))
    for table in inner:
        nodes = nodes.unionByName(table)
    tops = nodes.where((F.col("idx") == 0) & (F.pow(F.lit(float(WIDTH)), F.col("level")) >= F.col("n")))
    subroots = numbered(
        tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest"),
        ["tree", "name"], "subroots")
    top_base = subroots.select("tree", "n", "idx", "digest")
    nodes = nodes.unionByName(top_base.withColumn("level", F.lit(0).cast("long")))
    for table in interior_nodes(top_base, "top-nodes"):
        nodes = nodes.unionByName(table)

    places = subroots.select(
        F.col("name").alias("tree"), F.col("idx").alias("place"), F.col("n").alias("trees"))
    rows = rows.withColumn("part", F.floor(F.col("idx") / LEAVES).cast("long"))
    parts = (
        rows.groupBy("tree", "part")
        .agg(F.min("idx").alias("low"), (F.max("idx") + 1).alias("high"), F.max("n").alias("n"))
        .join(places, "tree"))
    parts = stored(parts, "leaf-parts")
    wanted_by_all = (F.col("level") >= 2) | (F.col("tree") == TOP)
    asked = coordinates(parts).withColumn(
        "copy", F.when(wanted_by_all, F.col("part") % COPIES).otherwise(0))
    last = F.when(wanted_by_all, COPIES - 1).otherwise(0).cast("long")
    offered = nodes.select(
        "tree", "level", "idx", "digest",
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("copy"))
    fetched = asked.join(offered, ["tree", "level", "idx", "copy"]).select(
        F.col("asker").alias("tree"), "part", "role", "level", "idx", "digest")
    mine = rows.join(
        parts.select("tree", "part", "place", "trees"), ["tree", "part"]).select(
        "tree", "part", "doc_id", "leaf", "forged", "idx", "n", "place", "trees")
    return mine.groupBy("tree", "part").cogroup(fetched.groupBy("tree", "part")).applyInArrow(
        expand, RESULT)


def _sql(height: int = 7) -> str:
    """DuckDB SQL for trees of up to 8^height leaves, with the checksum by its polynomial."""
    def field(name: str, value: str) -> str:
        return f"coalesce(octet_length(encode({value}))::VARCHAR || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        values = [text if f == "text" else f"{f}::VARCHAR" for f in FIELDS]
        return f"sha256({' || '.join(field(*p) for p in zip(FIELDS, values, strict=True))})"

    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, "
           "length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)), "
           "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")
    upper = "".join(chr(c) for c in range(65, 91))
    steps, proofs = [], []

    def climb(name: str, base: str) -> None:
        at = base
        for level in range(height):
            up = f"{name}{level + 1}"
            steps.append(f"""{name}r{level} AS (SELECT tree, idx // 8 AS idx, list(digest ORDER BY idx) AS run,
 any_value(n) AS n FROM {at} GROUP BY 1, 2)""")
            steps.append(f"""{up} AS (SELECT tree, idx, (n + 7) // 8 AS n,
 CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {name}r{level})""")
            at = up

    climb("l", "leaf0")
    steps.append(f"""top0 AS (SELECT '' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS idx,
 count(*) OVER () AS n FROM l{height})""")
    climb("t", "top0")
    joins = []
    for name, place in (("l", "d.idx"), ("t", "p.idx")):
        for level in range(height):
            r, at = f"{name}{level}_", f"({place} // {8**level})"
            tree = "d.tree" if name == "l" else "''"
            joins.append(f"JOIN {name}r{level} AS {r} ON {r}.tree = {tree} AND {r}.idx = {at} // 8")
            others = f"list_filter({r}.run, lambda x, i: i <> {at} % 8 + 1)"
            proofs.append(f"array_to_string({others}, '')")
    hops = []
    source = "picked"
    for name, place in (("l", "lidx"), ("t", "tidx")):
        for level in range(height):
            hop = f"f{name}{level}"
            hops.append(f"""{hop} AS (SELECT f.* EXCLUDE (cur), CASE WHEN r.n = 1 THEN cur ELSE sha256(array_to_string(
 list_transform(r.run, lambda x, i: CASE WHEN i = (f.{place} // {8**level}) % 8 + 1 THEN f.cur ELSE x END), '')) END AS cur
 FROM {source} AS f JOIN {name}r{level} AS r ON r.tree = {"f.tree" if name == "l" else "''"}
 AND r.idx = f.{place} // {8**level} // 8)""")
            source = hop
    return f"""
WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM range(256) AS x(b) UNION ALL
 SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
raw AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf("text")} AS leaf,
 CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{upper.lower()}')")} END AS forged FROM documents, crc_table),
leaf0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
 count(*) OVER (PARTITION BY tree) AS n FROM raw),
{", ".join(steps)},
picked AS (SELECT d.doc_id, d.tree, d.leaf, d.idx AS lidx, p.idx AS tidx, p.digest AS subroot,
 coalesce(d.forged, d.leaf) AS cur, sha256({" || ".join(proofs)}) AS proof_sha256,
 {" + ".join(f"len({n}{i}_.run) - 1" for n in "lt" for i in range(height))} AS n_siblings
 FROM leaf0 AS d JOIN top0 AS p ON p.name = d.tree {" ".join(joins)}),
{", ".join(hops)}
SELECT f.doc_id, f.leaf, f.subroot, t.digest AS root, f.proof_sha256, f.cur AS folded_root,
 f.cur = t.digest AS verified, f.n_siblings FROM {source} AS f, t{height} AS t"""


SQL = _sql()


def query(spark: SparkSession, folder: str) -> DataFrame:
    return manifest(documents(spark, folder))
