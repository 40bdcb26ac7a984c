"""Conversation structure repair with a suffix-shared automaton.

Rows of a conversation become one symbol each: who speaks (system, user, assistant, other) and
whether the row is cut off, or that it has to go. Equal symbol strings are one word.

* **Signatures** are strung together by a pass over rows sorted by (conversation, turn).
* **Automaton.** Words are sorted from their ends over all tasks, so words with a common ending are
  neighbours. A pass keeps the nodes of the present word on a stack and drops only those that
  the next word does not share: every distinct ending is one node, worked out once (once more where
  a range of the sort starts inside it). A node holds for each grammar state the cost to go, the
  letters of the cheapest edits up to and including its first row, and the state that follows;
  nodes with equal relative costs share one table. Letters are chosen from the end, the smallest of equally
  cheap ones: a letter leads to one state only, so this is the smallest audit.
* **Repair** streams the rows, sorted as before, behind their conversation's audit into a hash.

Memory: a task holds one batch of rows and one word with its nodes; texts are never gathered. A
conversation's hash needs its rows one after the other, so they pass through one task.

Defined results: null ids, turns, roles and texts are read as one space (a null id is a conversation of its own);
rows of one turn are ordered by role, then by the SHA-256 of both; repeated rows are duplicates; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import stored

WHITE = " \t\n\v\f\r"
#: Costs of the edits; a cut-off row that stays costs one more.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: Grammar states: at the start, behind a system turn, behind a user turn, behind an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> state after the turn that the grammar wants next (the one inserted or given by a new role).
WANTED = (USER, USER, ASSISTANT, USER)
#: Symbol -> state -> state after keeping the row.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
        "a": {USER: ASSISTANT}, "o": {}}
GONE = "x"
#: Copies of the words in the join with their conversations, since a third may share a word.
COPIES = 16

STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, text, copy) after the damage; dropped rows have a null copy."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    one, none = F.array(F.lit(0)), F.array(F.lit(None).cast("int"))
    copies = F.when(kind == 0, none).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(one)
    text = (F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", ""))
            .otherwise(space("text")))
    return turns.select(
        space("conv_id").alias("conv"), F.col("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy"))


def content() -> Column:
    """The digest of role and text."""
    size = F.octet_length("role").cast("string")
    return F.unhex(F.sha2(F.concat(size, F.lit(":"), F.col("role"), F.col("text")), 256))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation in one partition, by turn (null first), role and content."""
    order = ["conv", *first, "turn", "role", "content", "copy"]
    return rows.repartition("conv").sortWithinPartitions(*order)


def symbols(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, turn, role, content, copy, initial, fault) of damaged rows. ``fault``: b, d, t
    or a space; a row is a duplicate if an earlier row, or one equal to it of its turn, stands before it."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    narrow = rows.select(
        "conv", "conv_id", "turn", "role", "copy", content().alias("content"),
        (trimmed == "").alias("is_blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("is_cut"))
    repeated = (
        narrow.where(F.col("copy").isNotNull() & ~F.col("is_blank")).groupBy("conv", "content")
        .agg(F.count("*").alias("n"), F.max(F.col("turn").isNull()).alias("null_first"),
             F.min("turn").alias("first"))
        .where("n > 1").drop("n"))
    later = F.when(F.col("null_first"), F.col("turn").isNotNull()).otherwise(
        F.coalesce(F.col("turn") > F.col("first"), F.lit(False)))
    return narrow.join(repeated, ["conv", "content"], "left").select(
        "conv", "conv_id", "turn", "role", "content", "copy", F.substring("role", 1, 1).alias("initial"),
        F.when(F.col("is_blank"), "b").when(F.coalesce(later, F.lit(False)), "d")
        .when(F.col("is_cut"), "t").otherwise(" ").alias("fault"))


class _Signature:
    """One conversation while its rows pass."""

    def __init__(self, conv: str, conv_id):
        self.conv, self.conv_id = conv, conv_id
        self.word: list[str] = []
        self.low = self.high = self.turn = self.before = None
        self.distinct = self.illegal = 0
        self.counts = {"b": 0, "d": 0, "t": 0, " ": 0}
        self.last = ""

    def add(self, turn, role: str, digest: bytes, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.high
            self.high = turn
        if self.before == (turn, role, digest) and fault in "t ":
            fault = "d"
        if self.before and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before, self.last = (turn, role, digest), initial
        self.counts[fault] += 1
        known = initial if initial in ("s", "u", "a") else "o"
        self.word.append(GONE if fault in "bd" else known.upper() if fault == "t" else known)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (self.conv, self.conv_id, "".join(self.word), gaps, self.counts["b"],
                self.counts["d"], self.counts["t"], self.illegal)


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, conv_id, word, gaps, blank, duplicate, truncated, illegal) per conversation."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv string, conv_id {conv_type}, word string, " + ", ".join(f"{s} long" for s in STATS)
    names = ["conv", "conv_id", "turn", "role", "content", "copy", "initial", "fault"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, id_type = None, None
        for batch in batches:
            id_type, done = batch.schema.field("conv_id").type, []
            for conv, conv_id, turn, role, digest, copy, initial, fault in zip(
                    *(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Signature(conv, conv_id)
                if copy is not None:
                    now.add(turn, role, digest, initial, fault)
            yield from _rows(done, id_type)
        if now:
            yield from _rows([now.row()], id_type)

    def _rows(done: list[tuple], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        if done:
            kinds = [pa.string(), id_type, pa.string(), *[pa.int64()] * len(STATS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)],
                ["conv", "conv_id", "word", *STATS])

    return in_order(symbols(rows)).select(*names).mapInArrow(work, schema)


def node(symbol: str, to_go: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[tuple[str, int], ...]]:
    """Costs to go by state, and (letters, state after the first row), of a node whose first row is
    ``symbol`` and whose rest has the costs ``to_go``."""
    cut = CUT_OFF if symbol.isupper() else 0
    used: list[dict[str, tuple[int, int]]] = []
    for state in range(4):
        ways = {"D": (DELETE + to_go[state], state)}
        if symbol != GONE:
            after = KEPT[symbol.lower()].get(state)
            if after is not None:
                ways["K"] = (KEEP + cut + to_go[after], after)
            ways["R"] = (REROLE + cut + to_go[WANTED[state]], WANTED[state])
        used.append(ways)
    direct = [min(w[0] for w in ways.values()) for ways in used]
    cost = list(direct)
    cost[USER] = min(direct[USER], INSERT + direct[ASSISTANT])
    cost[ASSISTANT] = min(direct[ASSISTANT], INSERT + direct[USER])
    for state in (START, SYSTEM):
        cost[state] = min(direct[state], INSERT + cost[USER])
    moves = []
    for state in range(4):
        letters = ""
        while True:
            ways = {k: c for k, (c, _) in used[state].items()} | {"I": INSERT + cost[WANTED[state]]}
            letter = min(k for k, c in ways.items() if c == cost[state])
            letters += letter
            if letter != "I":
                break
            state = WANTED[state]
        moves.append((letters, used[state][letter][1]))
    return tuple(cost), tuple(moves)


class Automaton:
    """The nodes of the present word, from its end; words come sorted by their reversed text."""

    #: Letters and costs to go behind the last row.
    END_LETTERS = ("", "II", "I", "")
    END_COSTS = (0, 4, 2, 0)

    def __init__(self):
        self.word = ""
        self.stack = [(0, self.END_COSTS, None)]  # least cost, costs above it, moves
        self.tables: dict = {}
        self.made = 0

    def take(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of a word given from its end."""
        shared, most = 0, min(len(self.word), len(backwards))
        while shared < most and self.word[shared] == backwards[shared]:
            shared += 1
        del self.stack[shared + 1 :]
        for symbol in backwards[shared:]:
            base, costs, _ = self.stack[-1]
            if (symbol, costs) not in self.tables:
                above, moves = node(symbol, costs)
                least = min(above)
                self.tables[symbol, costs] = least, tuple(c - least for c in above), moves
            more, costs, moves = self.tables[symbol, costs]
            self.stack.append((base + more, costs, moves))
            self.made += 1
        self.word = backwards
        letters, state = [], START
        for _, _, moves in reversed(self.stack[1:]):
            text, state = moves[state]
            letters.append(text)
        letters.append(self.END_LETTERS[state])
        base, costs, _ = self.stack[-1]
        return base + costs[START], "".join(letters)


def audits(words: DataFrame) -> DataFrame:
    """(word, cost, audit) of distinct words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            backwards = batch.column(0).to_pylist()
            found = [automaton.take(b) for b in backwards]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b[::-1] for b in backwards], pa.string()),
                 pa.array([f[0] for f in found], pa.int64()),
                 pa.array([f[1] for f in found], pa.string())], ["word", "cost", "audit"])

    backwards = words.select(F.reverse("word").alias("backwards")).distinct()
    return backwards.repartitionByRange("backwards").sortWithinPartitions("backwards").mapInArrow(
        work, "word string, cost long, audit string")


class _Repair:
    """The hash of one conversation while its rows pass."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START
        self.hash, self.empty = sha256(), True

    def _write(self, role: str, text: str) -> None:
        self.hash.update((f"{role}:{text}" if self.empty else f"\n{role}:{text}").encode())
        self.empty = False

    def _wanted(self, text: str) -> None:
        self.state = WANTED[self.state]
        self._write("user" if self.state == USER else "assistant", text)

    def inserts(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._wanted("")

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = KEPT[role[0]][self.state]
            self._write(role, text)
        elif letter == "R":
            self._wanted(text)

    def digest(self) -> str:
        self.inserts()
        return self.hash.hexdigest()


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256."""
    rows = damaged(turns)
    found = stored(signatures(rows), "signatures")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPIES - 1).cast("long")))
    known = stored(audits(found), "audits").withColumn("part", every)
    heads = found.withColumn("part", F.pmod(F.xxhash64("conv"), F.lit(COPIES))).join(
        known, ["word", "part"]).select("conv", "conv_id", *STATS, "cost", "audit")
    conv_type = turns.schema["conv_id"].dataType.simpleString()
    blank = {c: F.lit(None).cast("long") for c in (*STATS, "cost")}
    columns = ["conv", "kind", "conv_id", "turn", "role", "content", "copy", "text", *STATS, "cost", "audit"]
    head_rows = heads.withColumns({
        "kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(""),
        "content": F.lit(None).cast("binary"), "copy": F.lit(0), "text": F.lit("")}).select(*columns)
    text_rows = (
        rows.where(F.col("copy").isNotNull()).withColumn("content", content())
        .withColumns({"kind": F.lit(1), "audit": F.lit(None).cast("string"), **blank}).select(*columns))
    stream = in_order(head_rows.unionByName(text_rows), "kind").select(
        "kind", "role", "text", "conv_id", *STATS, "cost", "audit")
    result = ["conv_id", *STATS, "cost", "audit", "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head = None, None
        for batch in batches:
            done = []
            for i, (kind, role, text) in enumerate(zip(
                    *(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if kind:
                    now.row(role, text)
                    continue
                if now:
                    done.append((head, now.digest()))
                # a row of its own, so that no batch is kept alive
                head = pa.RecordBatch.from_arrays(
                    [pa.array(c.slice(i, 1).to_pylist(), c.type) for c in batch.columns[3:]], result[:-1])
                now = _Repair(head.column(head.num_columns - 1)[0].as_py())
            yield from _results(done)
        if now:
            yield from _results([(head, now.digest())])

    def _results(done: list) -> Iterator[pa.RecordBatch]:
        if done:
            table = pa.Table.from_batches([h for h, _ in done])
            table = table.append_column(result[-1], pa.array([d for _, d in done], pa.string()))
            yield from table.combine_chunks().to_batches()

    return stream.mapInArrow(
        work, f"conv_id {conv_type}, " + ", ".join(f"{c} long" for c in (*STATS, "cost"))
        + ", audit string, repaired_sha256 string")


def _sql() -> str:
    def add(cost: int, letter: str, value: str) -> str:
        return f"printf('%09d', substr({value}, 1, 9)::BIGINT + {cost}) || '{letter}' || substr({value}, 10)"

    def cheapest(state: int) -> str:
        after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
        wanted = (2, 2, 3, 2)[state]
        ways = [add(3, "D", f"p.v{state}")]
        for role in "sua":
            if state in after[role]:
                for symbol, cost in ((role, 0), (role.upper(), 1)):
                    kept = add(cost, "K", f"p.v{after[role][state]}")
                    ways.append(f"CASE WHEN symbol = '{symbol}' THEN {kept} END")
        for cost in (0, 1):
            have = "symbol IN ('s', 'u', 'a', 'o')" if not cost else "symbol IN ('S', 'U', 'A', 'O')"
            ways.append(f"CASE WHEN {have} THEN {add(2 + cost, 'R', f'p.v{wanted}')} END")
        return f"least({', '.join(ways)})"

    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(k) + 1), "
           "lambda i: ascii(substr(k, i::INT, 1))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    order = "ORDER BY turn NULLS FIRST, role, content"
    return f"""
WITH RECURSIVE bits AS (SELECT b, b AS c, 0 AS k FROM range(256) AS x(b) UNION ALL
 SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 coalesce(conv_id::VARCHAR, ' ') AS conv, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT src.*, {crc} % 20 AS h FROM src, crc_table),
hurt AS (SELECT conv, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
 CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE h > 0),
marked AS (SELECT *, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS content,
 rtrim(text, {white}) AS core FROM hurt),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv {order}) AS i, count(*) OVER (PARTITION BY conv) AS n,
 lag(left(role, 1)) OVER (PARTITION BY conv {order}) || left(role, 1) AS pair FROM marked),
judged AS (SELECT *, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, content ORDER BY i) > 1 THEN 'd' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
named AS (SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN upper(who) ELSE who END AS symbol
 FROM (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS who FROM judged)),
dp AS (SELECT conv, n AS i, '000000000' AS v0, '000000004II' AS v1, '000000002I' AS v2, '000000000' AS v3
 FROM (SELECT DISTINCT conv, n FROM named) UNION ALL
 SELECT conv, i, least(g0, {add(2, "I", "f2")}), least(g1, {add(2, "I", "f2")}), f2, least(g3, {add(2, "I", "g2")})
 FROM (SELECT *, least(g2, {add(2, "I", "g3")}) AS f2 FROM (SELECT p.conv, p.i - 1 AS i, {cheapest(0)} AS g0,
 {cheapest(1)} AS g1, {cheapest(2)} AS g2, {cheapest(3)} AS g3 FROM dp AS p JOIN named AS s ON s.conv = p.conv AND s.i = p.i WHERE p.i > 0))),
best AS (SELECT conv, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM dp WHERE i = 0),
letters AS (SELECT conv, p, substr(audit, p::INT, 1) AS letter FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM best)),
walked AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS e
 FROM letters WINDOW w AS (PARTITION BY conv ORDER BY p)),
met AS (SELECT w.*, s.role, s.text, max(w.e = 1 AND w.letter = 'K' AND s.who = 's') OVER (PARTITION BY w.conv) AS led
 FROM walked AS w LEFT JOIN named AS s ON s.conv = w.conv AND s.i = w.i AND w.letter <> 'I' WHERE w.letter <> 'D'),
mended AS (SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role
 WHEN (e - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha FROM met GROUP BY 1),
stats AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
 count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
 count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM named GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
 coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
 coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM src) AS o LEFT JOIN stats USING (conv) LEFT JOIN best USING (conv) LEFT JOIN mended USING (conv)"""


SQL = _sql()


def query(spark: SparkSession, folder: str) -> DataFrame:
    return repair(spark.read.parquet(f"{folder}/conversations.parquet"))
