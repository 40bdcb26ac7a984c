"""Chat formatting: tool-call linking with DataFrame functions only.

Calls and results are joined by (conversation, identifier). A call may name the call whose result
it needs (``after``); its level is the length of that chain. Levels come from pointer doubling:
each round joins the calls with themselves and doubles the known stretch, so a chain of n calls
takes log2(n) rounds, each written to the shared folder. (level, turn, identifier) is a
topological order of a conversation; no conversation is gathered in one task. Arguments are parsed
as variants, checked against the tool's schema and written as canonical JSON: sorted keys, no
white space.

Defined results: a call without a result is not linked; with several results the first by
(turn, text) counts; a parent that does not exist is ignored and listed as an error; calls on a
cycle have no level; arguments that are no JSON object are an error and null in the message; an
unknown tool is an error; a null conversation or identifier links with nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.common import stored

#: Tool -> field -> (JSON kind, required).
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "boolean": ("BOOLEAN",),
         "number": ("BIGINT", "DOUBLE", "DECIMAL")}
TOOLS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "translate": {"query": ("string", True), "limit": ("integer", False)},
    "summarise": {"query": ("string", True), "limit": ("integer", True),
                  "strict": ("boolean", True)},
}


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of distinct calls; null on a cycle."""
    ids = calls.where("conv_id is not null and call_id is not null").groupBy(
        "conv_id", "call_id").agg(F.min("after").alias("after"))
    parent = ids.select("conv_id", F.col("call_id").alias("after"), F.lit(1).alias("there"))
    state = stored(
        ids.join(parent, ["conv_id", "after"], "left").select(
            "conv_id", "call_id", F.when(F.col("there") == 1, F.col("after")).alias("jump"),
            F.coalesce("there", F.lit(0)).cast("long").alias("level")), "levels")
    total, waiting = state.agg(
        F.count(F.lit(1)), F.count("jump")).first()
    stretch = 1
    while waiting and stretch < 2 * total:
        far = state.select(
            "conv_id", F.col("call_id").alias("jump"), F.col("jump").alias("next"),
            F.col("level").alias("more"))
        state = stored(
            state.join(far, ["conv_id", "jump"], "left").select(
                "conv_id", "call_id", F.col("next").alias("jump"),
                (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        waiting = state.where("jump is not null").count()
        stretch *= 2
    return state.select(
        "conv_id", "call_id", F.when(F.col("jump").isNull(), F.col("level")).alias("level"))


def schema_errors(tool: Column, arguments: Column, tools: Schemas) -> Column:
    """Sorted error texts of parsed arguments (a variant object or null)."""
    kind = F.schema_of_variant(arguments)
    is_object = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    errors = [F.when(~is_object, "arguments: no object"),
              F.when(~F.coalesce(tool.isin(*tools), F.lit(False)), "tool: unknown")]
    for name, fields in tools.items():
        for field, (wanted, required) in fields.items():
            value = F.variant_get(arguments, f"$.{field}", "variant")
            found = F.schema_of_variant(value)
            fits = F.coalesce(
                F.regexp_extract(found, "^[A-Z]+", 0).isin(*KINDS[wanted]), F.lit(False))
            here = (tool == name) & is_object
            errors.append(F.when(here & value.isNotNull() & ~fits, f"{field}: not {wanted}"))
            if required:
                errors.append(F.when(here & value.isNull(), f"{field}: missing"))
    return F.array_sort(F.array_compact(F.array(*errors)))


def linked(calls: DataFrame, results: DataFrame, tools: Schemas = TOOLS) -> DataFrame:
    """One row per call: conv_id, turn, call_id, tool, level, n_results, errors, message.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON text), after; ``results``: conv_id,
    turn, call_id, text; other columns play no part."""
    calls = calls.select("conv_id", "turn", "call_id", "tool", "arguments", "after")
    answer = results.groupBy("conv_id", "call_id").agg(
        F.count(F.lit(1)).alias("n_results"),
        F.min(F.struct("turn", "text")).alias("first"))
    known = levels(calls).withColumn("known", F.lit(True))
    parent = known.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("there"))
    joined = (
        calls.join(answer, ["conv_id", "call_id"], "left")
        .join(known, ["conv_id", "call_id"], "left")
        .join(parent, ["conv_id", "after"], "left")
        .withColumn("parsed", F.try_parse_json("arguments"))
    )
    level = F.when(F.col("known"), F.col("level")).otherwise(
        F.when(F.col("known").isNull(), F.lit(0).cast("long")))
    errors = F.concat(
        schema_errors(F.col("tool"), F.col("parsed"), tools),
        F.array_compact(F.array(
            F.when(F.col("after").isNotNull() & F.col("there").isNull(), "after: unknown"),
            F.when(level.isNull(), "after: cycle"))))
    is_object = F.schema_of_variant("parsed").startswith("OBJECT")
    message = F.to_json(F.struct(  # keys in alphabetical order
        F.when(is_object, F.col("parsed")).alias("arguments"),
        F.col("call_id").alias("id"), F.col("tool").alias("name"),
        F.col("first.text").alias("result")))
    return joined.select(
        "conv_id", "turn", "call_id", "tool", level.alias("level"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        F.array_join(errors, "; ").alias("errors"), message.alias("message"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from a conversation table: a user turn is a call of a tool picked by
    its length, the assistant's next turn its result; a call needs the user turn two before."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    name = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (n % len(TOOLS) + 1).cast("int"))
    ident = lambda turn: F.concat(
        F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    limit = F.when(n % 11 != 0, n)
    arguments = F.to_json(F.struct(
        F.coalesce("text", F.lit("")).alias("query"), limit.alias("limit"),
        F.when(n % 5 != 0, n % 2 == 0).alias("strict")))
    calls = turns.where("role = 'user'").select(
        "conv_id", "turn", ident(turn).alias("call_id"), name.alias("tool"),
        arguments.alias("arguments"),
        F.when(turn >= 2, ident(turn - 2)).alias("after"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", "turn", ident(turn - 1).alias("call_id"), "text")
    return calls, results


SQL = """
WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
  row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
c AS (SELECT *, ['search', 'translate', 'summarise'][n % 3 + 1] AS tool,
  row_number() OVER (PARTITION BY conv_id, turn % 2, turn // 2 - k ORDER BY turn) - 1 AS level FROM u),
a AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min_by(text, turn) AS result
  FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
j AS (SELECT c.*, coalesce(a.n_results, 0) AS n_results, a.result FROM c LEFT JOIN a USING (conv_id, turn))
SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id, tool, level, n_results,
 concat_ws('; ', CASE WHEN n % 11 = 0 AND tool <> 'translate' THEN 'limit: missing' END,
  CASE WHEN n % 5 = 0 AND tool = 'summarise' THEN 'strict: missing' END,
  CASE WHEN turn >= 2 AND level = 0 THEN 'after: unknown' END) AS errors,
 '{"arguments":{' || CASE WHEN n % 11 <> 0 THEN '"limit":' || n || ',' ELSE '' END
 || '"query":' || CAST(to_json(text) AS VARCHAR)
 || CASE WHEN n % 5 = 0 THEN '' WHEN n % 2 = 0 THEN ',"strict":true' ELSE ',"strict":false' END
 || '},"id":"call-' || conv_id || '-' || turn || '","name":"' || tool || '"'
 || coalesce(',"result":' || CAST(to_json(result) AS VARCHAR), '') || '}' AS message
FROM j"""


def query(spark: SparkSession, folder: str) -> DataFrame:
    calls, results = from_turns(spark.read.parquet(f"{folder}/conversations.parquet"))
    return linked(calls, results)
