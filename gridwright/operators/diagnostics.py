"""Counts that ride along with a plan, and the shared invalid-value policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from gridwright.config import InvalidPolicy
from gridwright.functions.names import col, put


class Diagnostics:
    """Collects named counts through ``DataFrame.observe``: no extra pass over the data.

    Counts belong to the first action on the observed frame. A global sort runs its input
    twice (once to sample), which would count twice: the sinks stage their rows before sorting.
    """

    def __init__(self) -> None:
        self._observations: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, code: str, count: Column) -> DataFrame:
        observation = Observation(f"{code}-{len(self._observations)}")
        self._observations.append((code, observation))
        return df.observe(observation, count.cast("bigint").alias("n"))

    def counts(self) -> dict[str, int]:
        """Total per code, zero counts included."""
        totals: dict[str, int] = {}
        for code, observation in self._observations:
            totals[code] = totals.get(code, 0) + int(observation.get["n"] or 0)
        return totals


def watch(notes: Diagnostics | None, df: DataFrame, code: str, count: Column) -> DataFrame:
    return df if notes is None else notes.watch(df, code, count)


def settle(
    raw: Column, result: Column, policy: InvalidPolicy, message: str, kind: str
) -> Column:
    """Apply STOP to cells whose result is null although the source is not.

    NULL and PRESERVE leave the result as is; PRESERVE keeps the source text in a companion
    column, because a Spark column holds one type. The result is evaluated once.
    """
    if policy is not InvalidPolicy.STOP:
        return result
    error = F.raise_error(F.concat(F.lit(message + ": "), raw.cast("string"))).cast(kind)
    return F.coalesce(result, F.when(raw.isNotNull(), error))


def write_result(
    df: DataFrame,
    source: str,
    output: str | None,
    result: Column,
    kind: str,
    policy: InvalidPolicy,
    code: str,
    notes: Diagnostics | None,
) -> DataFrame:
    """Write a computed column under a policy.

    With counting or PRESERVE the result becomes a column of its own first, so that it is
    worked out once however often it is looked at.
    """
    raw, name = col(source), output or source
    if notes is None and policy is not InvalidPolicy.PRESERVE:
        message = f"{code} in {source}"
        return put(df, name, settle(raw, result, policy, message, kind), replaces=source)
    names = df.columns
    df = df.select("*", result.alias("__result"))
    failed = raw.isNotNull() & col("__result").isNull()
    df = watch(notes, df, code, F.count_if(failed))
    value = settle(raw, col("__result"), policy, f"{code} in {source}", kind)
    extra = (
        [F.when(failed, raw.cast("string")).alias(f"{name}_source")]
        if policy is InvalidPolicy.PRESERVE
        else []
    )
    if extra and f"{name}_source" in names:
        raise ValueError(f"column {name + '_source'!r} already exists")
    if name != source and name in names:
        raise ValueError(f"column {name!r} already exists")
    kept = [value.alias(n) if n == name else col(n) for n in names]
    if name not in names:
        kept.append(value.alias(name))
    return df.select(*kept, *extra)
