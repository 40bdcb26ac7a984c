"""An ordered list of operators with an audit of what each did to the schema."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Step:
    """One operator call: ``function(df, *args, **options)``."""

    operation: str
    function: Callable[..., DataFrame]
    args: tuple = ()
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class AuditEntry:
    operation: str
    input_columns: tuple[str, ...]
    output_columns: tuple[str, ...]


def step(function: Callable[..., DataFrame], *args: object, **options: object) -> Step:
    return Step(function.__name__, function, args, options)


def run_steps(
    df: DataFrame, steps: Sequence[Step], version: int = SCHEMA_VERSION
) -> tuple[DataFrame, list[AuditEntry]]:
    """Fold the steps into one lazy plan. Counts come from the steps' own diagnostics."""
    if version != SCHEMA_VERSION:
        raise ValueError(f"unsupported plan version {version}")
    audit = []
    for s in steps:
        before = tuple(df.columns)
        df = s.function(df, *s.args, **s.options)
        audit.append(AuditEntry(s.operation, before, tuple(df.columns)))
    return df, audit
