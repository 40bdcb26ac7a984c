"""Average: markers, timestamp and field preparation, stages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from gridwright.config import (
    AveragingConfig,
    InvalidPolicy,
    MissingOutput,
    Statistic,
)
from gridwright.functions import zones
from gridwright.functions.names import col, dtype, is_text, is_wall, put
from gridwright.functions.numeric import to_decimal, to_double
from gridwright.functions.temporal import Profile
from gridwright.operators import cells, moments
from gridwright.operators.averaging import AveragingResult, average
from gridwright.operators.diagnostics import Diagnostics
from gridwright.plans.formats import resolve


@dataclass(frozen=True)
class AveragePlan:
    config: AveragingConfig
    source_zone: str = "UTC"
    profile: str | None = "iso_minute"
    markers: tuple[object, ...] = ()
    missing: MissingOutput = MissingOutput.TRUE_NULL
    missing_custom: object = None
    exact: bool = False


# Words in a column name, letters and digits only, and the statistic they suggest.
SUGGESTED = {
    "laeq": Statistic.ENERGY_AVERAGE_LEQ,
    "lceq": Statistic.ENERGY_AVERAGE_LEQ,
    "lzeq": Statistic.ENERGY_AVERAGE_LEQ,
    "rainrate": Statistic.RAIN_RATE_MEAN,
    "rainfall": Statistic.RAINFALL_ACCUMULATION,
    "rainamount": Statistic.RAINFALL_ACCUMULATION,
}
# Output suffixes that are not the statistic's first word.
SHORT = {
    Statistic.ARITHMETIC_MEAN: "Mean",
    Statistic.MINIMUM: "Min",
    Statistic.MAXIMUM: "Max",
    Statistic.STANDARD_DEVIATION: "Std Dev",
    Statistic.ENERGY_AVERAGE_LEQ: "Energy Avg",
    Statistic.RAINFALL_ACCUMULATION: "Sum",
    Statistic.RAIN_RATE_MEAN: "Mean",
}
_WORD = re.compile("|".join(SUGGESTED))


def suggest_statistic(column: str) -> str:
    """Advisory statistic by name; the caller confirms."""
    letters = re.sub(r"[\W_]", "", column.casefold())
    if letters == "leq":
        return Statistic.ENERGY_AVERAGE_LEQ.value
    hits = set(_WORD.findall(letters))
    best = next((s for word, s in SUGGESTED.items() if word in hits), Statistic.ARITHMETIC_MEAN)
    return best.value


def suggest_output(column: str, statistic: str) -> str:
    which = Statistic(statistic)
    return f"{column} - {SHORT.get(which, which.split('_')[0].capitalize())}"


def readiness(df: DataFrame, plan: AveragePlan) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a plan for a table, from its columns alone: nothing is
    read. What a configuration cannot say by itself (names, stages) is refused when it is made."""
    config, have = plan.config, set(df.columns)
    inputs = {n for f in config.fields for n in f.inputs}
    used = {config.timestamp, *config.keys, *inputs}
    found = {f"column {n} is missing": n not in have for n in sorted(used)}
    found |= {
        "the timestamp is also a field or a key": config.timestamp in {*inputs, *config.keys},
        "the custom missing value is empty": plan.missing is MissingOutput.CUSTOM
        and not str(plan.missing_custom or "").strip(),
    }
    for n in sorted(inputs & have):
        kind = dtype(df, n)
        readable = is_text(kind) or isinstance(kind, T.NumericType | T.DayTimeIntervalType)
        found[f"{n}: no numbers can be read from {kind.simpleString()}"] = not readable
    if config.timestamp in have:
        kind = dtype(df, config.timestamp)
        instant = isinstance(kind, T.TimestampType) or is_wall(kind)
        found["text timestamps need a profile"] = is_text(kind) and plan.profile is None
        found[f"{config.timestamp}: no timestamps in {kind.simpleString()}"] = not (
            instant or is_text(kind))
    warned = {}
    for f in config.fields:
        fits = suggest_statistic(f.column)
        energy = Statistic.ENERGY_AVERAGE_LEQ.value
        warned[f"{f.column}: its name suggests {fits.replace('_', ' ')}"] = (
            fits != f.statistic.value and fits != Statistic.ARITHMETIC_MEAN.value)
        warned[f"{f.column}: an energy average of a column that names no level"] = (
            f.statistic.value == energy and fits != energy)
    return [m for m, wrong in found.items() if wrong], [m for m, doubtful in warned.items() if doubtful]


def prepare(df: DataFrame, plan: AveragePlan, notes: Diagnostics | None = None) -> DataFrame:
    """Instant timestamps (missing or unreadable ones are an error) and finite numeric fields
    (unreadable cells become null)."""
    config = plan.config
    ts = config.timestamp
    if plan.markers:
        df = cells.normalize_nulls(df, plan.markers, notes=notes)
    if plan.profile is not None:
        fmt = resolve(plan.profile)
        if not isinstance(fmt, Profile) or fmt.kind != "datetime":
            raise ValueError("the timestamp profile must produce datetimes")
        df = moments.parse_datetime(df, ts, fmt, policy=InvalidPolicy.STOP)
    missing = F.raise_error(F.lit(f"a timestamp is missing in {ts}"))
    kind = dtype(df, ts)
    value = col(ts)
    if is_wall(kind):
        value = zones.localize_lenient(value, zones.canonical_zone(plan.source_zone))
    df = put(df, ts, F.coalesce(value, missing.cast("timestamp")), replaces=ts)
    names = {n for f in config.fields for n in f.inputs}
    read = to_decimal if plan.exact else to_double
    for n in sorted(names):
        df = put(df, n, read(col(n), dtype(df, n)), replaces=n)
    return df


def run_average(
    df: DataFrame, plan: AveragePlan, *, strict: bool = True, notes: Diagnostics | None = None
) -> AveragingResult:
    return average(prepare(df, plan, notes), plan.config, strict=strict)
