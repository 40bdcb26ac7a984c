"""JSON recipes: a closed, versioned description compiled into a reformat or average plan.

Unknown keys and kinds are refused; a recipe holds names and parameters, never code.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, time, timedelta
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridwright.config import (
    PERIODS,
    AveragingConfig,
    Completeness,
    Derivation,
    FieldRule,
    GapBehavior,
    MissingOutput,
    Period,
    PeriodKind,
    Season,
    Stage,
    Statistic,
    TimestampRole,
)
from gridwright.errors import DataViolation
from gridwright.functions.names import col
from gridwright.operators.averaging import AveragingResult
from gridwright.operators.cells import ROW_MODES
from gridwright.operators.diagnostics import Diagnostics
from gridwright.plans.average import AveragePlan, run_average
from gridwright.plans.reformat import POLICY, ReformatColumn, ReformatPlan, ReformatResult, reformat
from gridwright.sources import sinks
from gridwright.sources.delimited import DelimitedOptions, read_delimited
from gridwright.sources.verify import verify_output

# Allowed keys per section (required ones first, then optional).
SECTIONS = {
    "recipe": (
        {"source", "columns", "output"},
        {"schema_version", "recipe_name", "mode", "timestamp", "missing_data", "gap_policy",
         "aggregation", "keys"},
    ),
    "source": ({"file_type"}, {"worksheet", "expected_columns", "missing_markers"}),
    "column": (
        {"source_name", "output_name"}, {"export", "semantic_type", "transformations", "aggregation"},
    ),
    "transformation": ({"kind"}, {"parameters"}),
    "timestamp": (
        {"column", "role"},
        {"duration_seconds", "input_profile", "output_profile", "source_timezone", "target_timezone"},
    ),
    "missing_data": (
        set(),
        {"confirmed_null_markers", "numeric_columns", "invalid_numeric_policy", "remove_null_rule"},
    ),
    "remove_null_rule": ({"mode", "columns"}, {"minimum_present"}),
    "gap_policy": (
        {"timestamp_column", "interval_seconds", "measurement_columns"},
        {"field_policies", "allow_reorder", "index_column", "index_start", "generated_flag_column"},
    ),
    "field_policy": ({"column", "behavior"}, {"fixed_value", "derivation", "timezone_name"}),
    "aggregation": (
        {"timestamp_column", "input_interval_seconds", "reporting_timezone", "fields", "stages"},
        {"approach", "allow_reorder", "max_periods"},
    ),
    "field": ({"column"}, {"statistic", "output_name", "duration_column"}),
    "stage": ({"period"}, {"completeness", "label"}),
    "period": (
        {"kind"},
        {"duration_seconds", "day_start", "week_start", "anchor", "quarter_start_month",
         "year_start_month", "year_start_day", "seasons"},
    ),
    "season": ({"name", "month"}, {"day"}),
    "completeness": (set(), {"threshold", "allow_two_of_three"}),
    "output": (
        {"formats"}, {"missing_policy", "custom_missing_sentinel", "style_profile"},
    ),
}

# Transformation kinds a column may use, with their parameters.
KINDS = {
    "parse_datetime": {"profile_id"},
    "format_datetime": {"profile_id"},
    "round_2": {"decimals"},
    "round_numeric": {"decimals"},
    "ppm_to_ppb": set(),
    "ppb_to_ppm": set(),
    "timezone_conversion": {"source_mode", "source_value", "target_zone"},
    "derive_interval_fields": {"start", "midpoint", "end", "role"},
}

# Source types that can be read, with their delimiter, and output formats that can be written.
DELIMITERS = {"csv": ",", "tsv": "\t", "txt": "\t"}
FORMATS = ("csv", "parquet")
# Keys that say something this library would not do; a recipe that gives them is refused when it
# is run from files.
REFUSED = {"source": ("worksheet",), "timestamp": ("output_profile", "target_timezone")}


def _section(name: str, value: object) -> dict:
    if not isinstance(value, Mapping):
        raise ValueError(f"{name} must be an object")
    required, optional = SECTIONS[name]
    extra = set(value) - required - optional
    missing = required - set(value)
    if extra or missing:
        raise ValueError(
            f"{name}: unknown {sorted(extra)}, missing {sorted(missing)}"
        )
    return {k: v for k, v in value.items() if v is not None or k == "source_name"}


@dataclass(frozen=True)
class Recipe:
    """A checked recipe: ``plan`` is a ReformatPlan or an AveragePlan."""

    mode: str
    name: str | None
    expected_columns: tuple[str, ...]
    plan: ReformatPlan | AveragePlan
    formats: tuple[str, ...]
    file_type: str = "csv"
    refused: tuple[str, ...] = ()


def load_recipe(text: str | bytes | Mapping) -> Recipe:
    raw = _section("recipe", json.loads(text) if isinstance(text, (str, bytes)) else text)
    if raw.get("schema_version", 1) != 1:
        raise ValueError("unsupported recipe version")
    mode = raw.get("mode", "reformat")
    if mode not in ("reformat", "average"):
        raise ValueError(f"unknown mode {mode!r}")
    if (mode == "average") != ("aggregation" in raw):
        raise ValueError("aggregation settings go with the average mode")
    source = _section("source", raw["source"])
    columns = [_section("column", c) for c in raw["columns"]]
    exported = [c["output_name"] for c in columns if c.get("export", True)]
    if len(set(exported)) != len(exported):
        raise ValueError("exported output names must be unique")
    output = _output(raw["output"])
    build = _average if mode == "average" else _reformat
    return Recipe(
        mode, raw.get("recipe_name"), tuple(source.get("expected_columns", ())),
        build(raw, source, columns, output), tuple(output["formats"]), source["file_type"],
        tuple(f"{s}.{k}" for s, keys in REFUSED.items() for k in keys if (raw.get(s) or {}).get(k)),
    )


def _output(value: object) -> dict:
    out = _section("output", value)
    if not out["formats"] or len(set(out["formats"])) != len(out["formats"]):
        raise ValueError("output formats must be given once each")
    policy = MissingOutput(out.get("missing_policy", "true_null"))
    custom = out.get("custom_missing_sentinel")
    if (policy is MissingOutput.CUSTOM) != (custom is not None):
        raise ValueError("a custom sentinel goes with the custom policy")
    return {**out, "policy": policy, "custom": custom}


def _operations(column: dict) -> dict[str, dict]:
    found: dict[str, dict] = {}
    for item in column.get("transformations", ()):
        spec = _section("transformation", item)
        kind, parameters = spec["kind"], dict(spec.get("parameters", {}))
        if kind not in KINDS:
            raise ValueError(f"unknown transformation kind {kind!r}")
        if set(parameters) - KINDS[kind]:
            raise ValueError(f"{kind}: unknown parameters {sorted(set(parameters) - KINDS[kind])}")
        found[kind] = parameters
    return found


def _reformat(raw: dict, source: dict, columns: list[dict], output: dict) -> ReformatPlan:
    stamp = _section("timestamp", raw["timestamp"]) if "timestamp" in raw else {}
    missing = _section("missing_data", raw.get("missing_data", {}))
    gap = _section("gap_policy", raw["gap_policy"]) if "gap_policy" in raw else None
    policies = {}
    for item in (gap or {}).get("field_policies", ()):
        policy = _section("field_policy", item)
        if policy["column"] in policies:
            raise ValueError("gap field policies must be unique")
        policies[policy["column"]] = policy
    policy_name = missing.get("invalid_numeric_policy", "null_and_continue")
    if policy_name not in POLICY:
        raise ValueError(f"unknown invalid-number policy {policy_name!r}")
    numeric = set(missing.get("numeric_columns", ()))
    built = []
    timestamp = None
    for c in columns:
        if c["source_name"] is None:
            raise ValueError("every reformat column needs a source name")
        built.append(_column(c, stamp, numeric, policies))
        if c["output_name"] == stamp.get("column"):
            timestamp = c["source_name"]
    removal = missing.get("remove_null_rule")
    if removal is not None:
        removal = _section("remove_null_rule", removal)
        if removal["mode"] not in ROW_MODES:
            raise ValueError(f"unknown null-row mode {removal['mode']!r}")
    by_output = {c.output: c.source for c in built}
    seconds = (gap or {}).get("interval_seconds", stamp.get("duration_seconds"))
    return ReformatPlan(
        columns=tuple(built),
        markers=tuple(source.get("missing_markers", missing.get("confirmed_null_markers", ()))),
        invalid_numbers=policy_name,
        timestamp=timestamp,
        interval=timedelta(seconds=seconds) if seconds else None,
        fill_gaps=gap is not None,
        allow_reorder=bool((gap or {}).get("allow_reorder", False)),
        remove_mode=removal["mode"] if removal else None,
        remove_minimum=removal.get("minimum_present") if removal else None,
        missing=output["policy"],
        missing_custom=output["custom"],
        keys=tuple(raw.get("keys", ())),
        index_column=by_output.get((gap or {}).get("index_column")),
        index_start=(gap or {}).get("index_start", 1),
        flag_column=by_output.get((gap or {}).get("generated_flag_column")),
    )


def _column(c: dict, stamp: dict, numeric: set[str], policies: dict) -> ReformatColumn:
    done = _operations(c)
    transforms = [k for k in done if k in ("round_2", "round_numeric", "ppm_to_ppb", "ppb_to_ppm")]
    if len(transforms) > 1:
        raise ValueError(f"{c['output_name']}: one numeric transformation per column")
    zone = done.get("timezone_conversion", {})
    derive = done.get("derive_interval_fields", {})
    gap = policies.get(c["output_name"], {})
    is_stamp = c["output_name"] == stamp.get("column")
    role = stamp["role"] if is_stamp else derive.get("role", "start")
    kind = str(c.get("semantic_type", "")).casefold()
    transform = transforms[0] if transforms else "keep"
    mode = zone.get("source_mode")
    return ReformatColumn(
        source=c["source_name"],
        output=c["output_name"],
        export=c.get("export", True),
        numeric=c["output_name"] in numeric or kind in ("integer", "decimal", "numeric"),
        input_format=done.get("parse_datetime", {}).get("profile_id"),
        output_format=done.get("format_datetime", {}).get("profile_id"),
        transform=transform,
        decimals=int(done.get(transform, {}).get("decimals", 2)),
        role=TimestampRole(role),
        zone_kind=None if mode in (None, "none") else str(mode),
        zone_value=zone.get("source_value"),
        target_zone=zone.get("target_zone"),
        derive_start=bool(derive.get("start", False)),
        derive_midpoint=bool(derive.get("midpoint", False)),
        derive_end=bool(derive.get("end", False)),
        gap_behavior=GapBehavior(gap.get("behavior", "null")),
        gap_value=gap.get("fixed_value"),
        gap_derivation=Derivation(gap["derivation"]) if "derivation" in gap else None,
        gap_zone=gap.get("timezone_name"),
    )


# Recipe key of a period -> (setting, reader); fixed values: the keys.
PERIOD_KEYS = {
    "day_start": ("day_start", time.fromisoformat),
    "duration_seconds": ("length", lambda v: timedelta(seconds=v)),
    "anchor": ("anchor", datetime.fromisoformat),
    "week_start": ("first_weekday", int),
    "quarter_start_month": ("first_month", int),
    "year_start_month": ("first_month", int),
    "year_start_day": ("first_day", int),
    "seasons": ("seasons", lambda v: tuple(Season(**_section("season", s)) for s in v)),
}
# Period kinds that take a key in a recipe besides ``day_start``; other kinds refuse it.
KIND_KEYS = {
    PeriodKind.FIXED_CLOCK: {"duration_seconds"},
    PeriodKind.FIXED_DAYS: {"duration_seconds", "anchor"},
    PeriodKind.FIXED_YEAR: {"anchor"},
    PeriodKind.WEEK: {"week_start"},
    PeriodKind.QUARTER: {"quarter_start_month"},
    PeriodKind.CALENDAR_YEAR: {"year_start_month", "year_start_day"},
    PeriodKind.SEASON: {"seasons"},
}
NEEDED_KEYS = {"duration_seconds", "anchor", "seasons"}


def load_period(value: object) -> Period:
    p = _section("period", value)
    kind = PeriodKind(p.pop("kind"))
    own = KIND_KEYS.get(kind, set())
    given = {k: v for k, v in p.items() if v not in (None, [], ())}
    if extra := set(given) - own - {"day_start"}:
        raise ValueError(f"{kind} takes no {', '.join(sorted(extra))}")
    if missing := (own & NEEDED_KEYS) - set(given):
        raise ValueError(f"{kind} needs {', '.join(sorted(missing))}")
    settings = {PERIOD_KEYS[k][0]: PERIOD_KEYS[k][1](v) for k, v in given.items()}
    return PERIODS[kind](**settings)


def _average(raw: dict, source: dict, columns: list[dict], output: dict) -> AveragePlan:
    a = _section("aggregation", raw["aggregation"])
    fields = []
    for item in a["fields"]:
        f = _section("field", item)
        fields.append(
            FieldRule(
                f["column"], Statistic(f.get("statistic", "arithmetic_mean")),
                f.get("output_name"), f.get("duration_column"),
            )
        )
    stages = []
    for item in a["stages"]:
        s = _section("stage", item)
        rule = Completeness(**_section("completeness", s.get("completeness", {})))
        stages.append(Stage(load_period(s["period"]), rule, s.get("label")))
    approach = a.get("approach", "direct")
    if approach != ("direct" if len(stages) == 1 else "incremental"):
        raise ValueError(f"{approach!r} does not go with {len(stages)} stages")
    stamp = _section("timestamp", raw["timestamp"]) if "timestamp" in raw else {}
    zone = str(stamp.get("source_timezone", "UTC")).removeprefix("fixed_iana:")
    config = AveragingConfig(
        a["timestamp_column"], timedelta(seconds=a["input_interval_seconds"]),
        a["reporting_timezone"], tuple(fields), tuple(stages), tuple(raw.get("keys", ())),
        bool(a.get("allow_reorder", False)), a.get("max_periods"),
    )
    return AveragePlan(
        config, zone, stamp.get("input_profile"), tuple(source.get("missing_markers", ())),
        output["policy"], output["custom"],
    )


def match_schema(columns: Sequence[str], recipe: Recipe) -> None:
    """A recipe applies only to the same set of names, ignoring case and order."""
    if recipe.expected_columns and {c.casefold() for c in columns} != {
        c.casefold() for c in recipe.expected_columns
    }:
        raise ValueError("the recipe needs the same source columns")


def run_recipe(
    df: DataFrame, recipe: Recipe | str | bytes | Mapping, *, order: str = "_ord",
    notes: Diagnostics | None = None,
) -> ReformatResult | AveragingResult:
    """Apply a recipe to a source frame; technical columns (order, keys) are not matched."""
    if not isinstance(recipe, Recipe):
        recipe = load_recipe(recipe)
    technical = {order, *_keys(recipe)} - set(recipe.expected_columns)
    names = [n for n in df.columns if n not in technical]
    match_schema(names, recipe)
    spelled = {n.casefold(): n for n in recipe.expected_columns}
    df = df.select(*[col(n).alias(spelled.get(n.casefold(), n)) for n in df.columns])
    if isinstance(recipe.plan, ReformatPlan):
        return reformat(df, recipe.plan, notes)
    return run_average(df, recipe.plan, notes=notes)


def _keys(recipe: Recipe) -> tuple[str, ...]:
    plan = recipe.plan
    return plan.keys if isinstance(plan, ReformatPlan) else plan.config.keys


def run_recipe_files(
    spark: SparkSession, paths: str | Sequence[str], recipe: Recipe | str | bytes | Mapping,
    target: str, *, options: DelimitedOptions | None = None, overwrite: bool = False,
    notes: Diagnostics | None = None,
) -> DataFrame:
    """From delimited files to verified outputs below ``target``, one folder per format.

    The plan runs once into staged rows; the outputs are written from them under the recipe's
    missing-value policy, read again and compared, and published by one rename. Returns one row
    per format and check. What the recipe asks for and cannot be done is refused before reading.
    """
    if not isinstance(recipe, Recipe):
        recipe = load_recipe(recipe)
    unknown = [*recipe.refused, *(f for f in recipe.formats if f not in FORMATS)]
    if recipe.file_type not in DELIMITERS:
        unknown.append(f"source type {recipe.file_type}")
    if unknown:
        raise ValueError(f"not supported: {', '.join(unknown)}")
    options = options or DelimitedOptions(delimiter=DELIMITERS[recipe.file_type])
    result = run_recipe(read_delimited(spark, paths, options), recipe, notes=notes)
    table, plan = result.table, recipe.plan
    masks = getattr(result, "masks", {})
    checks: list[DataFrame] = []

    def write(path: str) -> None:
        with sinks.staged(table, path) as rows:
            shown = sinks.apply_missing(rows, plan.missing, plan.missing_custom, masks=masks)
            for fmt in recipe.formats:
                place = f"{path}/{fmt}"
                if fmt == "csv":
                    sinks.write_delimited(
                        rows, place, policy=plan.missing, custom=plan.missing_custom, masks=masks)
                    back = read_delimited(spark, place, ordinal=None, keep_empty_text=False)
                    sent = shown
                else:
                    rows.write.parquet(place)
                    back, sent = spark.read.parquet(place), rows
                found, state = verify_output(back, sent)
                if state == "Failed":
                    raise DataViolation(f"the {fmt} output failed reopen verification")
                checks.append(found.select(F.lit(fmt).alias("format"), "*"))

    sinks.publish(write, f"{target.rstrip('/')}__pending", target, spark, overwrite=overwrite)
    return reduce(DataFrame.unionByName, checks)


def run_recipe_each(
    spark: SparkSession, sources: Mapping[str, str | Sequence[str]],
    recipe: Recipe | str | bytes | Mapping, target: str, *, at_once: int = 4, **settings: object,
) -> DataFrame:
    """Run a recipe on each named source by itself, ``at_once`` at a time, so that their jobs share
    the cluster; a source that fails leaves the others alone.
    Returns ``source, passed, problem``. Sources are runs, so they are few."""

    def run(name: str) -> tuple[str, bool, str | None]:
        try:
            run_recipe_files(
                spark, sources[name], recipe, f"{target.rstrip('/')}/{name}", **settings)
        except Exception as error:  # reported per source
            return name, False, str(error).splitlines()[0]
        return name, True, None

    with ThreadPoolExecutor(at_once) as pool:
        outcome = list(pool.map(inheritable_thread_target(spark)(run), sources))
    return spark.createDataFrame(outcome, "source string, passed boolean, problem string")
