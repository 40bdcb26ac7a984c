import copy
import json
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridwright.config import (
    MonthPeriod,
    SeasonPeriod,
    AveragingConfig, Completeness, FieldRule, Season, Stage, Statistic, clock, day,
)
from gridwright.catalog.plans import AVERAGE, REFORMAT
from gridwright.operators import averaging, cells, columns, moments
from gridwright.operators.diagnostics import Diagnostics
from gridwright.plans.recipe import (
    load_period, load_recipe, run_recipe, run_recipe_each, run_recipe_files,
)
from gridwright.plans.reformat import ReformatColumn, ReformatPlan, offset_minutes, readiness, reformat
from gridwright.plans.steps import run_steps, step
from gridwright.streaming import periods
from tests.conftest import rows


def text(spark, names, *data):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(data)], "_ord bigint, " + ", ".join(f"`{n}` string" for n in names)
    )


def test_thirteen_steps_with_audit(spark):
    df = text(
        spark, ["Date", "Start Time", "End Time", "CO_ppm", "Source", "Unused"],
        ("08/20/2025", "08:00", "08:59", "0.0254", "Station A", None),
        ("08/20/2025", "09:00", "09:59", "-999", "Station A", None),
    )
    steps = [
        step(cells.normalize_nulls, ["-999"], ["CO_ppm"]),
        step(moments.parse_datetime, "Date", "mdy_slash_date"),
        step(moments.parse_datetime, "Start Time", "time_minute"),
        step(moments.parse_datetime, "End Time", "time_minute"),
        step(moments.combine_date_time, "Date", "Start Time", "UTC Start"),
        step(moments.combine_date_time, "Date", "End Time", "UTC End"),
        step(moments.normalize_interval_end, "UTC Start", "UTC End", timedelta(hours=1)),
        step(moments.convert_timezone, "UTC Start", "Asia/Colombo", source_kind="fixed_iana", zone="UTC", output="Local Start"),
        step(moments.derive_intervals, "Local Start", "start", timedelta(hours=1), start=None,
             midpoint="Local Mid", end="Local End", zone="Asia/Colombo"),
        step(cells.convert_concentration, "CO_ppm", "ppm_to_ppb", output="CO_ppb"),
        step(cells.round_column, "CO_ppb", 2),
        step(columns.add_index_column),
        step(columns.select_columns, ["Index", "Source", "UTC Start", "UTC End", "Local Start", "Local Mid", "Local End", "CO_ppb"]),
    ]
    out, audit = run_steps(df, steps)
    assert len(audit) == 13 and audit[0].operation == "normalize_nulls"
    assert audit[-1].output_columns == tuple(out.columns)
    for name in ("Local Start", "Local Mid", "Local End"):
        out = moments.format_datetime(out, name, "iso_offset", zone="Asia/Colombo")
    first, second = rows(out, "Index")
    assert first == (
        1, "Station A", datetime(2025, 8, 20, 8), datetime(2025, 8, 20, 9), "2025-08-20T13:30:00+05:30",
        "2025-08-20T14:00:00+05:30", "2025-08-20T14:30:00+05:30", Decimal("25.40"),
    )
    assert second[-1] is None
    with pytest.raises(ValueError):
        run_steps(df, steps, version=2)


def stations(spark):
    hours = [(0, "1.5"), (1, "N/A"), (2, "2.0"), (4, "bad"), (5, "3.0")]
    return text(
        spark, ["Timestamp", "Station", "PM2.5", "Unused"],
        *[(f"2025-08-20 0{h}:00", "Station A", v, "") for h, v in hours],
    )


def plan(**more):
    special = {
        "Timestamp": {"input_format": "iso_minute", "output_format": "iso_minute"},
        "Station": {"gap_behavior": "carry_stable"},
        "PM2.5": {"numeric": True},
        "Unused": {"export": False},
    }
    for name, extra in more.pop("columns", {}).items():
        special[name].update(extra)
    from gridwright.config import GapBehavior

    special["Station"]["gap_behavior"] = GapBehavior.CARRY_STABLE
    made = tuple(ReformatColumn(n, **{"output": n, **s}) for n, s in special.items())
    base = {"markers": ("N/A",), "timestamp": "Timestamp", "interval": timedelta(hours=1), "fill_gaps": True}
    return ReformatPlan(made, **{**base, **more})


def test_five_rows_become_six(spark):
    result = reformat(stations(spark), plan())
    got = sorted(tuple(r) for r in result.table.collect())
    assert [g[0][-5:] for g in got] == [f"0{h}:00" for h in range(6)]
    assert [g[2] for g in got] == ["1.5", None, "2.0", None, None, "3.0"]
    assert {g[1] for g in got} == {"Station A"} and result.table.columns == ["Timestamp", "Station", "PM2.5"]
    counts = result.notes.counts()
    assert counts["gap_rows_generated"] == 1 and counts["null_markers_normalized"] == 1
    assert counts["invalid_numeric_values"] == 1 and (counts["input_rows"], counts["output_rows"]) == (5, 6)


def test_reformat_policies(spark):
    removed = reformat(stations(spark), plan(remove_mode="all_measurements_missing"))
    assert removed.table.count() == 3
    assert removed.notes.counts()["null_rows_removed"] == 3
    with pytest.raises(Exception, match="invalid number"):
        reformat(stations(spark), plan(invalid_numbers="stop", fill_gaps=False)).table.collect()
    shown = reformat(
        stations(spark),
        plan(invalid_numbers="inspect", fill_gaps=False, columns={"PM2.5": {"transform": "round_2"}}),
    )
    assert {r["PM2.5"] for r in shown.table.collect()} == {"1.50", None, "2.00", "bad", "3.00"}


def test_masks_in_a_plan(spark):
    df = text(spark, ["When", "Price", "Flag", "Note"], ("20.08.2025 08:00", "1.234,5", "Oui", "<a>"))
    made = (
        ReformatColumn("When", "When", input_format={"kind": "datetime", "pattern": "dd.MM.yyyy HH:mm"}, output_format="iso_t_minute"),
        ReformatColumn("Price", "Price", numeric=True, input_format={"kind": "number", "pattern": "#,##0.00", "decimal": ","},
                       output_format={"kind": "number", "pattern": "0.0"}),
        ReformatColumn("Flag", "Flag", input_format={"kind": "boolean", "pattern": "Oui|Non"}, output_format={"kind": "boolean", "pattern": "Y|N"}),
        ReformatColumn("Note", "Note", input_format='x-format:{"kind":"text","pattern":"<{value}>"}'),
    )
    result = reformat(df, ReformatPlan(made))
    assert tuple(result.table.first()) == ("2025-08-20T08:00", Decimal("1234.5"), "Y", "a")
    assert result.masks["Price"].pattern == "0.0"


def test_embedded_offsets_are_shown_again(spark):
    df = text(spark, ["t", "v"], ("2025-08-20T08:00:00+05:30", "1"), ("2025-08-20T10:00:00+05:30", "2"))
    made = (
        ReformatColumn("t", "t", input_format="iso_offset", output_format="iso_offset"),
        ReformatColumn("v", "v", numeric=True),
    )
    result = reformat(df, ReformatPlan(made, timestamp="t", interval=timedelta(hours=1), fill_gaps=True))
    assert sorted(r.t for r in result.table.collect()) == [f"2025-08-20T{h:02d}:00:00+05:30" for h in (8, 9, 10)]


def test_readiness_messages():
    errors, warnings = readiness(ReformatPlan((ReformatColumn("a", " ", target_zone="UTC", derive_end=True),), fill_gaps=True))
    text_ = " ".join(errors)
    for part in ("no name", "need a timestamp", "need an interval", "source zone", "interval fields"):
        assert part in text_
    assert warnings
    assert readiness(ReformatPlan((ReformatColumn("a", "x", export=False),)))[0]
    assert [offset_minutes(t) for t in ("+05:30", "-4", "0")] == [330, -240, 0]
    for bad in ("5h", "1:2:3", "+05:75"):
        with pytest.raises(ValueError):
            offset_minutes(bad)


def changed(recipe, **paths):
    out = copy.deepcopy(recipe)
    for path, value in paths.items():
        *parents, last = path.split("__")
        node = out
        for p in parents:
            node = node[int(p)] if isinstance(node, list) else node[p]
        node[last] = value
    return out


@pytest.mark.parametrize("bad", [
    changed(REFORMAT, surprise=1), changed(REFORMAT, schema_version=2), changed(REFORMAT, mode="other"),
    changed(REFORMAT, mode="average"), changed(AVERAGE, mode="reformat"), changed(REFORMAT, source={}),
    changed(REFORMAT, output={"formats": []}), changed(REFORMAT, output={"formats": ["csv"], "missing_policy": "custom"}),
    changed(REFORMAT, columns__1__output_name="Station"), changed(REFORMAT, columns__1__transformations=[{"kind": "exec"}]),
    changed(REFORMAT, columns__1__transformations=[{"kind": "ppm_to_ppb", "parameters": {"x": 1}}]),
    changed(REFORMAT, missing_data={"invalid_numeric_policy": "maybe"}),
    changed(AVERAGE, aggregation__stages=[{"period": {"kind": "fortnight"}}]),
    changed(AVERAGE, aggregation__fields=[]), changed(AVERAGE, aggregation__reporting_timezone="Moon/Base"),
])
def test_bad_recipes_are_refused(bad):
    with pytest.raises(ValueError):
        load_recipe(json.dumps(bad))


def test_recipe_needs_the_same_columns(spark):
    df = text(spark, ["when", "no2_PPM", "station", "unused"], ("2025-08-20 08:00", "0.5", "A", "")).withColumn("event_type", F.lit("k"))
    out = run_recipe(df, json.dumps(REFORMAT)).table.first()
    assert out["NO2_ppb"] == Decimal(500)
    with pytest.raises(ValueError, match="same source columns"):
        run_recipe(df.drop("unused"), REFORMAT)


def test_period_descriptions():
    seasons = [{"name": "Wet", "month": 5, "day": 15}, {"name": "Dry", "month": 12}]
    assert load_period({"kind": "season", "seasons": seasons}) == SeasonPeriod(seasons=(Season("Wet", 5, 15), Season("Dry", 12)))
    assert load_period({"kind": "fixed_clock", "duration_seconds": 28800, "day_start": "06:00:00"}).length == timedelta(hours=8)
    for bad in ({"kind": "day", "anchor": "2026-01-01T00:00:00"}, {"kind": "fixed_days"},
                {"kind": "week", "duration_seconds": 5}, {"kind": "season", "seasons": []}):
        with pytest.raises(ValueError):
            load_period(bad)
    anchored = load_period({"kind": "fixed_days", "duration_seconds": 86400, "anchor": "2026-01-01T00:00:00"})
    assert anchored.anchor == datetime(2026, 1, 1)


def test_average_recipe_counts_bad_cells_as_missing(spark):
    data = [(f"2025-08-20 {h:02d}:00", "bad" if h == 3 else str(h), "A", "") for h in range(24)]
    df = text(spark, ["When", "NO2_ppm", "Station", "Unused"], *data).withColumn("event_type", F.lit("k"))
    got = run_recipe(df, AVERAGE).table.first()
    assert got.reading == pytest.approx((sum(range(24)) - 3) / 23)
    broken = df.withColumn("When", F.when(F.col("_ord") != 5, F.col("When")))
    with pytest.raises(Exception, match="missing"):
        run_recipe(broken, AVERAGE).table.collect()


def streamed(spark, frames, config, tmp_path, base):
    """Averages of a file stream that takes one frame after the other."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = periods.partial_windows(stream, config, base=base, delay="300 days")
    periods.start_partials(parts, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    return periods.average_partials(periods.latest_partials(spark, str(tmp_path / "out"), config.keys), config)


def test_stream_equals_batch_with_late_rows(spark, tmp_path):
    start = datetime(2026, 3, 6, tzinfo=UTC)
    data = [("a" if i % 3 else "b", start + timedelta(minutes=15 * i), float(i % 17), 1.0 + i % 2, float(i * i % 23), None if i % 5 == 0 else float(i)) for i in range(96 * 5)]
    df = spark.createDataFrame(data, "k string, ts timestamp, v double, w double, m double, h double")
    config = AveragingConfig(
        "ts", timedelta(minutes=15), "America/New_York",
        (FieldRule("v", Statistic.STANDARD_DEVIATION), FieldRule("w", Statistic.SUM),
         FieldRule("m", Statistic.MEDIAN), FieldRule("h", Statistic.MEDIAN)),
        (Stage(clock(hours=8), Completeness(0.1)), Stage(day(), Completeness(0.3))),
        keys=("k",),
    )
    # Files in reverse time order.
    files = [spark.createDataFrame(data[lo:hi], df.schema) for lo, hi in ((320, 480), (0, 170), (170, 320))]
    merged = streamed(spark, files, config, tmp_path, timedelta(hours=1))
    batch = averaging.average(df, config)
    for got, want in zip(merged.stages, batch.stages):
        left = {tuple(r)[:3]: [round(x, 6) if x is not None else None for x in tuple(r)[3:]] for r in got.table.collect()}
        right = {tuple(r)[:3]: [round(x, 6) if x is not None else None for x in tuple(r)[3:]] for r in want.table.collect()}
        assert left == right


def test_late_rows_work_out_their_periods_alone(spark, tmp_path):
    start = datetime(2026, 3, 1, tzinfo=UTC)
    data = [(k, start + timedelta(hours=i), float(i % 50)) for k in ("a", None) for i in range(24 * 80)]
    late = [r for r in data if r[0] is None and r[1].day == 5 and r[1].hour > 3]
    frame = lambda rows: spark.createDataFrame(rows, "k string, ts timestamp, v double")
    config = AveragingConfig(
        "ts", timedelta(hours=1), "America/New_York", (FieldRule("v", Statistic.STANDARD_DEVIATION),),
        (Stage(day(), Completeness(0.1)), Stage(MonthPeriod(), Completeness(0.1))), keys=("k",))
    streamed(spark, [frame([r for r in data if r not in late])], config, tmp_path, timedelta(hours=1))
    path = str(tmp_path / "out")
    state = periods.refreshed(spark, path, config, None, -1)
    state.write.parquet(str(tmp_path / "state"))
    seen = spark.read.parquet(path).agg(F.max("batch_id")).first()[0]
    streamed(spark, [frame(late)], config, tmp_path, timedelta(hours=1))
    windows = periods.dirty_windows(spark, path, config, seen)
    # 21 hours of the 5th in March, April and May; the days of New York before them end at four or five.
    assert {r.k for r in windows.collect()} == {None}
    assert windows.count() == 4 * 24
    state = periods.refreshed(spark, path, config, spark.read.parquet(str(tmp_path / "state")), seen)
    for got, want in zip(periods.average_grouped(state, config).stages, averaging.average(frame(data), config).stages):
        left, right = ({tuple(r)[:3]: r.v for r in s.table.collect()} for s in (got, want))
        assert left.keys() == right.keys()
        assert {k for k in left if left[k] is None} == {k for k in right if right[k] is None}
        assert all(left[k] == pytest.approx(right[k], rel=1e-9) for k in left if left[k] is not None)


def test_stream_refuses_what_a_batch_refuses(spark, tmp_path):
    start = datetime(2026, 3, 6, tzinfo=UTC)
    rows = [(start + timedelta(minutes=i), float(i)) for i in range(1440)]
    config = AveragingConfig("ts", timedelta(minutes=1), "UTC", (FieldRule("v"),), (Stage(day()),))
    frame = lambda data: spark.createDataFrame(data, "ts timestamp, v double")
    cases = {
        "repeated": [frame(rows), frame([rows[700]])],  # arrives in a later batch
        "missing": [frame(rows), frame([(None, 1.0)])],
        "off the confirmed": [frame(rows[1:]), frame([(start + timedelta(seconds=30), 1.0)])],
    }
    for place, (words, files) in enumerate(cases.items()):
        batch = files[0].unionByName(files[1])
        with pytest.raises(Exception, match=words):
            averaging.average(batch, config).table.collect()
        folder = tmp_path / str(place)
        if words != "missing":  # a stream's watermark leaves rows without a time out
            with pytest.raises(Exception, match=words):
                streamed(spark, files, config, folder, timedelta(hours=12)).table.collect()


def test_repeated_instants_are_refused_through_a_recipe(spark):
    twice = text(spark, ["Timestamp", "PM"], ("2026-01-01 00:00", "1"), ("2026-01-01 00:00", "9"))
    recipe = {
        "schema_version": 1, "recipe_name": "r", "mode": "average",
        "source": {"file_type": "csv", "expected_columns": ["Timestamp", "PM"]},
        "columns": [{"source_name": n, "output_name": n} for n in ("Timestamp", "PM")],
        "timestamp": {"column": "Timestamp", "role": "start", "input_profile": "iso_minute"},
        "aggregation": {
            "timestamp_column": "Timestamp", "input_interval_seconds": 43200,
            "reporting_timezone": "UTC", "fields": [{"column": "PM"}],
            "stages": [{"period": {"kind": "day"}}]},
        "output": {"formats": ["csv"]},
    }
    with pytest.raises(Exception, match="repeated"):
        run_recipe(twice, recipe).table.collect()


DAILY = {
    "schema_version": 1, "recipe_name": "r", "mode": "average",
    "source": {"file_type": "csv", "expected_columns": ["Timestamp", "PM"], "missing_markers": ["N/A"]},
    "columns": [{"source_name": n, "output_name": n} for n in ("Timestamp", "PM")],
    "timestamp": {"column": "Timestamp", "role": "start", "input_profile": "iso_minute"},
    "aggregation": {
        "timestamp_column": "Timestamp", "input_interval_seconds": 3600,
        "reporting_timezone": "UTC", "fields": [{"column": "PM"}],
        "stages": [{"period": {"kind": "day"}}]},
    "output": {"formats": ["csv", "parquet"], "missing_policy": "minus_999"},
}


def test_recipe_from_files_to_verified_outputs(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    hours = [f"2026-01-0{d} {h:02d}:00,{'N/A' if d == 2 and h < 12 else d * 10}" for d in (1, 2) for h in range(24)]
    good.write_text("\n".join(["Timestamp,PM", *hours]) + "\n")
    bad.write_text("\n".join(["Timestamp,PM", hours[0], hours[0]]) + "\n")
    checks = run_recipe_files(spark, str(good), DAILY, str(tmp_path / "out"))
    assert checks.where("not passed").count() == 0
    assert {r.format for r in checks.collect()} == {"csv", "parquet"}
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out" / "csv")).collect())
    assert [x.rsplit(",", 1)[1] for x in lines if x[0] == "2"] == ["10.0", "-999"]
    values = spark.read.parquet(str(tmp_path / "out" / "parquet")).orderBy("Period_Start").collect()
    assert [r.PM for r in values] == [10.0, None]
    found = run_recipe_each(spark, {"good": str(good), "bad": str(bad)}, DAILY, str(tmp_path / "each"))
    assert {r.source: r.passed for r in found.collect()} == {"good": True, "bad": False}
    assert (tmp_path / "each" / "good").exists() and not (tmp_path / "each" / "bad").exists()
    assert not [p.name for p in (tmp_path / "each").iterdir() if "__" in p.name]
    for path, value in (("source__file_type", "xlsx"), ("timestamp__target_timezone", "Asia/Tokyo"),
                        ("output__formats", ["xlsx"])):
        with pytest.raises(ValueError, match="not supported"):
            run_recipe_files(spark, str(good), changed(DAILY, **{path: value}), str(tmp_path / "x"))


def test_base_windows_that_do_not_fit_are_refused():
    def config(zone="UTC", period=day(), minutes=30):
        return AveragingConfig("ts", timedelta(minutes=minutes), zone, (FieldRule("v"),), (Stage(period),))

    for settings, base in (
        (config("Asia/Colombo"), timedelta(hours=3)), (config("America/New_York"), timedelta(hours=2)),
        (config(minutes=20), timedelta(minutes=30)), (config(), timedelta(hours=5)),
        (config(period=clock(hours=8)), timedelta(hours=6)), (config(), timedelta(0)),
    ):
        with pytest.raises(ValueError, match="base windows"):
            periods.check_base(settings, base)
    periods.check_base(config("Asia/Colombo"), timedelta(minutes=30))
    periods.check_base(config("America/New_York"), timedelta(hours=1))


def test_streamed_deviation_of_large_values(spark, tmp_path):
    start = datetime(2026, 1, 1, tzinfo=UTC)
    df = spark.createDataFrame([(start + timedelta(hours=i), 1e9 + i) for i in range(24)], "ts timestamp, v double")
    config = AveragingConfig(
        "ts", timedelta(hours=1), "UTC", (FieldRule("v", Statistic.STANDARD_DEVIATION),), (Stage(day()),))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    parts = periods.partial_windows(stream, config, base=timedelta(hours=4), delay="1 day")
    periods.start_partials(parts, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    whole = periods.compact_partials(spark, str(tmp_path / "out"), str(tmp_path / "kept"), ())
    got = periods.average_partials(whole, config).table.first()["v"]
    assert got == pytest.approx(averaging.average(df, config).table.first()["v"], rel=1e-9)


def test_diagnostics_sum_over_steps(spark):
    notes = Diagnostics()
    df = text(spark, ["a", "b"], ("x", "1"), ("2", "y"))
    df = cells.round_column(df, "a", 1, notes=notes)
    df = cells.round_column(df, "b", 1, notes=notes)
    df.collect()
    assert notes.counts() == {"invalid_numeric_values": 2}
