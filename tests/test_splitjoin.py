from datetime import UTC, datetime, time, timedelta

import pytest
from pyspark.sql import functions as F

from gridwright.config import (
    AnchoredYear, DayPeriod, MonthPeriod, QuarterPeriod, WeekPeriod, YearPeriod,
    Action, DuplicatePolicy, FieldGroup, MatchPolicy, SourceSpec, SplitJoinSpec,
)
from gridwright.errors import DataViolation
from gridwright.operators import splitjoin
from gridwright.plans import split
from tests.conftest import rows


def source(spark, number, data, zone="UTC", fields=("PM",), **spec):
    names = ["Time", *fields]
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(data)], "_ord bigint, " + ", ".join(f"`{n}` string" for n in names)
    )
    return splitjoin.prepare_source(df, SourceSpec(f"s{number}", "Time", zone, **spec), number)


def utc(df, name):
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss")


def test_field_join_by_instant(spark):
    a = source(spark, 0, [("2026-01-01T00:00:00", "1"), ("2026-01-01T01:00:00", "2")])
    b = source(spark, 1, [("2026-01-01 06:30", "3"), ("2026-01-01T07:30:00+05:30", "4")], zone="Asia/Colombo")
    # 06:30 and 07:30 in Colombo are 01:00 and 02:00 UTC.
    outer = splitjoin.join_fields([a, b])
    assert outer.columns == ["Timestamp", "S1_PM", "S2_PM"]
    assert [r[1:] for r in rows(outer, "Timestamp")] == [("1", None), ("2", "3"), (None, "4")]
    assert [r[1:] for r in rows(splitjoin.join_fields([a, b], MatchPolicy.INNER))] == [("2", "3")]
    assert splitjoin.join_fields([a, b], MatchPolicy.LEFT).count() == 2


def test_time_join_duplicate_policies(spark):
    a = source(spark, 0, [("2026-01-01", "1"), ("2026-01-01", "2")])
    b = source(spark, 1, [("2026-01-01", "3")])
    for policy, want in ((DuplicatePolicy.FIRST, ["1"]), (DuplicatePolicy.LAST, ["3"]), (DuplicatePolicy.KEEP, ["1", "2", "3"])):
        got = splitjoin.join_time([a, b], policy).orderBy("_ts", "_src", "_ord").collect()
        assert [r.PM for r in got] == want
    for make in (lambda: splitjoin.join_time([a, b]), lambda: splitjoin.join_fields([a, b])):
        with pytest.raises(Exception, match="repeat"):
            make().collect()
    first = splitjoin.join_fields([a, b], duplicates=DuplicatePolicy.FIRST).first()
    assert (first.S1_PM, first.S2_PM) == ("1", "3")


def test_join_rules(spark):
    a = source(spark, 0, [("2026-01-01", "1")])
    other = source(spark, 1, [("2026-01-01", "1")], fields=("NO2",))
    for bad in (
        lambda: splitjoin.join_time([a]), lambda: splitjoin.join_time([a, other]),
        lambda: splitjoin.join_fields([a, other], duplicates=DuplicatePolicy.KEEP),
        lambda: SplitJoinSpec(Action.JOIN_FIELDS, duplicates=DuplicatePolicy.KEEP),
        lambda: SplitJoinSpec(month_start_day=29), lambda: SplitJoinSpec(max_outputs=0),
        lambda: SplitJoinSpec(groups=(FieldGroup("A", ("x",)), FieldGroup("a", ("y",)))),
        lambda: FieldGroup("g", ("x", "x")), lambda: SplitJoinSpec(zone="Nowhere"),
    ):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("text", ["", "31/12/2025", "2025-13-01", "2025-02-30T00:00:00"])
def test_bad_timestamps_name_their_source(spark, text):
    with pytest.raises(Exception, match="s0: invalid"):
        source(spark, 0, [(text, "1")]).collect()


def test_skipped_and_repeated_local_times_are_refused(spark):
    for text in ("2025-11-02 01:30", "2025-03-09 02:30"):
        with pytest.raises(Exception, match="ambiguous|does not exist"):
            source(spark, 0, [(text, "1")], zone="America/New_York").select("_ts").collect()


def test_custom_pattern(spark):
    got = source(spark, 0, [("20.08.2025 08:00", "1")], pattern="dd.MM.yyyy HH:mm").select(F.col("_ts").cast("timestamp_ntz").alias("t")).first().t
    assert got == datetime(2025, 8, 20, 8)


@pytest.mark.parametrize("zone,n", [("UTC", 1), ("+05:30", 2), ("Asia/Colombo", 2)])
def test_year_split_at_local_midnight(spark, zone, n):
    a = source(spark, 0, [("2025-12-31T18:29:59Z", "1"), ("2025-12-31T18:30:00Z", "2")])
    labelled = splitjoin.split_labels(a, SplitJoinSpec(zone=zone))
    assert labelled.select("period_start").distinct().count() == n


@pytest.mark.parametrize("period,start_day,start,end", [
    (MonthPeriod(day_start=time(6, 30)), 15, (2026, 2, 15, 6, 30), (2026, 3, 15, 6, 30)),
    (QuarterPeriod(first_month=3), 1, (2026, 3, 1), (2026, 6, 1)),
    (YearPeriod(first_month=4, first_day=6), 1, (2025, 4, 6), (2026, 4, 6)),
    (WeekPeriod(first_weekday=6), 1, (2026, 3, 1), (2026, 3, 8)),
])
def test_custom_period_starts(spark, period, start_day, start, end):
    a = source(spark, 0, [("2026-03-02T07:00:00+05:30", "1")])
    row = splitjoin.split_labels(a, SplitJoinSpec(period=period, month_start_day=start_day, zone="+05:30")).select(
        F.unix_seconds("period_start").alias("s"), F.unix_seconds("period_end").alias("e")).first()
    shift = timedelta(hours=5, minutes=30)
    for got, want in ((row.s, start), (row.e, end)):
        assert datetime.fromtimestamp(got, UTC).replace(tzinfo=None) + shift == datetime(*want)


def test_period_edges_lost_to_daylight_saving_are_refused(spark):
    a = source(spark, 0, [("2026-03-08T12:00:00Z", "1")])
    spec = SplitJoinSpec(period=DayPeriod(day_start=time(2, 30)), zone="America/New_York")
    with pytest.raises(Exception, match="does not exist"):
        splitjoin.split_labels(a, spec).collect()
    with pytest.raises(ValueError):
        splitjoin.split_labels(a, SplitJoinSpec(period=AnchoredYear(anchor=datetime(2026, 1, 1))))


def test_field_groups(spark):
    a = source(spark, 0, [("2026-01-02", "x", "1", "5"), ("2026-01-01", "x", "2", "6")], fields=("Site", "PM", "NO2"))
    got = splitjoin.split_fields(a, [FieldGroup("Air", ("PM", "NO2"))], ["Site"])["Air"]
    assert got.columns == ["_ts", "_src", "_ord", "Site", "PM", "NO2"]
    assert set(splitjoin.split_fields(a, shared=["Site"])) == {"PM", "NO2"}
    for bad in (lambda: splitjoin.split_fields(a, shared=["Nope"]), lambda: splitjoin.split_fields(a, [FieldGroup("g", ("Nope",))]),
                lambda: splitjoin.split_fields(a, shared=["Site", "PM", "NO2"])):
        with pytest.raises(ValueError):
            bad()


def test_files_to_published_outputs(spark, tmp_path):
    for n, hours in (("a", range(0, 30)), ("b", range(20, 50))):
        with open(tmp_path / f"{n}.csv", "w") as f:
            f.write("Time,PM\n" + "\n".join(f"2026-01-0{1 + h // 24}T{h % 24:02d}:00:00,{h}" for h in hours) + "\n")
    specs = [SourceSpec(n, "Time", path=str(tmp_path / f"{n}.csv")) for n in ("a", "b")]
    spec = SplitJoinSpec(Action.JOIN_FIELDS, period=DayPeriod(), regroup=True)
    frames = split.read_sources(spark, specs, spec)
    run = split.run_split_join(frames, ["a", "b"], spec)
    target = str(tmp_path / "out" / "run")
    listed = split.publish_split_join(spark, run, spec, target, sources=specs, fmt="csv")
    assert [(r.output, r.rows) for r in listed.orderBy("output").collect()] == [
        ("Joined_2files_2026-01-01", 24), ("Joined_2files_2026-01-02", 24), ("Joined_2files_2026-01-03", 2),
    ]
    assert listed.orderBy("output").first().period_end == "2026-01-02T00:00:00+00:00"
    back = spark.read.parquet(f"{target}/data")
    assert back.count() == 50 and back.where("S1_PM is null").count() == 20
    with pytest.raises(FileExistsError):
        split.publish_split_join(spark, run, spec, target)
    with pytest.raises(ValueError, match="twice"):
        split.read_sources(spark, [specs[0], specs[0]], spec)
    limited = SplitJoinSpec(Action.JOIN_FIELDS, period=DayPeriod(), regroup=True, max_outputs=2)
    with pytest.raises(DataViolation, match="limit"):
        split.publish_split_join(spark, run, limited, target + "2")


def test_split_fields_run(spark):
    a = source(spark, 0, [("2026-01-01", "x", "1")], fields=("Site", "PM"))
    spec = SplitJoinSpec(Action.SPLIT_FIELDS, shared_fields=("Site",))
    run = split.run_split_join([a], ["s0"], spec)
    assert [r.output for r in run.manifest.collect()] == ["S1_s0_PM"]
    assert run.rows.first().Timestamp == "2026-01-01T00:00:00+00:00"
    assert utc(run.rows, "_ts") is not None
