import statistics
from datetime import UTC, datetime, time, timedelta

import pytest
from pyspark.sql import functions as F

from gridwright.config import (
    MonthPeriod,
    AveragingConfig, Completeness, FieldRule, Stage, Statistic,
    clock, day,
)
from gridwright.errors import DataViolation
from gridwright.operators.averaging import average, exact_median, series_violations
from gridwright.plans.average import suggest_output, suggest_statistic
from tests.conftest import rows

HOUR = timedelta(hours=1)
START = datetime(2026, 1, 1, tzinfo=UTC)


def series(spark, values, step=HOUR, start=START, kind="double"):
    data = [(start + i * step, v, i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"ts timestamp, v {kind}, _ord bigint")


def cfg(*stages, interval=HOUR, zone="UTC", fields=(FieldRule("v"),), **more):
    return AveragingConfig("ts", interval, zone, tuple(fields), tuple(stages), **more)


def test_daily_completeness_and_records(spark):
    # Day one has 18 of 24 hours, day two 17.
    values = [float(h) for h in range(18)] + [None] * 6 + [1.0] * 17 + [None] * 7
    result = average(series(spark, values), cfg(Stage(day())), strict=True)
    got = rows(result.table, "Period_Start")
    assert [r[2] for r in got] == [8.5, None]
    records = rows(result.completeness.select("valid_count", "expected_count", "availability", "accepted"))
    assert records == [(17, 24, 17 / 24, False), (18, 24, 0.75, True)]
    assert rows(result.report)[0][3:] == (2, 1, 1)


def test_incremental_two_of_three(spark):
    values = [1.0] * 8 + [2.0] * 8 + [None] * 8
    config = cfg(
        Stage(clock(hours=8), Completeness(1.0)), Stage(day(), Completeness(0.75, True)),
    )
    result = average(series(spark, values), config)
    assert [r[2] for r in rows(result.stages[0].table, "Period_Start")] == [1.0, 2.0, None]
    record = rows(result.stages[1].completeness)[0]
    assert rows(result.table)[0][2] == 1.5
    assert record[-1] is True and record[4:6] == (2, 3)


def test_empty_periods_and_hidden_gap_between_series(spark):
    df = series(spark, [1.0] * 24).unionByName(
        series(spark, [3.0] * 24, start=START + timedelta(days=3))
    )
    got = rows(average(df.drop("_ord"), cfg(Stage(day()))).table, "Period_Start")
    assert [r[2] for r in got] == [1.0, None, None, 3.0]


def test_no_input_gives_empty_stages(spark):
    df = series(spark, [1.0]).where("false")
    config = cfg(Stage(clock(hours=8)), Stage(day()),)
    result = average(df, config)
    assert [rows(s.table) for s in result.stages] == [[], []]
    assert result.table.columns == ["Period_Start", "Period_End", "v"]


@pytest.mark.parametrize("spoil,match", [
    (lambda d: d.unionByName(d.where("_ord = 2")), "repeated"),
    (lambda d: d.withColumn("_ord", -F.col("_ord")), "disorder"),
    (lambda d: d.withColumn("ts", F.when(F.col("_ord") != 3, F.col("ts"))), "missing"),
])
def test_input_checks_are_on_by_default(spark, spoil, match):
    spoiled = spoil(series(spark, [1.0] * 6))
    with pytest.raises(Exception, match=match):
        average(spoiled, cfg(Stage(day()))).table.collect()
    relaxed = average(spoiled, cfg(Stage(day(), Completeness(0.1))), strict=False)
    assert rows(relaxed.table)[0][2] == 1.0


def test_medians_with_an_outlier_and_many_equal_values(spark):
    values = [float(i % 7) for i in range(5000)] + [1e300, -1e300, 3.5]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "k int, v double")
    got = dict(rows(exact_median(df.repartition(5), ["k"], "v", "m")))
    for k in range(3):
        assert got[k] == statistics.median(v for i, v in enumerate(values) if i % 3 == k)


def test_more_than_a_million_periods(spark):
    ends = [(START, 1.0), (START + timedelta(minutes=1_500_000), 2.0)]
    df = spark.createDataFrame(ends, "ts timestamp, v double")
    config = cfg(Stage(clock(minutes=1)), interval=timedelta(minutes=1))
    assert average(df, config).report.first()["periods_evaluated"] == 1_500_001


def test_reordering_is_allowed_on_request(spark):
    df = series(spark, [1.0] * 24).withColumn("_ord", -F.col("_ord"))
    assert rows(average(df, cfg(Stage(day()), allow_reorder=True), strict=True).table)[0][2] == 1.0


def test_off_grid_timestamps_are_refused(spark):
    df = series(spark, [1.0] * 24, start=START + timedelta(minutes=30))
    with pytest.raises(Exception, match="off the confirmed"):
        average(df, cfg(Stage(day()))).table.collect()
    assert {r.kind for r in series_violations(df, cfg(Stage(day()))).collect()} == {"off_grid"}


def test_period_must_divide_by_interval(spark):
    with pytest.raises(Exception, match="whole number"):
        average(series(spark, [1.0], step=HOUR), cfg(Stage(day()), interval=timedelta(hours=7))).table.collect()


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_non_finite_values_are_errors(spark, bad):
    with pytest.raises(Exception, match="finite"):
        average(series(spark, [1.0, bad]), cfg(Stage(day()))).table.collect()


def test_leq_and_duration_weights(spark):
    df = series(spark, [60.0, 70.0], step=timedelta(hours=12))
    rule = FieldRule("v", Statistic.ENERGY_AVERAGE_LEQ)
    plain = average(df, cfg(Stage(day()), interval=timedelta(hours=12), fields=[rule]))
    assert rows(plain.table)[0][2] == pytest.approx(67.40362689)
    weighted = df.withColumn("d", F.when(F.col("_ord") == 0, 9).otherwise(1))
    rule = FieldRule("v", Statistic.ENERGY_AVERAGE_LEQ, weight_column="d")
    got = average(weighted, cfg(Stage(day()), interval=timedelta(hours=12), fields=[rule]))
    assert rows(got.table)[0][2] == pytest.approx(62.78753601)
    # A missing weight makes its observation invalid; intervals work as weights too.
    spans = df.withColumn("d", F.when(F.col("_ord") == 0, F.expr("interval '2' hour")))
    got = average(spans, cfg(Stage(day(), Completeness(0.5)), interval=timedelta(hours=12), fields=[rule]))
    assert rows(got.table)[0][2] == pytest.approx(60.0)
    zero = df.withColumn("d", F.lit(0))
    with pytest.raises(Exception, match="positive"):
        average(zero, cfg(Stage(day()), interval=timedelta(hours=12), fields=[rule])).table.collect()


def test_every_statistic_on_one_period(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    want = {
        Statistic.ARITHMETIC_MEAN: 4.0, Statistic.MINIMUM: 1.0, Statistic.MAXIMUM: 9.0,
        Statistic.SUM: 16.0, Statistic.RAINFALL_ACCUMULATION: 16.0, Statistic.MEDIAN: 3.0,
        Statistic.COUNT: 4, Statistic.RAIN_RATE_MEAN: 4.0,
        Statistic.STANDARD_DEVIATION: (sum((v - 4) ** 2 for v in values) / 4) ** 0.5,
    }
    df = series(spark, values, step=timedelta(hours=6))
    for stat, value in want.items():
        got = average(df, cfg(Stage(day()), interval=timedelta(hours=6), fields=[FieldRule("v", stat)]))
        assert rows(got.table)[0][2] == pytest.approx(value), stat


def test_exact_median_by_rank_selection(spark):
    data = [(g, float((i * 37) % 101) + (1e6 if i % 50 == 0 else 0)) for g in "ab" for i in range(500)]
    data += [("c", 7.0)] * 99 + [("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    want = rows(df.groupBy("g").agg(F.median("v").alias("m")))
    assert rows(exact_median(df, ["g"], "v", "m").select("g", "m")) == want


def test_median_of_an_even_count(spark):
    df = series(spark, [5.0, 1.0, 3.0, 2.0], step=timedelta(hours=6))
    config = cfg(Stage(day()), interval=timedelta(hours=6), fields=[FieldRule("v", Statistic.MEDIAN)])
    assert rows(average(df, config).table)[0][2] == 2.5


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_result_does_not_depend_on_partitioning(spark, parts):
    values = [float(i % 11) if i % 7 else None for i in range(24 * 60)]
    df = series(spark, values).orderBy(F.rand(3)).repartition(parts)
    config = cfg(
        Stage(clock(hours=8), Completeness(0.5)), Stage(day(), Completeness(0.6)),
        Stage(MonthPeriod(), Completeness(0.5)), zone="America/New_York",
        fields=[FieldRule("v", Statistic.MAXIMUM)],
    )
    base = average(series(spark, values), config)
    assert rows(average(df, config).table) == rows(base.table)


def test_period_limit_and_settings(spark):
    df = series(spark, [1.0, 1.0], step=timedelta(days=10))
    with pytest.raises(Exception, match="limit"):
        average(df, cfg(Stage(day()), max_periods=5)).table.collect()
    two = Completeness(0.75, True)
    for bad in (
        lambda: cfg(Stage(day(), two)),
        lambda: cfg(),
        lambda: cfg(Stage(day()), fields=[FieldRule("v"), FieldRule("v")]),
        lambda: cfg(Stage(day()), fields=[FieldRule("v", output_name="Period_End")]),
        lambda: cfg(Stage(day()), zone="Mars/Base"),
        lambda: FieldRule("v", Statistic.SUM, weight_column="d"),
        lambda: Completeness(0),
    ):
        with pytest.raises(ValueError):
            bad()
    wall = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with pytest.raises(ValueError, match="zone"):
        average(wall, cfg(Stage(day())))


def test_mixed_statistics_nine_of_twelve(spark):
    data = [
        (START + i * timedelta(minutes=5), 5.0 if i < 9 else None, 60.0 if i < 9 else None, 0.2 if i < 9 else None)
        for i in range(12)
    ]
    df = spark.createDataFrame(data, "ts timestamp, pm double, laeq double, rain double")
    fields = [
        FieldRule("pm"), FieldRule("laeq", Statistic.ENERGY_AVERAGE_LEQ),
        FieldRule("rain", Statistic.RAINFALL_ACCUMULATION),
    ]
    got = rows(average(df, cfg(Stage(clock(hours=1)), interval=timedelta(minutes=5), fields=fields)).table)
    assert got[0][2:] == (5.0, pytest.approx(60.0), pytest.approx(1.8))


def test_suggestions_by_name():
    assert suggest_statistic("LAeq (dB)") == "energy_average_leq"
    assert suggest_statistic("Leq") == "energy_average_leq"
    assert suggest_statistic("Rain Rate mm/h") == "rain_rate_mean"
    assert suggest_statistic("Rainfall") == "rainfall_accumulation"
    assert suggest_statistic("PM2.5") == "arithmetic_mean"
    assert suggest_output("PM2.5", "maximum") == "PM2.5 - Max"
    assert time(0) == day().day_start


def test_periods_of_many_grid_points_are_folded_part_by_part(spark):
    """Days of minutes: the same averages as without the checks, for every statistic."""
    minute, names = timedelta(minutes=1), list(Statistic)
    data = [
        (START + i * minute, *[None if i % 7 == j % 7 else 50 + (i * (j + 3) % 41) / 8 for j in range(len(names))])
        for i in range(2 * 1440 + 700)
    ]
    columns = [f"v{j}" for j in range(len(names))]
    df = spark.createDataFrame(data, "ts timestamp, " + ", ".join(f"{c} double" for c in columns))
    config = cfg(
        Stage(day(), Completeness(0.1)), interval=minute, zone="America/New_York",
        fields=[FieldRule(c, s) for c, s in zip(columns, names)])
    got, want = (rows(average(df, config, strict=s).table, "Period_Start") for s in (True, False))
    assert len(got) == len(want) == 4
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], rel=1e-12)
    records = [rows(average(df, config, strict=s).completeness) for s in (True, False)]
    assert records[0] == records[1]


@pytest.mark.parametrize("zone, interval, period", [
    ("UTC", HOUR, day()), ("America/New_York", timedelta(minutes=1), day()), ("America/New_York", HOUR, MonthPeriod())])
def test_repeated_instants_are_found_by_their_marks(spark, zone, interval, period):
    start = datetime(2026, 3, 7, 5, tzinfo=UTC)  # a day change of the clocks lies behind it
    times = [start + i * interval for i in range(int(timedelta(days=3) / interval))]
    config = cfg(Stage(period, Completeness(0.01)), interval=interval, zone=zone)
    frame = lambda ts: spark.createDataFrame([(t, 1.0) for t in ts], "ts timestamp, v double").repartition(7)
    average(frame(times), config).table.collect()
    for place in (0, len(times) - 1):
        with pytest.raises(Exception, match="repeated"):
            average(frame([*times, times[place]]), config).table.collect()
    with pytest.raises(Exception, match="off the confirmed"):
        average(frame([*times, times[3] + interval / 2]), config).table.collect()
    with pytest.raises(Exception, match="missing"):
        average(frame([*times, None]), config).table.collect()


@pytest.mark.parametrize("interval", [HOUR, timedelta(minutes=5)])
def test_medians_of_all_sizes_agree(spark, interval, monkeypatch):
    """Held values, parts of values, and shared rank selection of three fields and a mean."""
    from gridwright.operators import averaging

    size = int(timedelta(days=5) / interval)
    data = [
        ("a" if i % 3 else None, START + i * interval, float(i * i % 101), None if i % 4 else float(i),
         None if i < size / 2 else -float(i % 7), float(i)) for i in range(size)]
    df = spark.createDataFrame(data, "k string, ts timestamp, x double, y double, z double, w double")
    config = cfg(
        Stage(day(), Completeness(0.01)), Stage(MonthPeriod(), Completeness(0.01)), interval=interval,
        keys=("k",), fields=[*[FieldRule(n, Statistic.MEDIAN) for n in "xyz"], FieldRule("w")])
    want = [rows(s.table) for s in average(df, config).stages]
    assert any(r[3] is not None for r in want[0]) and any(r[5] is None for r in want[0])
    monkeypatch.setattr(averaging, "MEDIAN_POINTS", 0)
    assert [rows(s.table) for s in average(df, config).stages] == want
    assert [rows(s.table) for s in average(df, config, strict=False).stages] == want


def test_rows_are_folded_before_their_only_exchange(spark):
    df = series(spark, [1.0] * 48).drop("_ord")
    plan = average(df, cfg(Stage(day()))).stages[0].frame
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in text and text.count("Aggregate") == 1


def test_middle_of_a_sorted_array(spark):
    from gridwright.operators.averaging import middle

    lists = [[], [3.0], [1.0, 4.0], [1.0, 2.0, 9.0], [1.0, 2.0, 7.0, 9.0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<double>")
    got = [r.m for r in df.select("i", middle(F.col("x")).alias("m")).orderBy("i").collect()]
    assert got == [None, 3.0, 2.5, 2.0, 4.5]


def test_readiness_of_an_averaging_plan(spark):
    from gridwright.config import MissingOutput
    from gridwright.plans.average import AveragePlan, readiness

    df = spark.createDataFrame([], "ts string, LAeq double, rain double, flag boolean, k string")
    good = cfg(Stage(day()), fields=[FieldRule("LAeq", Statistic.ENERGY_AVERAGE_LEQ), FieldRule("rain")], keys=("k",))
    assert readiness(df, AveragePlan(good)) == ([], [])
    bad = cfg(
        Stage(day()), keys=("site",),
        fields=[FieldRule("LAeq"), FieldRule("flag"), FieldRule("gone"),
                FieldRule("rain", Statistic.ENERGY_AVERAGE_LEQ)])
    errors, warnings = readiness(df, AveragePlan(bad, profile=None, missing=MissingOutput.CUSTOM))
    for words in ("column gone", "column site", "custom missing", "flag: no numbers", "need a profile"):
        assert sum(words in e for e in errors) == 1
    assert len(errors) == 5
    assert warnings == ["LAeq: its name suggests energy average leq", "rain: an energy average of a column that names no level"]
