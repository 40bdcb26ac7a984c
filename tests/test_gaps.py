from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridwright.config import Derivation, GapBehavior, GapConfig, GapField
from gridwright.errors import DataViolation
from gridwright.operators import gaps, ordering
from tests.conftest import rows

HOUR = timedelta(hours=1)
CONFIG = GapConfig("t", HOUR)


def at(hour, minute=0):
    return datetime(2025, 8, 20, hour, minute)


def stamps(spark, *values):
    return spark.createDataFrame(list(enumerate(values, start=1)), "_ord bigint, t timestamp_ntz")


def test_interval_grid_and_spans(spark):
    df = stamps(spark, at(8), at(9), at(11), at(12), at(15))
    found = gaps.suggest_interval(df, "t").first()
    assert (found.interval_seconds, found.matching_steps, found.total_steps, found.label) == (3600.0, 2, 4, "1 hour")
    assert [r[0] for r in rows(gaps.expected_grid(df, CONFIG), "t")] == [at(h) for h in range(8, 16)]
    assert [r[0] for r in rows(gaps.missing_timestamps(df, CONFIG), "t")] == [at(10), at(13), at(14)]
    assert rows(gaps.gap_spans(df, CONFIG), "previous") == [(at(9), at(11), 1), (at(12), at(15), 2)]


def test_violations(spark):
    df = stamps(spark, at(10), at(9), at(10), None, at(11, 30))
    assert [r[0] for r in rows(gaps.duplicate_members(df, "t").select("_ord"))] == [1, 3]
    assert [r[0] for r in rows(gaps.chronological_breaks(df, "t").select("_ord"))] == [2]
    assert [r[0] for r in rows(gaps.invalid_timestamps(df, "t"))] == [4]
    assert [r[0] for r in rows(gaps.off_grid_rows(df, CONFIG).select("_ord"))] == [5]
    assert dict(rows(gaps.gap_violations(df, CONFIG))) == {
        "invalid": 1, "duplicate": 1, "off_grid": 1, "disorder": 1,
    }


def test_trailing_slots_before_an_off_grid_row_are_missing_but_in_no_span(spark):
    df = stamps(spark, at(8), at(9), at(12, 30))
    assert [r[0] for r in rows(gaps.missing_timestamps(df, CONFIG), "t")] == [at(10), at(11), at(12)]
    assert rows(gaps.gap_spans(df, CONFIG)) == []


def test_generated_rows_follow_their_policies(spark):
    start = datetime(2025, 8, 20, 8, tzinfo=UTC)
    data = [
        (start + h * HOUR, start + (h + 1) * HOUR, date(2025, 8, 20), "Station A", float(h), 99, False)
        for h in (0, 2)
    ]
    df = spark.createDataFrame(
        data, "t timestamp, end timestamp, day date, station string, `PM2.5` double, Index int, made boolean"
    )
    config = GapConfig(
        "t", HOUR, ("PM2.5",),
        (
            GapField("end", GapBehavior.DERIVED_FROM_TIMESTAMP, derivation=Derivation.INTERVAL_END, zone="Asia/Colombo"),
            GapField("day", GapBehavior.DERIVED_FROM_TIMESTAMP, derivation=Derivation.DATE),
            GapField("station", GapBehavior.CARRY_STABLE),
        ),
        index_column="Index", flag_column="made",
    )
    got = rows(gaps.generate_gap_rows(df, config).withColumn("end", F.unix_seconds("end")), "t")
    assert [r[3] for r in got] == ["Station A"] * 3
    assert [r[4] for r in got] == [0.0, None, 2.0]
    assert [r[5] for r in got] == [1, 2, 3]
    assert [r[6] for r in got] == [False, True, False]
    assert got[1][1] == int((start + 2 * HOUR).timestamp()) and got[1][2] == date(2025, 8, 20)


def test_unstable_metadata_and_violations_block(spark):
    df = stamps(spark, at(8), at(10)).withColumn("s", F.col("_ord").cast("string"))
    config = GapConfig("t", HOUR, fields=(GapField("s", GapBehavior.CARRY_STABLE),))
    with pytest.raises(Exception, match="not stable"):
        gaps.generate_gap_rows(df, config).collect()
    cases = {"duplicate: 1": (at(8), at(8)), "invalid: 1": (at(8), None),
             "off_grid: 1": (at(8), at(9, 30)), "disorder: 1": (at(9), at(8))}
    for words, bad in cases.items():
        found = gaps.generate_gap_rows(stamps(spark, *bad), CONFIG)  # nothing runs yet
        with pytest.raises(Exception, match=words):
            found.collect()
        with pytest.raises(DataViolation, match=words):
            gaps.require_reconstructable(stamps(spark, *bad), CONFIG)
    ok = gaps.generate_gap_rows(stamps(spark, at(9), at(7)), GapConfig("t", HOUR, allow_reorder=True))
    assert ok.count() == 3


def test_row_limit(spark):
    df = stamps(spark, at(0), at(20))
    with pytest.raises(Exception, match="expected rows"):
        gaps.expected_grid(df, GapConfig("t", HOUR, max_expected_rows=10)).collect()
    assert gaps.suggest_interval(stamps(spark, at(1)), "t").count() == 0


def test_long_gaps_cross_blocks(spark):
    # Two instants 20,000 minutes apart: the gap spans several blocks of slots.
    df = stamps(spark, datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(minutes=20_000))
    config = GapConfig("t", timedelta(minutes=1))
    assert gaps.missing_timestamps(df, config).distinct().count() == 19_999
    assert rows(gaps.gap_report(df, config)) == [(2, 19_999)]


@pytest.mark.parametrize("parts", [1, 5])
def test_keyed_series_match_brute_force(spark, parts):
    start = datetime(2024, 3, 1)
    data = [
        (k, start + timedelta(minutes=15 * i))
        for k, keep in (("a", 3), ("b", 5), (None, 7))
        for i in range(0, 9000, 1) if i % keep or i % 11 == 0
    ]
    df = spark.createDataFrame(data, "k string, t timestamp_ntz").repartition(parts)
    config = GapConfig("t", timedelta(minutes=15), keys=("k",))
    want = set()
    for k in ("a", "b", None):
        have = sorted(t for key, t in data if key == k)
        grid = have[0]
        while grid <= have[-1]:
            if grid not in set(have[:0]):
                want.add((k, grid))
            grid += timedelta(minutes=15)
    want -= set(data)
    got = gaps.missing_timestamps(df, config).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_contiguous_index_over_many_chunks(spark):
    df = spark.range(0, 5000).select((F.col("id") * 3).alias("_ord"), (F.col("id") % 3).alias("k")).repartition(7)
    whole = ordering.with_position(df, "_ord", "n", width=64)
    assert rows(whole.select("_ord", "n"), "n") == [(i * 3, i + 1) for i in range(5000)]
    keyed = ordering.with_position(df, "_ord", "n", keys=["k"], start=0, width=100)
    got = {(r._ord, r.n) for r in keyed.collect()}
    assert got == {(i * 3, i // 3) for i in range(5000)}


@pytest.mark.parametrize("width", [1, 10, ordering.CHUNK_ROWS])
def test_successive_pairs_stitch_chunks(spark, width):
    spread = [*range(1, 400), *(10**12 + 7 * i for i in range(300)), *(-(2**60) + 2**40 * i for i in range(300)),
              2**63 - 1, -(2**63)]
    data = [(k, v) for v in spread for k in ("a", None)]
    df = spark.createDataFrame(data, "k string, id bigint").repartition(6)
    pairs = ordering.successive_pairs(df, ["k"], "id", ["id"], width=width)
    spread.sort()
    got = rows(pairs.select("k", "prev.id", "next.id"))
    assert got == sorted(((k, a, b) for a, b in zip(spread, spread[1:]) for k in ("a", None)), key=repr)


def test_chunks_never_hold_more_rows_than_wanted(spark):
    n = 20_000
    sparse = spark.range(n).select((F.col("id") * 9_007_199_254_740 - 2**60).alias("o"))
    clustered = spark.range(n).select(
        F.when(F.col("id") % 100 > 0, F.col("id")).otherwise(F.col("id") * 10**12).alias("o"))
    outlier = spark.range(n).select(F.when(F.col("id") > 0, F.col("id")).otherwise(-(2**62)).alias("o"))
    for df in (sparse, clustered, outlier):
        sizes = [r["count"] for r in ordering.with_chunk(df, "o", 200).groupBy("__chunk").count().collect()]
        assert max(sizes) <= 200 and len(sizes) >= 50
        placed = ordering.with_position(df, "o", "n", width=200).orderBy("o").collect()
        assert [r.n for r in placed] == list(range(1, n + 1))


@pytest.mark.parametrize("kind", ["double", "decimal(18,3)", "decimal(38,3)", "timestamp", "date"])
def test_positions_along_other_kinds_of_columns(spark, kind):
    value = (F.col("id") - 250) * 37
    value = F.timestamp_seconds(value) if kind == "timestamp" else F.date_from_unix_date(value.cast("int")) if kind == "date" else (value / 1000).cast(kind)
    df = spark.range(500).select(value.alias("o"), "id").repartition(5)
    got = ordering.with_position(df, "o", "n", width=16).orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, 501))
