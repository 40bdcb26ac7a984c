from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridwright.functions.numeric import NumberMask
from gridwright.operators import ordering, profile
from gridwright.sources import delimited, sinks, verify
from tests.conftest import rows

MONITORING = """DateTime_UTC,Source,PM2.5,Temperature,Unused
2025-08-20 08:00,Station A,10.5,28.1,
2025-08-20 09:00,Station A,N/A,28.4,
2025-08-20 10:00,Station A,11.0,28.9,
2025-08-20 11:00,Station A,12.2,-999,
2025-08-20 12:00,Station A,12.9,29.5,
2025-08-20 13:00,Station A,13.1,30.0,
2025-08-20 14:00,Station A,12.0,29.8,
2025-08-20 15:00,Station A,11.4,29.1,
2025-08-20 16:00,Station A,11.1,28.7,
2025-08-20 17:00,Station A,10.8,28.2,
"""


@pytest.fixture
def monitoring(spark, tmp_path):
    path = tmp_path / "monitoring.csv"
    path.write_text(MONITORING)
    return delimited.read_delimited(spark, str(path))


def test_profile_of_a_monitoring_file(monitoring):
    names = [n for n in monitoring.columns if n != "_ord"]
    found = {r.column: r for r in profile.column_profile(monitoring).collect()}
    assert set(found) == set(names)
    assert [n for n in names if found[n].entirely_empty] == ["Unused"]
    assert {n: found[n].inferred_type for n in names} == {
        "DateTime_UTC": "DateTime", "Source": "Category", "PM2.5": "Decimal", "Temperature": "Decimal", "Unused": "Empty",
    }
    assert (found["PM2.5"].marker_count, found["PM2.5"].missing_percent) == (1, 10.0)
    assert found["Source"].unique_count == 1 and found["DateTime_UTC"].examples[0] == "2025-08-20 08:00"
    assert rows(profile.missing_markers(monitoring, names)) == [("-999", 1), ("N/A", 1)]
    types = profile.infer_types(monitoring)
    assert profile.likely_datetime_column(types) == "DateTime_UTC"
    read = monitoring.withColumn("t", profile.read_moment(F.col("DateTime_UTC")))
    assert rows(profile.likely_interval(read, "t")) == [(3600.0, 9, "1 hour")]
    slices = profile.preview_slices(monitoring.select("_ord", "`PM2.5`")).select("slice", "position").collect()
    starts = {s: min(r.position for r in slices if r.slice == s) for s in ("First", "Middle", "Last")}
    assert starts == {"First": 1, "Middle": 3, "Last": 6}
    assert [p.start for p in profile.preview_ranges(10)] == [1, 3, 6] and profile.preview_ranges(0) == []


@pytest.mark.parametrize("values,kind,ambiguous", [
    (["yes", "No", "Y"], "Boolean", False), (["1", "-2", "1_000"], "Integer", False),
    (["1.5", "2e3", "3"], "Decimal", False), (["nan1", "x", "y"], "Text", False),
    (["01/02/2024", "03/04/2024"], "Date", True), (["13/02/2024", "03/04/2024"], "Date", False),
    (["08:00", "09:30:00"], "Time", False), (["2024-01-01T00:00:00Z", "2024-01-01 10:00"], "DateTime", False),
    (["a", "b", "a", "b", "a"], "Category", False), ([], "Empty", False),
    (["20240101x", "20240102x", "2024", "q"], "Text", False),
])
def test_type_ladder(spark, values, kind, ambiguous):
    df = spark.createDataFrame(list(enumerate([*values, "", "N/A"])), "_ord bigint, v string")
    for limit in (1000, None):
        got = profile.infer_types(df, ["v"], sample_limit=limit).first()
        assert (got.inferred_type, got.ambiguous_regional, got.n) == (kind, ambiguous, len(values))


def test_sample_limit_looks_at_the_first_values_only(spark):
    df = spark.range(0, 60).select(
        F.col("id").alias("_ord"), F.when(F.col("id") < 10, F.col("id").cast("string")).otherwise("text").alias("v"))
    assert profile.infer_types(df, ["v"], sample_limit=10).first().inferred_type == "Integer"
    assert profile.infer_types(df, ["v"], sample_limit=None).first().inferred_type == "Category"


def test_headers_and_headerless_files(spark, tmp_path):
    assert delimited.normalize_headers([" a ", "", None, "a", "a"]) == ["a", "Column 2", "Column 3", "a (2)", "a (3)"]
    (tmp_path / "x.tsv").write_text("alpha\t1\nbeta\t2\n")
    options = delimited.DelimitedOptions(delimiter="\t", header=False)
    df = delimited.read_delimited(spark, str(tmp_path / "x.tsv"), options, ordinal=None)
    assert df.columns == ["Column 1", "Column 2"] and rows(df) == [("alpha", "1"), ("beta", "2")]
    (tmp_path / "l.csv").write_bytes("name;value\ncaf\xe9;2\n".encode("latin-1"))
    options = delimited.DelimitedOptions(delimiter=";", encoding="ISO-8859-1")
    assert rows(delimited.read_delimited(spark, str(tmp_path / "l.csv"), options, ordinal=None)) == [("café", "2")]


def test_empty_short_long_and_blank_rows(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text('a,b,c\n1,,""\n2\n3,x,"y,z",extra\n,,\n  ,,\n')
    df = delimited.read_delimited(spark, str(path))
    got = [tuple(r)[:3] for r in df.orderBy("_ord").collect()]
    assert got == [("1", "", ""), ("2", None, None), ("3", "x", "y,z"), ("  ", "", "")]
    assert delimited.read_delimited(spark, str(path), drop_blank="strip").count() == 3
    assert rows(delimited.field_count_report(spark, str(path))) == [(1, 1), (3, 4), (4, 1)]
    nulls = delimited.read_delimited(spark, str(path), keep_empty_text=False).orderBy("_ord").first()
    assert (nulls.b, nulls.c) == (None, "")


def test_compatibility_of_a_file_batch(spark, tmp_path):
    good = tmp_path / "a.csv"
    good.write_text("t,v\n1,2\n")
    (tmp_path / "b.csv").write_text("t,v\n3,4\n")
    (tmp_path / "c.csv").write_text("v,t\n3,4\n")
    (tmp_path / "d.txt").write_text("t,v\n3,4\n")
    (tmp_path / "e.csv").write_text("t;v\n3;4\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv", "c.csv", "d.txt", "e.csv")]
    found = {r.file.rsplit("/", 1)[-1]: r.reason for r in delimited.batch_compatibility(spark, paths).collect()}
    assert found["a.csv"] is None and found["b.csv"] is None
    assert "column names" in found["c.csv"] and "file type" in found["d.txt"] and "delimiter" in found["e.csv"]
    more = {"f.csv": "", "g.csv": "\n \n", "h.csv": "v;t\n3;4\n", "i.csv": "t,v\n'x','a b'\n", "j.csv": "1,2\n3,4\n",
            "k.csv": "t,v\n" + "1,2\n" * 50_000}
    for name, content in more.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "_hidden").write_text("x")
    (tmp_path / "l" / "p.csv").write_text("t,v\n")
    again = delimited.batch_compatibility(spark, [*paths, *(str(tmp_path / n) for n in (*more, "l"))])
    reasons = {r.file.rsplit("/", 1)[-1]: r.reasons for r in again.collect()}
    assert len(reasons) == 12 and reasons["k.csv"] == reasons["p.csv"] == []
    assert reasons["f.csv"] == reasons["g.csv"] == ["the file is empty"]
    assert [r.split()[0] for r in reasons["h.csv"]] == ["ordered", "delimiter"]
    assert [r.split()[0] for r in reasons["i.csv"]] == ["quote-character"]
    assert [r.split()[0] for r in reasons["j.csv"]] == ["ordered", "header"]
    both = delimited.read_delimited(spark, paths[:2], source_column="file", ordinal=None)
    assert both.select("file").distinct().count() == 2


def test_null_and_empty_text_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("v", None, "w"), ("v", "", 'say "hi", you')], "a string, b string, c string")
    path = str(tmp_path / "out")
    sinks.write_delimited(df, path, order=["a", "c"])
    text = "\n".join(r.value for r in spark.read.text(path).collect())
    assert "v,,w" in text and 'v,"",' in text
    back = delimited.read_delimited(spark, path, keep_empty_text=False, ordinal=None)
    checks, status = verify.verify_output(back, df)
    assert status == "Passed with warnings" and all(r.passed for r in checks.collect())
    with pytest.raises(Exception, match="exist"):
        sinks.write_delimited(df, path)


def test_verification_notices_changes(spark):
    df = spark.createDataFrame([("2025-01-01 00:00:00", "1"), ("2025-01-01 01:00:00", None)], "Time string, v string")
    assert verify.verify_output(df, df)[1] == "Passed"
    for changed in (df.limit(1), df.select("v", "Time"), df.fillna("", ["v"]),
                    df.withColumn("Time", F.lit("soon"))):
        assert verify.verify_output(changed, df)[1] == "Failed"
    both = df.select("Time", F.col("v").alias("Index"), F.col("v").alias("index"))
    assert verify.verify_output(both, both)[1] == "Failed"
    diff = rows(verify.differing_rows(df.fillna("", ["v"]), df))
    assert [d[0] for d in diff] == ["missing", "unexpected"]


def test_missing_output_policies(spark):
    df = spark.createDataFrame([(None, 1.5), (datetime(2025, 1, 1), None)], "t timestamp_ntz, v double")
    assert rows(sinks.apply_missing(df, "na")) == [("2025-01-01 00:00:00", "N/A"), ("N/A", "1.5")]
    assert rows(sinks.apply_missing(df, "custom", -1)) == [("-1", "1.5"), ("2025-01-01 00:00:00", "-1")]
    masked = spark.createDataFrame([(Decimal("1234.5"),)], "v decimal(10,2)")
    assert rows(sinks.apply_missing(masked, masks={"v": NumberMask("#,##0.00", ",")})) == [("1.234,50",)]
    for bad in (("custom", None), ("na", 5)):
        with pytest.raises(ValueError):
            sinks.missing_text(*bad)


def test_publish_is_all_or_nothing(spark, tmp_path):
    target, staging = str(tmp_path / "final"), str(tmp_path / "pending")

    def fails(path):
        spark.range(1).write.parquet(path)
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError):
        sinks.publish(fails, staging, target, spark)
    assert not (tmp_path / "pending").exists() and not (tmp_path / "final").exists()
    sinks.publish(lambda p: spark.range(3).write.parquet(p), staging, target, spark)
    with pytest.raises(FileExistsError):
        sinks.publish(lambda p: None, staging, target, spark)
    sinks.publish(lambda p: spark.range(5).write.parquet(p), staging, target, spark, overwrite=True)
    assert spark.read.parquet(target).count() == 5


def test_one_hot_period_is_written_as_many_ordered_files(spark, tmp_path):
    df = spark.range(0, 4000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("p"), F.col("id").alias("t")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_periods(df, str(tmp_path / "p"), ["p"], ["t"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted(f for f in (tmp_path / "p" / "p=hot").iterdir() if f.suffix == ".parquet")
    assert len(files) > 1
    seen = [r.t for f in files for r in spark.read.parquet(str(f)).collect()]
    assert seen == sorted(seen) and len(seen) == 2666


def test_bad_sources_do_not_fail_the_rest(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "f string, v int")
    good, outcome = delimited.isolate_bad_sources(df, df.where("v = 3"), "f")
    assert rows(good) == [("a", 1), ("a", 2)]
    assert rows(outcome) == [("a", 2, True, 0), ("b", 1, False, 1)]


def test_ordinal_is_unique_and_in_order(spark, monitoring):
    got = [r._ord for r in monitoring.orderBy("DateTime_UTC").collect()]
    assert got == sorted(set(got)) and "_ord" in ordering.with_ordinal(spark.range(1)).columns
