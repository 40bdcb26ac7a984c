from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gridwright.config import InvalidPolicy
from gridwright.functions import numeric, temporal
from gridwright.functions.names import dtype
from gridwright.operators import calculated, cells, columns
from gridwright.operators.diagnostics import Diagnostics
from tests.conftest import rows


def texts(spark, name, *values):
    return spark.createDataFrame(list(enumerate(values, 1)), f"_ord bigint, `{name}` string")


def test_markers_match_text_and_numbers_by_type(spark):
    df = texts(spark, "PM", "", " n/A ", "-999", "MISSING", "12.5")
    notes = Diagnostics()
    out = cells.normalize_nulls(df, ["", "N/A", "missing", "-999"], ["PM"], notes=notes)
    assert [r[1] for r in rows(out)] == [None] * 4 + ["12.5"]
    assert notes.counts() == {"null_markers_normalized": 4}
    # A text -999 is not the number -999.
    assert rows(cells.normalize_nulls(df, [-999], ["PM"]).where("PM is null")) == []
    numbers = spark.createDataFrame([(-999, -999.0), (1, float("nan"))], "i int, d double")
    out = cells.normalize_nulls(numbers, [-999, float("nan")])
    assert rows(out) == [(1, None), (None, None)]


def test_invalid_numbers_and_policies(spark):
    df = texts(spark, "PM", "1", "2.5", "bad", "", None, "true", "inf", " 1e3 ", "1_000", ".5", "NaN", "1.5f")
    bad = rows(cells.invalid_numbers(df, ["PM"]), "_ord")
    assert [r[0] for r in bad] == [3, 4, 6, 7, 11, 12]
    kept = cells.resolve_invalid_numbers(df, ["PM"], "preserve_source")
    assert [(r.PM, r.PM_source) for r in kept.orderBy("_ord").take(4)] == [
        ("1", None), ("2.5", None), (None, "bad"), (None, ""),
    ]
    typed = cells.resolve_invalid_numbers(df, ["PM"], typed=True).orderBy("_ord").collect()
    assert [r.PM for r in typed][7:10] == [Decimal(1000), Decimal(1000), Decimal("0.5")]
    assert cells.resolve_invalid_numbers(df, ["PM"], "inspect").collect() == df.collect()
    with pytest.raises(Exception, match="invalid number in PM: bad"):
        cells.resolve_invalid_numbers(df.orderBy("_ord"), ["PM"], "stop").collect()
    two = spark.createDataFrame([(3, "x", "1"), (2, "y", "z"), (1, "1", "w"), (9, "q", "v")], "_ord int, a string, b string").repartition(3)
    for names, words in ((["a", "b"], "number in a: y"), (["b", "a"], "number in b: w")):
        with pytest.raises(Exception, match=words):
            cells.resolve_invalid_numbers(two, names, "stop").collect()
    flags = spark.createDataFrame([(True,)], "b boolean")
    assert rows(cells.invalid_numbers(flags.withColumn("_ord", F.lit(1)), ["b"])) == [(1, "b", "true")]


def test_null_row_rules(spark):
    df = spark.createDataFrame(
        [(1, None, None, "x"), (2, 1.0, 2.0, ""), (3, None, 2.0, None)], "_ord int, a double, b double, c string"
    )

    def gone(mode, names, least=None):
        left = {r._ord for r in cells.remove_null_rows(df, mode, names, least).collect()}
        return sorted({1, 2, 3} - left)

    assert gone("all_measurements_missing", ["a", "b"]) == [1]
    assert gone("any_required_missing", ["c"]) == [3]
    assert gone("below_present_threshold", ["a", "b", "c"], 2) == [1, 3]
    ids, counts = cells.preview_null_rows(df, "any_required_missing", ["a"])
    assert rows(ids) == [(1,), (3,)] and rows(counts) == [(2, 1)]
    for bad in (("nope", ["a"], None), ("any_required_missing", [], None),
                ("below_present_threshold", ["a"], None), ("any_required_missing", ["a"], 1)):
        with pytest.raises(ValueError):
            cells.null_row_match(*bad)


def test_missingness_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, ""), (None, None, "")], "PM double, Empty string, BlankText string")
    found = {r.column: (r.missing_count, r.missing_fraction, r.suggested) for r in cells.missingness(df).collect()}
    assert found == {"PM": (1, 0.5, True), "Empty": (2, 1.0, False), "BlankText": (0, 0.0, True)}
    assert columns.drop_empty_columns(df).columns == ["PM", "BlankText"]
    assert columns.drop_empty_columns(df, keep=["Empty"]).columns == df.columns
    none = df.where("false")
    assert {r.suggested for r in cells.missingness(none).collect()} == {True}


def test_rounding_and_concentrations(spark):
    df = texts(spark, "Value", "25.679", "-1.235", None, "0.025", "1.2")
    got = [r[1] for r in rows(cells.round_column(df, "Value", 2), "_ord")]
    assert got[:3] == [Decimal("25.68"), Decimal("-1.24"), None]
    ppb = cells.convert_concentration(df, "Value", "ppm_to_ppb", output="ppb")
    back = cells.convert_concentration(ppb, "ppb", "ppb_to_ppm", output="again")
    last = back.orderBy("_ord").collect()[-2:]
    assert [(r.ppb, r.again) for r in last] == [(Decimal(25), Decimal("0.025")), (Decimal(1200), Decimal("1.2"))]
    assert numeric.concentration_name("CO_PPM raw", "ppm_to_ppb") == "CO_ppb raw"
    assert numeric.concentration_name("CO", "ppb_to_ppm") == "CO_ppm"
    notes = Diagnostics()
    kept = cells.round_column(texts(spark, "Value", "x", "1.26"), "Value", 1, policy=InvalidPolicy.PRESERVE, notes=notes)
    assert [(r.Value, r.Value_source) for r in kept.collect()] == [(None, "x"), (Decimal("1.3"), None)]
    assert notes.counts() == {"invalid_numeric_values": 1}
    with pytest.raises(ValueError):
        numeric.round_half_up(F.lit(1), 13)


def test_formulas(spark):
    df = spark.createDataFrame([("2", "10"), ("4", "20")], "X string, Y string")
    x, y = calculated.field("X"), calculated.field("Y")
    out = calculated.add_calculated(df, "Z", (x + 3) * (y / 2), position=0)
    assert out.columns[0] == "Z" and [float(r.Z) for r in out.collect()] == [25.0, 70.0]
    notes = Diagnostics()
    raw = texts(spark, "Raw", "2", "ERROR", None)
    out = calculated.add_linear(raw, "Raw", "v", 2, 1, notes=notes)
    assert [r.v for r in out.collect()] == [Decimal(5), None, None]
    assert notes.counts() == {"calculation_failures": 2}
    assert calculated.add_calculated(df, "q", x / 0).first().q is None
    with pytest.raises(Exception, match="failed"):
        calculated.add_calculated(df, "q", x / 0, policy=InvalidPolicy.STOP).collect()
    for bad in ("nan", "inf"):
        with pytest.raises(ValueError):
            calculated.constant(bad)


@pytest.mark.parametrize("pattern,decimal,text,value", [
    ("#,##0.00", ",", "1.234,567", "1234.567"),
    ("#,##0.00", ".", "1,234.567", "1234.567"),
    ("#,##0.00", ",", "1 234,5", "1234.5"),
    ("#,##0.00", ",", "1 234,5", "1234.5"),
    ("0.00", ",", "12,5", "12.5"),
    ("0.00", ",", "1.234,5", None),
    ("#,##0.00", ",", "12.34,5", None),
    ("#,##0.00", ".", "1,23.5", None),
    ("0.0", ".", "5.", None),
    ("0.0", ".", ".5", None),
    ("0.0", ".", "-7", "-7"),
])
def test_localised_numbers(spark, pattern, decimal, text, value):
    mask = numeric.NumberMask(pattern, decimal)
    got = texts(spark, "v", text).select(mask.parse(F.col("v")).alias("n")).first().n
    assert got == (None if value is None else Decimal(value))


@pytest.mark.parametrize("pattern,decimal,value,text", [
    ("#,##0.00", ",", "1234.567", "1.234,57"), ("0.###", ".", "1.200", "1.2"),
    ("0.###", ".", "3", "3"), ("0.00", ".", "-1.235", "-1.24"), ("000.0", ".", "-7.25", "-007.3"),
    ("0", ".", "2.5", "3"), ("#,##0", ".", "1234567", "1,234,567"), ("0.0##", ".", "1", "1.0"),
    ("0.00", ".", "-0.001", "-0.00"),
])
def test_number_display(spark, pattern, decimal, value, text):
    mask = numeric.NumberMask(pattern, decimal)
    assert spark.range(1).select(mask.display(F.lit(Decimal(value)).cast("decimal(38,18)")).alias("t")).first().t == text


def test_masks_are_validated(spark):
    for bad in ("", "#.0", "0.0.0", "0." + "0" * 13, "abc"):
        with pytest.raises(ValueError):
            numeric.NumberMask(bad)
    with pytest.raises(ValueError):
        temporal.BooleanMask("Same|same")
    with pytest.raises(ValueError):
        temporal.TextMask("no placeholder")
    kept = numeric.NumberMask("0.0", ",", preserve=True)
    got = spark.range(1).select(kept.display(F.lit(Decimal("1.2345")).cast("decimal(38,18)"), full_precision=True).alias("t"))
    assert got.first().t == "1,2345"


def test_column_operations(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, `a.b` string, v double")
    assert columns.rename_column(df, "a.b", "c d").columns == ["id", "c d", "v"]
    assert columns.reorder_columns(df, ["v"]).columns == ["v", "id", "a.b"]
    assert columns.duplicate_column(df, "a.b", "copy", position=1).columns == ["id", "copy", "a.b", "v"]
    assert columns.add_empty_column(df, "e").dtypes[-1] == ("e", "string")
    indexed = columns.add_index_column(df, order="id", start=5)
    assert rows(indexed) == [(5, 1, "a", 2.0)]
    assert columns.final_projection(df, [("a.b", "x")], ["v", "nope"]).columns == ["x", "v"]
    for bad in (
        lambda: columns.rename_column(df, "id", "v"), lambda: columns.rename_column(df, "id", " "),
        lambda: columns.rename_column(df, "zz", "y"), lambda: columns.reorder_columns(df, ["v"], append_unlisted=False),
        lambda: columns.select_columns(df, ["v", "v"]), lambda: columns.duplicate_column(df, "v", "id"),
        lambda: columns.add_empty_column(df, "e", position=9),
    ):
        with pytest.raises(ValueError):
            bad()
    assert dtype(df, "a.b").simpleString() == "string"
