"""Numeric text, half-up rounding, unit factors and number display masks."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from gridwright.functions.names import is_float, is_text

DECIMAL = "decimal(38,18)"

# Characters that count as white space at the ends of a text cell.
SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim white space of any kind; Spark's own trim removes blanks only."""
    return F.btrim(text, F.lit(SPACE))


# A finite decimal number. Possessive quantifiers keep long non-numbers from backtracking.
NUMBER = r"^[+-]?(?:\d++\.?\d*+|\.\d++)(?:[eE][+-]?\d++)?$"


def _plain_number(text: Column) -> Column:
    """Stripped text without the underscores that may group digits."""
    bare = strip(text)
    return F.when(text.contains("_"), F.translate(bare, "_", "")).otherwise(bare)


def to_decimal(value: Column, kind: T.DataType, target: str = DECIMAL) -> Column:
    """Finite DECIMAL of a text or numeric column, null where it is not a finite number.

    Booleans and temporal values are never numeric.
    """
    if is_text(kind):
        # Nearly every cell reads as it stands; only the rest is stripped and tried again.
        return F.coalesce(value.try_cast(target), _plain_number(value).try_cast(target))
    if isinstance(kind, T.NumericType):
        return value.try_cast(target)
    return F.lit(None).cast(target)


def to_double(value: Column, kind: T.DataType) -> Column:
    """DOUBLE of a text or numeric column, null where it is not a finite number."""
    if is_text(kind):
        # The shape check comes first: Spark also reads NaN, Infinity and Java's 1.5f.
        plain = _plain_number(value)
        return F.when(value.rlike(NUMBER), value.try_cast("double")).when(
            plain.rlike(NUMBER), plain.try_cast("double")
        )
    if is_float(kind):
        number = value.cast("double")
        return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    return F.lit(None).cast("double")


def is_number(value: Column, kind: T.DataType) -> Column:
    """True where a non-null cell holds a finite number."""
    if is_text(kind):
        return value.rlike(NUMBER) | _plain_number(value).rlike(NUMBER)
    if is_float(kind):
        return ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.lit(isinstance(kind, T.NumericType))


def round_half_up(number: Column, decimals: int) -> Column:
    if not -12 <= decimals <= 12:
        raise ValueError("rounding takes -12 to 12 decimals")
    return F.round(number, decimals)


# Unit factors of the two concentration conversions.
CONCENTRATION = {
    "ppm_to_ppb": ("1000", "decimal(4,0)", "ppm", "ppb"),
    "ppb_to_ppm": ("0.001", "decimal(3,3)", "ppb", "ppm"),
}

# 15 + 18 digits keep both products exact inside DECIMAL(38).
CONCENTRATION_INPUT = "decimal(33,18)"


def concentration(number: Column, conversion: str) -> Column:
    factor, kind, _, _ = CONCENTRATION[conversion]
    return (number * F.lit(factor).cast(kind)).cast(DECIMAL)


def concentration_name(column: str, conversion: str) -> str:
    """Column name with its unit replaced, or the new unit appended."""
    _, _, old, new = CONCENTRATION[conversion]
    swapped, hits = re.subn(re.escape(old), new, column, count=1, flags=re.IGNORECASE)
    return swapped if hits else f"{column}_{new}"


@dataclass(frozen=True)
class NumberMask:
    """A ``0`` / ``0.00`` / ``0.###`` / ``#,##0.00`` mask with a decimal separator."""

    pattern: str
    decimal: str = "."
    preserve: bool = False

    def __post_init__(self) -> None:
        if self.decimal not in (".", ","):
            raise ValueError("the decimal separator is a dot or a comma")
        if not 0 < len(self.pattern) <= 120:
            raise ValueError("a mask has 1-120 characters")
        if not re.fullmatch(r"(#,##)?0+(\.0*#*)?", self.pattern):
            raise ValueError(f"unsupported number mask {self.pattern!r}")
        if self.places > 12:
            raise ValueError("a mask has at most 12 decimal places")

    @property
    def whole(self) -> str:
        return self.pattern.split(".")[0]

    @property
    def fraction(self) -> str:
        return self.pattern[len(self.whole) + 1 :]

    @property
    def places(self) -> int:
        return len(self.fraction)

    @property
    def grouped(self) -> bool:
        return "," in self.pattern

    def parse(self, text: Column) -> Column:
        """Localised text to DECIMAL, never rounded; null where the text does not fit.

        Thousands separators need a grouped mask and strict groups of three.
        """
        dot = re.escape(self.decimal)
        group = "," if self.decimal == "." else "."
        value = F.translate(strip(text), "\u202f\u00a0", "  ")
        plain = rf"^[+-]?\d+({dot}\d+)?$"
        fits = value.rlike(plain)
        if self.grouped:
            for separator in (re.escape(group), " "):
                fits = fits | value.rlike(rf"^[+-]?\d{{1,3}}({separator}\d{{3}})+({dot}\d+)?$")
        # Separators past the first have no counterpart, so translate drops them.
        digits = F.translate(value, f"{self.decimal}{group} ", ".")
        return F.when(fits, digits.try_cast(DECIMAL))

    def rounded(self, number: Column) -> Column:
        return number if self.preserve else F.round(number, self.places)

    def display(self, number: Column, *, full_precision: bool = False) -> Column:
        """Text of a DECIMAL. Display always rounds, except a preserved value on its way to a
        delimited file (``full_precision``)."""
        if self.preserve and full_precision:
            raw = number.cast("string")
            raw = F.when(raw.contains("."), F.rtrim(raw, F.lit("0"))).otherwise(raw)
            raw = F.rtrim(raw, F.lit("."))
            return F.translate(raw, ".", self.decimal)
        rounded = F.round(number, self.places)
        text = F.format_number(rounded, self.places)
        text = F.when((number < 0) & (rounded == 0), F.concat(F.lit("-"), text)).otherwise(text)
        text = text if self.grouped else F.translate(text, ",", "")
        optional = len(self.fraction) - len(self.fraction.rstrip("#"))
        if optional:
            text = F.regexp_replace(text, rf"0{{1,{optional}}}$", "")
            text = F.rtrim(text, F.lit("."))
        width = self.whole.count("0")
        if not self.grouped and width > 1:
            sign = F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit(""))
            body = F.ltrim(text, F.lit("-"))
            whole = F.substring_index(body, ".", 1)
            rest = F.substring(body, F.length(whole) + 1, F.length(body))
            missing = F.greatest(F.lit(width) - F.length(whole), F.lit(0))
            text = F.concat(sign, F.repeat(F.lit("0"), missing), whole, rest)
        return F.translate(text, ".,", ",.") if self.decimal == "," else text
