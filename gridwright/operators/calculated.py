"""Calculated fields: a closed tree of columns, constants and four operators."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from gridwright.config import InvalidPolicy
from gridwright.functions.names import col, dtype, put
from gridwright.functions.numeric import to_decimal
from gridwright.operators.diagnostics import Diagnostics, watch

# Operands of 22 digits leave at least 13 decimal places in products and quotients.
OPERAND = "decimal(22,10)"

OPERATIONS = {
    "add": F.try_add,
    "subtract": F.try_subtract,
    "multiply": F.try_multiply,
    "divide": F.try_divide,
}


@dataclass(frozen=True)
class Expression:
    """Node of a formula; build with ``field``, ``constant`` and the Python operators."""

    operation: str
    parts: tuple = ()

    def __add__(self, other: object) -> Expression:
        return Expression("add", (self, as_expression(other)))

    def __sub__(self, other: object) -> Expression:
        return Expression("subtract", (self, as_expression(other)))

    def __mul__(self, other: object) -> Expression:
        return Expression("multiply", (self, as_expression(other)))

    def __truediv__(self, other: object) -> Expression:
        return Expression("divide", (self, as_expression(other)))

    def column(self, df: DataFrame, operand: str = OPERAND) -> Column:
        if self.operation == "field":
            return to_decimal(col(self.parts[0]), dtype(df, self.parts[0]), operand)
        if self.operation == "constant":
            return F.lit(self.parts[0])
        left, right = (p.column(df, operand) for p in self.parts)
        return OPERATIONS[self.operation](left, right)


def field(name: str) -> Expression:
    return Expression("field", (name,))


def constant(value: object) -> Expression:
    number = Decimal(str(value).strip())
    if not number.is_finite():
        raise ValueError("a constant must be finite")
    return Expression("constant", (number,))


def as_expression(value: object) -> Expression:
    return value if isinstance(value, Expression) else constant(value)


def add_calculated(
    df: DataFrame,
    output: str,
    expression: Expression,
    *,
    position: int | None = None,
    policy: InvalidPolicy = InvalidPolicy.NULL,
    operand: str = OPERAND,
    notes: Diagnostics | None = None,
) -> DataFrame:
    """Append a formula. A null or non-numeric operand and a division by zero count as
    failures and give null (PRESERVE has nothing to preserve, so it acts as NULL)."""
    value = expression.column(df, operand)
    df = watch(notes, df, "calculation_failures", F.count_if(value.isNull()))
    if policy is InvalidPolicy.STOP:
        failed = F.raise_error(F.lit(f"calculated field {output} failed"))
        value = F.when(value.isNull(), failed.cast(T.DecimalType(38, 18))).otherwise(value)
    return put(df, output, value, position=position)


def add_linear(
    df: DataFrame, source: str, output: str, multiplier: object, intercept: object = 0, **options
) -> DataFrame:
    """``multiplier * source + intercept``."""
    return add_calculated(
        df, output, constant(multiplier) * field(source) + constant(intercept), **options
    )
