"""Checked unsigned arithmetic on decimal(38,0); NULL means undecidable."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WIDE = "decimal(38,0)"


def wide(value: Column) -> Column:
    """A value as an exact integer; NULL when it does not fit."""
    return value.try_cast(WIDE)


def inv_add(a: Column, b: Column) -> Column:
    return F.try_add(wide(a), wide(b)).try_cast(WIDE)


def inv_sub(a: Column, b: Column) -> Column:
    """Unsigned subtraction: going below zero is undecidable, not a violation."""
    return F.when(wide(a) >= wide(b), F.try_subtract(wide(a), wide(b)).try_cast(WIDE))


def inv_mul(a: Column, b: Column) -> Column:
    return F.try_multiply(wide(a), wide(b)).try_cast(WIDE)


def inv_div(a: Column, b: Column) -> Column:
    """Truncating integer division; a zero divisor is undecidable."""
    x, y = wide(a), wide(b)
    return F.try_divide(x - F.try_mod(x, y), y).try_cast(WIDE)


def inv_and(left: Column, right: Column) -> Column:
    """Left to right: an undecidable left side decides nothing about the right."""
    return F.when(left.isNull(), None).when(~left, F.lit(False)).otherwise(right)


def inv_or(left: Column, right: Column) -> Column:
    return F.when(left.isNull(), None).when(left, F.lit(True)).otherwise(right)


def truthy(value: Column) -> Column:
    """Integers are true unless zero."""
    return wide(value) != 0
