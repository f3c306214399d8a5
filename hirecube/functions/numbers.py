"""Numeric parsing, safe ratios and report rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirecube.functions.text import strip

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_number_or_null(col: Column) -> Column:
    """Double for plain decimal spellings, else null (Java-only forms such as ``1d`` are refused)."""
    text = strip(col.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def parse_decimal_comma(col: Column) -> Column:
    """``1.850,40`` -> 1850.4: dots group thousands, the comma is the decimal mark."""
    text = F.replace(F.replace(col.cast("string"), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return to_number_or_null(text)


def to_integer_or_null(col: Column) -> Column:
    """Whole numbers only: ``31`` and ``31.0`` give 31, ``31.5`` gives null."""
    number = to_number_or_null(col)
    return F.when(number == F.floor(number), number.try_cast("int"))


def safe_ratio(num: Column, den: Column) -> Column:
    """Null, not an error, where the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def total(col: Column | str, snap: int | None = None) -> Column:
    """Sum, optionally snapped to ``snap`` digits.

    Partial sums of doubles meet in an order that changes with partitioning and
    task retries. Data known to hold cents can be snapped to cents, which makes
    the sum (and each ratio taken from it) the same in every run.
    """
    out = F.sum(F.col(col) if isinstance(col, str) else col)
    return out if snap is None else F.round(out, snap)


def weighted(num: str, den: str, snap: int | None = None) -> Column:
    """SUM(num) / SUM(den), the exact mean behind sums and counts."""
    return safe_ratio(total(num, snap), F.sum(den))


def report_round(col: Column, digits: int) -> Column:
    """Scale, round to the nearest whole number with ties to even, scale back: the usual array rounding."""
    return F.rint(col * 10.0**digits) / 10.0**digits


def finite_or_null(col: Column) -> Column:
    """NaN and infinities have no place in JSON."""
    bad = F.isnan(col) | (col == float("inf")) | (col == float("-inf"))
    return F.when(~bad, col)


def log_target(col: Column) -> Column:
    return F.log(col)
