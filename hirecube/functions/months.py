"""Months: ``YYYYMM`` text at the source, ``YYYY-MM`` text as partition key, dates for series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirecube.functions.text import strip

_FIRST_YEAR, _LAST_YEAR = 1678, 2261


def norm_competence(col: Column) -> Column:
    """Digits only, zero-padded to six; longer texts are left as they are."""
    digits = F.regexp_replace(F.coalesce(strip(col), F.lit("")), "[^0-9]", "")
    return F.when(F.length(digits) < 6, F.lpad(digits, 6, "0")).otherwise(digits)


def month_of(col: Column) -> Column:
    """``YYYYMM`` -> ``YYYY-MM``; null for anything that is no month of a plausible year."""
    text = strip(col)
    year, month = F.substring(text, 1, 4), F.substring(text, 5, 2)
    valid = (
        text.rlike("^[0-9]{6}$")
        & month.between("01", "12")
        & year.between(str(_FIRST_YEAR), str(_LAST_YEAR))
    )
    return F.when(valid, F.concat_ws("-", year, month))


def first_of_month(col: Column) -> Column:
    return F.to_date(F.concat(col, F.lit("-01")), "yyyy-MM-dd")


def month_index(col: Column) -> Column:
    """``YYYY-MM`` -> months since year 0, so that calendar distance is a subtraction."""
    return (F.substring(col, 1, 4).cast("int") * 12 + F.substring(col, 6, 2).cast("int") - 1)


def month_text(index: Column) -> Column:
    """Inverse of :func:`month_index`."""
    year = F.floor(index / 12).cast("int")
    return F.format_string("%04d-%02d", year, (index - year * 12 + 1).cast("int"))


def month_date(index: Column) -> Column:
    year = F.floor(index / 12).cast("int")
    return F.make_date(year, (index - year * 12 + 1).cast("int"), F.lit(1))
