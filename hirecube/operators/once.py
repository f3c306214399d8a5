"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select_once(df: DataFrame, *cols: Column | str) -> DataFrame:
    """``df.select(*cols)`` whose expressions are not copied into later filters.

    Catalyst pushes a filter below a projection by repeating the projected
    expression inside the predicate. For parsing that means running the same
    regular expressions several times per row. A generator is a boundary for that
    rule, and one that emits exactly one row per row changes nothing else.
    """
    named = [F.col(c) if isinstance(c, str) else c for c in cols]
    return df.select(F.inline(F.array(F.struct(*named))))
