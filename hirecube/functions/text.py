"""Text helpers as Column expressions (no Python runs per row)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# what a Unicode-aware strip removes; Spark's trim() removes plain blanks only
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def _accent_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition has one base letter, and that letter."""
    accented, plain = [], []
    for block in (range(0x80, 0x250), range(0x1E00, 0x1F00)):
        for point in block:
            base = [c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)]
            if len(base) == 1 and base[0] != chr(point):
                accented.append(chr(point))
                plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()
_COMBINING = "".join(chr(p) for p in range(0x300, 0x370))


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def strip_accents(col: Column) -> Column:
    """Base letters for accented ones; combining marks have no counterpart and vanish."""
    return F.translate(col, _ACCENTED + _COMBINING, _PLAIN)


def norm_name(col: Column) -> Column:
    """Header text reduced to ``[a-z0-9_]``."""
    return F.regexp_replace(strip_accents(F.lower(strip(col))), "[^a-z0-9_]+", "")


def clean_code(col: Column, upper: bool = False) -> Column:
    out = strip(col)
    return F.upper(out) if upper else out


def key_text(col: Column, null_key: str = "nan") -> Column:
    """Cube key: trimmed text, with one shared value for every missing key."""
    return F.coalesce(strip(col.cast("string")), F.lit(null_key))


def disability_code(col: Column) -> Column:
    """Codes that went through a float column come back as ``1.0``; drop the tail."""
    return F.regexp_replace(strip(col.cast("string")), r"^(\d+)\.0+$", "$1")


def upper_category(col: Column, fill: str = "None") -> Column:
    """Category level as upper-case text; a null becomes the level ``fill`` in upper case."""
    return F.upper(F.coalesce(col.cast("string"), F.lit(fill)))


def natural_order(col: Column) -> list[Column]:
    """Sort keys that put 2 before 10: length first, then text."""
    return [F.length(col), col]


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip(col) == "")
