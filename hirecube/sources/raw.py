"""Raw movement files: ``;``-separated text of mixed encodings, header spellings and row lengths.

Reading takes two passes over the text. The first folds every file to one row
(encoding, header, position of each known column, last line). The second splits
the lines with that row at hand. No line is ever tied to a position that a second
scan would have to reproduce, so file splits may differ between the passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions.text import is_blank, norm_name, strip
from hirecube.operators.filters import any_blank, is_admission
from hirecube.operators.joins import lookup_join
from hirecube.operators.once import select_once
from hirecube.session import checkpoint

COPIES_PER_TASK = 1_000_000
CANONICAL = [*vocab.REQUIRED_COLUMNS, *vocab.OPTIONAL_COLUMNS]

# fixed values: what the bytes 0x80..0x9F mean in cp1252 (five of them mean nothing)
_CP1252_BYTES = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_LATIN1_TEXT = "".join(chr(b) for b in _CP1252_BYTES)
_CP1252_TEXT = bytes(_CP1252_BYTES).decode("cp1252")
_UNDEFINED = "[\\x{81}\\x{8D}\\x{8F}\\x{90}\\x{9D}]"


def month_in_name(file_name: Column, months: list[str]) -> Column:
    """True when the file stem contains one of the months; other entries than digits are ignored."""
    wanted = [m.strip() for m in months if m.strip().isdigit()]
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    out = F.lit(not wanted)
    for month in wanted:
        out = out | stem.contains(month)
    return out


def filter_source_months(lines: DataFrame, months: list[str] | None) -> DataFrame:
    """Keep the files of some months. File-name predicates are applied to the listing, before any read."""
    if not months:
        return lines
    return lines.where(month_in_name(F.col("_metadata.file_name"), months))


def raw_lines(spark: SparkSession, path, months: list[str] | None = None, glob: str = "*.txt") -> DataFrame:
    """Lines with their file; bytes stay as they are in the file."""
    return with_file(filter_source_months(spark.read.option("pathGlobFilter", glob).text(path), months))


def with_file(lines: DataFrame) -> DataFrame:
    return lines.select("value", F.col("_metadata.file_path").alias("arquivo"), "_metadata.file_block_start")


def decoded(value: Column, encoding: Column) -> Column:
    latin1 = F.decode(value.cast("binary"), "ISO-8859-1")
    return (
        F.when(encoding == "utf-8", value)
        .when(encoding == "cp1252", F.translate(latin1, _LATIN1_TEXT, _CP1252_TEXT))
        .otherwise(latin1)
    )


def split_fields(line: Column) -> Column:
    """Cells of a line. Only lines with quotes take the slower, quote-aware way."""
    quoted = F.transform(
        F.split(line, ';(?=(?:[^"]*"[^"]*")*[^"]*$)', -1),
        lambda cell: F.when(
            cell.rlike('^".*"$'),
            F.replace(F.regexp_replace(cell, '^"|"$', ""), F.lit('""'), F.lit('"')),
        ).otherwise(cell),
    )
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ";", -1))


def count_fields(line: Column, sep: str = ";") -> Column:
    plain = F.when(line.contains('"'), F.regexp_replace(line, '"[^"]*"', "")).otherwise(line)
    return F.octet_length(plain) - F.octet_length(F.replace(plain, F.lit(sep), F.lit(""))) + 1


def header_names(header: Column) -> Column:
    """Normalised header cells; repeats of an identical cell become blank."""
    return F.transform(
        header,
        lambda cell, i: F.when(F.array_position(header, cell) == i + 1, norm_name(cell)).otherwise(F.lit("")),
    )


def column_positions(names: str) -> Column:
    """1-based position of each canonical column among normalised names, 0 when absent.

    The canonical name wins over other spellings, which are tried in order. Of
    several cells that normalise alike the last counts; of exact copies the first.
    """

    def position(spelling: str) -> str:
        # last match wins: search the reversed list
        return f"nullif(array_position(reverse({names}), '{spelling}'), 0)"

    def best(canonical: str) -> str:
        found = ", ".join(position(s) for s in vocab.HEADER_SPELLINGS[canonical])
        return f"int(coalesce(size({names}) + 1 - coalesce({found}), 0))"

    return F.expr(f"array({', '.join(best(c) for c in CANONICAL)})")


def profile_files(lines: DataFrame) -> DataFrame:
    """One row per file: encoding, header, column positions, acceptance, last line.

    ``lines`` is scanned once. Lines fold on (file, number of cells) first, so a
    single huge file is folded by all tasks that read parts of it.
    """
    value = F.col("value")
    valid = F.is_valid_utf8(value)
    not_ascii = ~valid | (F.char_length(value) != F.octet_length(value))
    undefined = not_ascii & F.decode(value.cast("binary"), "ISO-8859-1").rlike(_UNDEFINED)
    place = F.struct("file_block_start", F.monotonically_increasing_id().alias("row"))
    marked = lines.where(~is_blank(value)).select(
        "arquivo", value, place.alias("place"), valid.alias("valid"),
        F.coalesce(undefined, F.lit(False)).alias("undefined"), count_fields(value).alias("cells"),
    )
    # collect_set over a boolean holds two values at most; as an object aggregate it
    # keeps the whole step a hash aggregate, where min_by over text alone would sort every line
    by_width = marked.groupBy("arquivo", "cells").agg(
        F.collect_set("valid").alias("valid"),
        F.bool_or("undefined").alias("undefined"),
        F.min(F.struct("place", "value")).alias("first"),
        F.max(F.struct("place", "value")).alias("last"),
        F.count(F.lit(1)).alias("lines"),
    )
    # one small row per file and line width from here on; kept, because it is looked at twice
    by_width = checkpoint(by_width)
    files = by_width.groupBy("arquivo").agg(
        F.min(F.struct("first", "cells")).alias("w"),
        F.bool_and(~F.array_contains("valid", False)).alias("valid"),
        F.bool_or("undefined").alias("undefined"),
        F.sum("lines").alias("lines"),
    )
    # the last line is the last one that is no longer than the header
    fitting = (
        by_width.join(files.select("arquivo", F.col("w.cells").alias("width")), "arquivo")
        .where(F.col("cells") <= F.col("width"))
        .groupBy("arquivo").agg(F.max("last").alias("last"), F.sum("lines").alias("fitting"))
    )
    encoding = F.when(F.col("valid"), "utf-8").when(~F.col("undefined"), "cp1252").otherwise("latin-1")
    files = files.join(fitting, "arquivo").select(
        "arquivo",
        encoding.alias("encoding"),
        F.col("w.first.value").alias("header_line"),
        F.col("w.cells").alias("width"),
        F.col("last.value").alias("last_line"),
        (F.col("fitting") - 1).alias("data_lines"),
        (F.col("lines") - F.col("fitting")).alias("long_lines"),
    )
    header = split_fields(decoded(F.col("header_line"), F.col("encoding")))
    files = select_once(files, *files.columns, F.transform(header, strip).alias("header"))
    files = select_once(files, *files.columns, header_names(F.col("header")).alias("names"))
    markers = F.size(F.array_intersect("names", F.array(*[F.lit(m) for m in vocab.HEADER_MARKERS])))
    files = select_once(
        files, *files.columns, column_positions("names").alias("positions"), markers.alias("markers")
    ).drop("names")
    missing = F.filter(
        F.array(*[F.when(F.get("positions", F.lit(i)) == 0, F.lit(c)) for i, c in enumerate(vocab.REQUIRED_COLUMNS)]),
        lambda c: c.isNotNull(),
    )
    files = files.withColumn("missing", missing)
    files = files.withColumn(
        "accepted", (F.col("markers") >= vocab.MIN_HEADER_MARKERS) & (F.size("missing") == 0)
    )
    named = canonical_columns(files, "last_line", files.columns)
    bad = (F.col("last_line") != F.col("header_line")) & any_blank(list(vocab.REQUIRED_COLUMNS))
    return named.select(*files.columns, bad.alias("bad_trailer"))


def canonical_columns(rows: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """``keep`` and the cells of ``line`` under canonical names; needs ``encoding`` and ``positions``.

    Each step is its own projection, so a line is decoded and split once.
    """
    rows = rows.withColumn("_line", decoded(F.col(line), F.col("encoding")))
    rows = rows.withColumn("_fields", split_fields(F.col("_line")))

    missing = ", ".join(f"'{token}'" for token in vocab.NA_TOKENS)

    def cell(i: int) -> str:
        place = f"get(positions, {i}) - 1"
        text = f"get(_fields, {place})"
        found = f"if({text} IN ({missing}), null, {text})"
        if CANONICAL[i] == vocab.DISABILITY:
            # a file without this column says "not identified" for all its rows
            found = f"if({place} < 0, '{vocab.UNKNOWN_CODE}', {found})"
        return f"{found} AS `{CANONICAL[i]}`"

    return select_once(rows, *keep, *[F.expr(cell(i)) for i in range(len(CANONICAL))])


def drop_trailer(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """Drop the last row of each file where a required cell of it is missing.

    ``rows`` carry their raw line in ``value``. Rows equal to a bad last line all
    leave the main flow; as copies of a line cannot be told apart, all but one of
    them come back. That second look is only planned when some file ends in a bad
    row that the admission and number tests would let through, which is rare.
    """
    main = rows.where(~(F.col("bad_trailer") & (F.col("value") == F.col("last_line"))))
    named = canonical_columns(profile.where("accepted and bad_trailer"), "last_line", ["arquivo"])
    passing = named.where(
        is_admission(F.col("`tipomovimentação`"), F.col(vocab.BALANCE))
        & F.col("idade").isNotNull() & F.col("`salário`").isNotNull() & F.col("`competênciamov`").isNotNull()
    )
    if passing.isEmpty():
        return main
    copies = (
        rows.where(F.col("bad_trailer") & (F.col("value") == F.col("last_line")))
        .groupBy("arquivo").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )
    # very many copies are dealt out in portions to many tasks
    portion = F.col("_portion")
    again = profile.join(copies, "arquivo").withColumn("value", F.col("last_line"))
    again = again.withColumn("_portion", F.explode(F.expr(f"sequence(0L, (n - 2) div {COPIES_PER_TASK})")))
    again = again.repartition("arquivo", "_portion").withColumn("_copy", F.explode(F.sequence(
        F.lit(1).cast("bigint"), F.least(F.lit(COPIES_PER_TASK), F.col("n") - 1 - portion * COPIES_PER_TASK)
    )))
    return main.unionByName(again.select(*main.columns))


def split_lines(lines: DataFrame, profile: DataFrame) -> DataFrame:
    """Lines of accepted files as canonical text columns; ``profile`` must be materialised."""
    wanted = profile.where("accepted").select(
        "arquivo", "encoding", "width", "positions", "header_line", "bad_trailer",
        F.when(F.col("bad_trailer"), F.col("last_line")).alias("last_line"),
    )
    value = F.col("value")
    rows = lookup_join(lines.where(~is_blank(value)).select("arquivo", "value"), wanted, "arquivo", spread_by=["value"])
    # a copy of the header further down is never an admission, so all copies may go
    rows = rows.where((value != F.col("header_line")) & (count_fields(value) <= F.col("width")))
    rows = drop_trailer(rows, profile)
    return canonical_columns(rows, "value", ["arquivo"])


def read_movements(
    spark: SparkSession, path, months: list[str] | None = None, glob: str = "*.txt"
) -> DataFrame:
    """Raw movements under canonical names, all text, plus the file they came from."""
    lines = raw_lines(spark, path, months, glob)
    return split_lines(lines, checkpoint(profile_files(lines)))
