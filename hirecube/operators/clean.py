"""From raw text columns to the clean data set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions.months import month_of, norm_competence
from hirecube.functions.numbers import parse_decimal_comma, to_integer_or_null
from hirecube.functions.text import clean_code, disability_code
from hirecube.operators.cube import build_cube, cube_rows, merge_cube
from hirecube.operators.filters import bounded, is_admission, only_admissions, quality_bounds, require
from hirecube.operators.once import select_once

OUTPUT_NAMES = {**vocab.REQUIRED_COLUMNS, **vocab.OPTIONAL_COLUMNS}


def rename_to_output(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(OUTPUT_NAMES)


def _parsed(raw: DataFrame, only: Column | None = None) -> DataFrame:
    """Numbers parsed, codes trimmed; nothing is dropped yet. Where ``only`` is not true, what would be parsed is null."""
    named = rename_to_output(raw)
    parsed = {
        "salario": parse_decimal_comma(F.col("salario")),
        "idade": to_integer_or_null(F.col("idade")),
        "competencia_mov": norm_competence(F.col("competencia_mov")),
        "genero": clean_code(F.col("genero"), upper=True),
        "raca_cor": clean_code(F.col("raca_cor"), upper=True),
        "grau_instrucao": clean_code(F.col("grau_instrucao"), upper=True),
        "municipio": clean_code(F.col("municipio")),
        "cnae20subclasse": clean_code(F.col("cnae20subclasse")),
        "cbo2002ocupacao": clean_code(F.col("cbo2002ocupacao")),
        vocab.DISABILITY: disability_code(F.col(vocab.DISABILITY)),
    }
    if only is not None:
        parsed = {c: F.when(only, x) for c, x in parsed.items()}
    return select_once(named, *[parsed.get(c, F.col(c)).alias(c) for c in named.columns])


def clean_movements(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Admissions with a readable salary and age; ``keep`` names columns of ``raw`` carried along."""
    admissions = only_admissions(raw, "tipomovimentação")
    return require(_parsed(admissions), ["salario", "idade"]).select(*OUTPUT_NAMES.values(), *keep)


def to_cube(clean: DataFrame, keys: list[str] | None = None, **bounds):
    """Quality bounds, month, cube (by ``keys``, the cube's own by default)."""
    rows = quality_bounds(clean, **bounds).withColumn("data", month_of(F.col("competencia_mov")))
    rows = rows.where(F.col("data").isNotNull())
    code = F.coalesce(F.col(vocab.DISABILITY), F.lit(vocab.NULL_KEY))
    return build_cube(rows.withColumn(vocab.DISABILITY, code), keys)


def ingest_audit(raw: DataFrame) -> DataFrame:
    """Per file: rows read, admissions, unreadable salaries and ages, rows within bounds; one pass."""
    kind, balance = F.col("tipomovimentação"), F.col(vocab.BALANCE)
    rows = _parsed(raw.withColumn("_adm", is_admission(kind, balance)))
    rows = rows.withColumn("data", month_of(F.col("competencia_mov")))
    adm, pay, age = F.col("_adm"), F.col("salario"), F.col("idade")
    readable = adm & pay.isNotNull() & age.isNotNull()
    usable = (
        readable & F.col("data").isNotNull() & age.between(vocab.MIN_AGE, vocab.MAX_AGE)
        & (pay > vocab.MIN_SALARY) & (pay < vocab.MAX_SALARY)
    )
    return rows.groupBy("arquivo").agg(
        F.count(F.lit(1)).alias("linhas"),
        F.count_if(adm).alias("admissoes"),
        F.count_if(adm & pay.isNull()).alias("salario_ilegivel"),
        F.count_if(adm & age.isNull()).alias("idade_ilegivel"),
        F.count_if(readable).alias("limpas"),
        F.count_if(usable).alias("no_cubo"),
    )


#: ``data`` of the cells that hold the rows left out of the cube, and what ``_tipo`` says of the rows of a cell
LEFT_OUT = "fora"
_ADMISSION, _NO_PAY, _NO_AGE, _USABLE, _IN_CUBE = 1, 2, 4, 8, 16


def audited_cube(raw: DataFrame, **bounds) -> DataFrame:
    """The cube by file (``arquivo``), with all that ``ingest_audit`` counts, from one parse of ``raw``.

    A row more of the key, ``_tipo``, tells what became of a movement; those left
    out of the cube are counted per file and ``_tipo`` in cells of the month ``LEFT_OUT``.
    """
    rows = _parsed(raw.withColumn("_adm", is_admission(F.col("tipomovimentação"), F.col(vocab.BALANCE))), F.col("_adm"))
    rows = rows.withColumn("data", month_of(F.col("competencia_mov")))
    adm, pay, age = F.col("_adm"), F.col("salario"), F.col("idade")
    dated = adm & pay.isNotNull() & age.isNotNull() & F.col("data").isNotNull()

    def flag(test: Column, bit: int) -> Column:
        return F.when(test, bit).otherwise(0)

    rows = rows.withColumn("_tipo", (
        flag(adm, _ADMISSION) + flag(adm & pay.isNull(), _NO_PAY) + flag(adm & age.isNull(), _NO_AGE)
        + flag(dated & bounded(), _USABLE) + flag(dated & bounded(**bounds), _IN_CUBE)).cast("int"))
    inside = F.col("_tipo").bitwiseAND(_IN_CUBE) != 0
    code = F.coalesce(F.col(vocab.DISABILITY), F.lit(vocab.NULL_KEY))
    kept = cube_rows(rows.withColumn(vocab.DISABILITY, code), more=("arquivo", "_tipo"))
    months = F.when(inside, F.col("data")).otherwise(LEFT_OUT).alias("data")
    keys = [F.when(inside, F.col(f"`{k}`")).alias(k) for k in vocab.CUBE_KEYS if k != "data"]
    return merge_cube(
        kept.select(months, *keys, "arquivo", "_tipo", *[F.when(inside, F.col(c)).alias(c) for c in ("soma_salario", "soma_idade")], "total_admissoes"),
        keys=[*vocab.CUBE_KEYS, "arquivo", "_tipo"])


def audit_of_cells(cells: DataFrame) -> DataFrame:
    """What ``ingest_audit`` says, from the cells of ``audited_cube``."""
    kind, n = F.col("_tipo"), F.col("total_admissoes")

    def rows(test: Column) -> Column:
        return F.sum(F.when(test, n).otherwise(0))

    adm, bad = kind.bitwiseAND(_ADMISSION) != 0, kind.bitwiseAND(_NO_PAY | _NO_AGE) != 0
    return cells.groupBy("arquivo").agg(
        F.sum(n).alias("linhas"),
        rows(adm).alias("admissoes"),
        rows(kind.bitwiseAND(_NO_PAY) != 0).alias("salario_ilegivel"),
        rows(kind.bitwiseAND(_NO_AGE) != 0).alias("idade_ilegivel"),
        rows(adm & ~bad).alias("limpas"),
        rows(kind.bitwiseAND(_USABLE) != 0).alias("no_cubo"),
    )


def file_audit(profile: DataFrame) -> DataFrame:
    """Per file: whether it was taken, and why not."""
    reason = (
        F.when(F.col("markers") < vocab.MIN_HEADER_MARKERS, "header not recognised")
        .when(F.size("missing") > 0, F.concat(F.lit("missing columns: "), F.array_join("missing", ", ")))
    )
    return profile.select("arquivo", "encoding", "accepted", reason.alias("motivo"), "data_lines", "long_lines")


def outcome_of_ingest(profile: DataFrame, raw: DataFrame) -> DataFrame:
    """Per file: taken or why not, and what became of its rows; rejected files have no counts."""
    return file_audit(profile).join(ingest_audit(raw), "arquivo", "left")
