"""Row filters. Predicates on ``data`` keep to plain comparisons so that partition pruning applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.numbers import to_number_or_null
from hirecube.functions.text import clean_code, is_blank, strip_accents


def is_admission(kind: Column, balance: Column | None = None) -> Column:
    """Admission code, or a text naming an admission, or a balance of one."""
    by_code = to_number_or_null(kind).isin([float(c) for c in vocab.ADMISSION_CODES])
    by_text = strip_accents(F.lower(clean_code(kind))).contains(vocab.ADMISSION_STEM)
    tests = [by_code, by_text]
    if balance is not None:
        tests.append(to_number_or_null(balance) == 1.0)
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


def only_admissions(df: DataFrame, kind: str = "tipo_movimentacao", balance: str | None = vocab.BALANCE) -> DataFrame:
    has_balance = balance is not None and balance in df.columns
    return df.where(is_admission(F.col(kind), F.col(balance) if has_balance else None))


def any_blank(cols: list[str]) -> Column:
    """True when any of the columns is null or blank."""
    out = F.lit(False)
    for name in cols:
        out = out | is_blank(F.col(f"`{name}`"))
    return out


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def bounded(
    min_age: int = vocab.MIN_AGE,
    max_age: int = vocab.MAX_AGE,
    min_salary: float = vocab.MIN_SALARY,
    max_salary: float = vocab.MAX_SALARY,
) -> Column:
    return (
        F.col("idade").between(min_age, max_age)
        & (F.col("salario") > min_salary)
        & (F.col("salario") < max_salary)
    )


def quality_bounds(df: DataFrame, *bounds, **named) -> DataFrame:
    """Ages from min to max, both included; salaries strictly between the limits (``bounded``'s)."""
    return df.where(bounded(*bounds, **named))


def month_range(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.where(F.col("data").between(first, last))


def in_year(year: str | int) -> Column:
    return F.col("data").startswith(f"{year}-")


def year_filter(df: DataFrame, year: str | int | None) -> DataFrame:
    return df if year is None else df.where(in_year(year))


def exclude_codes(df: DataFrame, col: str, codes=tuple(vocab.UNIDENTIFIED_EDUCATION)) -> DataFrame:
    return df.where(~F.col(col).isin(list(codes)))


def positive_weight(df: DataFrame, salary_too: bool = False) -> DataFrame:
    out = df.where(F.col("total_admissoes") > 0)
    return out.where(F.col("soma_salario") > 0) if salary_too else out


def scenario_condition(kind: str, value: str) -> Column:
    """Rows of a scenario: whole country, one municipality, one region, or an activity prefix."""
    if kind == "geral":
        return F.lit(True)
    if kind == "municipio":
        return F.col("municipio") == value
    if kind == "regiao":
        return dims.region(F.col("municipio")) == value
    if kind == "cnae":
        return F.col("cnae20subclasse").startswith(value)
    raise ValueError(f"unknown scenario kind: {kind}")


def scenario_filter(df: DataFrame, kind: str = "geral", value: str = "brasil") -> DataFrame:
    return df if kind == "geral" else df.where(scenario_condition(kind, value))


def known_groups(df: DataFrame, col: str, codes=None) -> DataFrame:
    codes = list(vocab.LABELS[col]["model"]) if codes is None else list(codes)
    return df.where(F.col(col).isin(codes))


def quality_filter(df: DataFrame, minimum: float = vocab.MIN_QUALITY_WEIGHT) -> DataFrame:
    """Months without a stated weight count as fully reliable."""
    return df.where(F.coalesce(F.col("peso_qualidade"), F.lit(1.0)) >= minimum)
