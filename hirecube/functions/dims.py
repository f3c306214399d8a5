"""Lookups in the fixed vocabularies.

The vocabularies are constants of at most a few dozen entries, so a lookup is a
folded map literal inside the projection: no join, no shuffle, no broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirecube import vocab


def lookup(col: Column, table: dict[str, str]) -> Column:
    """Value of ``table`` for ``col``, null when absent."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), col)


def label(col: Column, dim: str, kind: str, unknown: str | None = None) -> Column:
    """Label of a code. ``unknown`` is the text for other codes; ``{}`` in it stands for the code."""
    found = lookup(col, vocab.LABELS[dim][kind])
    if unknown is None:
        return found
    if "{}" in unknown:
        head, tail = unknown.split("{}", 1)
        return F.coalesce(found, F.concat(F.lit(head), col, F.lit(tail)))
    return F.coalesce(found, F.lit(unknown))


def with_label(df: DataFrame, dim: str, kind: str, out: str, unknown: str | None = None) -> DataFrame:
    return df.withColumn(out, label(F.col(dim), dim, kind, unknown))


def gender_name(col: Column) -> Column:
    return label(col, "genero", "model", "NA")


def region(municipality: Column) -> Column:
    table = {prefix: reg for prefix, (_, reg) in vocab.STATES.items()}
    return F.coalesce(lookup(F.substring(municipality, 1, 2), table), F.lit("NA"))


def state(municipality: Column) -> Column:
    table = {prefix: uf for prefix, (uf, _) in vocab.STATES.items()}
    return F.coalesce(lookup(F.substring(municipality, 1, 2), table), F.lit("NA"))


def with_region(df: DataFrame, municipality: str = "municipio") -> DataFrame:
    col = F.col(municipality)
    return df.withColumn("uf", state(col)).withColumn("regiao", region(col))


def activity_division(col: Column) -> Column:
    return F.substring(col, 1, 2)


def with_cnae_division(df: DataFrame, activity: str = "cnae20subclasse") -> DataFrame:
    return df.withColumn("cnae_divisao", activity_division(F.col(activity)))


def bucket_unknown(col: Column, valid, other: str = vocab.UNKNOWN_CODE) -> Column:
    """Codes outside ``valid`` (nulls too) become ``other``."""
    return F.when(col.isin(list(valid)), col).otherwise(F.lit(other))


def dim_labels(spark: SparkSession) -> DataFrame:
    """The vocabularies as one table: dim, code, the four label kinds, sort order, inclusion."""
    rows = []
    for dim, kinds in vocab.LABELS.items():
        codes = {c for kind, table in kinds.items() if kind != "factor" for c in table}
        if dim == "grau_instrucao":
            codes |= set(vocab.UNIDENTIFIED_EDUCATION)
        for order, code in enumerate(sorted(codes, key=lambda c: (len(c), c))):
            factor_key = kinds["model"].get(code) if dim == "genero" else code
            rows.append((
                dim, code, kinds.get("model", {}).get(code), kinds.get("history", {}).get(code),
                kinds.get("chart", {}).get(code), kinds["factor"].get(factor_key), order,
                not (dim == "grau_instrucao" and code in vocab.UNIDENTIFIED_EDUCATION),
            ))
    schema = (
        "dim string, code string, label_model string, label_hist string, label_chart string, "
        "label_factor string, sort_order int, include_flag boolean"
    )
    return spark.createDataFrame(rows, schema)


def dim_uf(spark: SparkSession) -> DataFrame:
    rows = [(prefix, uf, reg) for prefix, (uf, reg) in vocab.STATES.items()]
    return spark.createDataFrame(rows, "prefix string, uf string, regiao string")
