"""Dashboard history: monthly means per profile, headline numbers, counts by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.numbers import safe_ratio, total
from hirecube.operators.filters import month_range, positive_weight

PROFILE = ["genero", "raca_cor", "grau_instrucao", vocab.DISABILITY]


def history(cube: DataFrame, first: str, last: str, snap: int | None = None) -> DataFrame:
    """Sums per month and profile in a range of months, weighted means, decoded labels."""
    sums = (
        month_range(cube, first, last)
        .groupBy("data", *PROFILE)
        .agg(
            F.sum("total_admissoes").alias("total_admissoes"),
            total("soma_salario", snap).alias("soma_salario"),
            total("soma_idade", snap).alias("soma_idade"),
        )
    )
    n = F.col("total_admissoes")
    return (
        positive_weight(sums)
        .withColumn("salario_medio_ponderado", safe_ratio(F.col("soma_salario"), n))
        .withColumn("idade_media_ponderada", safe_ratio(F.col("soma_idade"), n))
        .withColumn("genero_nome", dims.label(F.col("genero"), "genero", "history", "Outro"))
        .withColumn("raca_nome", dims.label(F.col("raca_cor"), "raca_cor", "history", "Outro"))
    )


def kpis(hist: DataFrame, snap: int | None = None) -> DataFrame:
    """Admissions, women's mean as % of men's, overall mean; the ratio is null if a side is absent."""
    def side(name):
        here = F.col("genero_nome") == name
        return safe_ratio(
            total(F.when(here, F.col("soma_salario")), snap),
            F.sum(F.when(here, F.col("total_admissoes"))),
        )

    return hist.agg(
        F.coalesce(F.sum("total_admissoes"), F.lit(0)).cast("bigint").alias("total_admissoes"),
        side("Homem").alias("salario_homens"),
        side("Mulher").alias("salario_mulheres"),
        safe_ratio(total("soma_salario", snap), F.sum("total_admissoes")).alias("salario_medio_geral"),
    ).withColumn("hiato_pct", safe_ratio(F.col("salario_mulheres"), F.col("salario_homens")) * 100)


def admissions_by(hist: DataFrame, dim: str) -> DataFrame:
    return hist.groupBy("data", dim).agg(F.sum("total_admissoes").alias("total_admissoes"))


def admissions_by_all(hist: DataFrame) -> DataFrame:
    """Counts by month and each dashboard dimension, all in one pass (grouping sets)."""
    sets = ["genero_nome", "raca_nome", "grau_instrucao", vocab.DISABILITY]
    month = F.col("data")
    grouped = hist.groupingSets(
        [[month, F.col(s)] for s in sets], month, *[F.col(s) for s in sets]
    ).agg(F.sum("total_admissoes").alias("total_admissoes"), F.grouping_id().alias("gid"))
    # grouping_id has one bit per column of (data, *sets), first column highest
    top = len(sets) - 1
    dimension = F.coalesce(*[
        F.when(F.col("gid") == (2 ** len(sets) - 1 - 2 ** (top - i)), F.lit(s)) for i, s in enumerate(sets)
    ])
    return grouped.select(
        "data",
        dimension.alias("dimensao"),
        F.coalesce(*[F.col(s) for s in sets]).alias("categoria"),
        "total_admissoes",
    )
