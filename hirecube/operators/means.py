"""Weighted means, gaps and shares over the cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.numbers import safe_ratio, total, weighted
from hirecube.operators.filters import exclude_codes, in_year, positive_weight, year_filter
from hirecube.session import checkpoint


def weighted_mean(df: DataFrame, by=(), age_too: bool = False, snap: int | None = None) -> DataFrame:
    """Mean pay (and age) per group from sums and counts."""
    aggs = [weighted("soma_salario", "total_admissoes", snap).alias("salario_medio")]
    if age_too:
        aggs.append(weighted("soma_idade", "total_admissoes", snap).alias("idade_media"))
    return df.groupBy(*by).agg(*aggs)


def overall_mean(df: DataFrame, snap: int | None = None) -> DataFrame:
    return weighted_mean(df, (), snap=snap)


def monthly_mean(df: DataFrame, months=None, snap: int | None = None) -> DataFrame:
    rows = df if months is None else df.where(F.col("data").isin(list(months)))
    return weighted_mean(rows, ["data"], snap=snap)


def _mean_where(condition: Column, snap: int | None) -> Column:
    pay = F.when(condition, F.col("soma_salario"))
    n = F.when(condition, F.col("total_admissoes"))
    return safe_ratio(total(pay, snap), F.sum(n))


def gender_gap(cube: DataFrame, year: str | int | None = None, snap: int | None = None) -> DataFrame:
    """Mean pay of men and women, F/M % and gap %, for a year and for all months, in one scan."""
    rows = positive_weight(cube)
    men, women = F.col("genero") == "1", F.col("genero") == "3"
    populations = {"geral": F.lit(True)}
    if year is not None:
        populations[str(year)] = in_year(year)
    means = [
        _mean_where(sex & cond, snap).alias(f"{name}_{pop}")
        for pop, cond in populations.items()
        for name, sex in (("masc", men), ("fem", women))
    ]
    # one row of sums -> one row per population
    lines = F.array(*[
        F.struct(
            F.lit(pop).alias("periodo"),
            F.col(f"masc_{pop}").alias("masc"),
            F.col(f"fem_{pop}").alias("fem"),
        )
        for pop in populations
    ])
    out = rows.agg(*means).select(F.inline(lines))
    ratio = safe_ratio(F.col("fem"), F.col("masc"))
    return out.withColumn("hiato_pct", ratio * 100).withColumn("gap_pct", (1 - ratio) * 100)


def ratio_to_reference(
    cube: DataFrame,
    dim: str = "raca_cor",
    base: str = "1",
    year: str | int | None = None,
    codes=None,
    snap: int | None = None,
) -> DataFrame:
    """Mean pay of each group against a base group; no rows when the base is missing.

    The codes are known, so all means come out of one global aggregate over one
    scan; the single row of sums is then turned into one row per group.
    """
    codes = list(vocab.LABELS[dim]["chart"]) if codes is None else list(codes)
    wanted = codes if base in codes else [base, *codes]
    rows = year_filter(positive_weight(cube), year)
    means = rows.agg(*[_mean_where(F.col(dim) == c, snap).alias(f"m{i}") for i, c in enumerate(wanted)])
    lines = F.array(*[
        F.struct(F.lit(c).alias(dim), F.col(f"m{wanted.index(c)}").alias("salario_medio")) for c in codes
    ])
    out = means.select(F.col(f"m{wanted.index(base)}").alias("base"), F.inline(lines))
    ratio = safe_ratio(F.col("salario_medio"), F.col("base"))
    return out.where("base is not null and salario_medio is not null").select(
        dim,
        dims.label(F.col(dim), dim, "chart").alias("nome"),
        "salario_medio",
        (ratio * 100).alias("razao_pct"),
        ((1 - ratio) * 100).alias("gap_pct"),
    )


def composition(
    cube: DataFrame,
    year: str | int | None = None,
    dim: str = "grau_instrucao",
    excluded=tuple(vocab.UNIDENTIFIED_EDUCATION),
) -> DataFrame:
    """Admissions per category and their share of the total, largest first.

    The counts are checkpointed: the total looks at them again, not at the cube.
    """
    rows = exclude_codes(year_filter(positive_weight(cube), year), dim, excluded)
    counts = checkpoint(rows.groupBy(dim).agg(F.sum("total_admissoes").alias("total")))
    everything = counts.agg(F.sum("total").alias("n")).select("n").scalar()
    return (
        counts.withColumn("participacao_pct", safe_ratio(F.col("total"), everything) * 100)
        .withColumn("nome", dims.label(F.col(dim), dim, "chart", "Código {}"))
        .orderBy(F.desc("total"), *[F.length(dim), F.col(dim)])
    )


def disability_summary(cube: DataFrame, year: str | int | None = None, snap: int | None = None) -> DataFrame:
    rows = year_filter(positive_weight(cube), year)
    means = weighted_mean(rows, [vocab.DISABILITY], snap=snap)
    return dims.with_label(means, vocab.DISABILITY, "chart", "nome", "Código {}")


def pooled_means(baseline: DataFrame, keys: list[str], snap: int | None = None) -> DataFrame:
    """Pooled mean pay and age per group, and the largest mean of any single baseline row."""
    row_mean = safe_ratio(F.col("soma_salario"), F.col("total_admissoes"))
    return baseline.groupBy(*keys).agg(
        weighted("soma_salario", "total_admissoes", snap).alias("mean_sal_base"),
        weighted("soma_idade", "total_admissoes", snap).alias("mean_idd_base"),
        F.max(row_mean).alias("prior_max_mean_sal"),
    )


def prior_max_mean(baseline: DataFrame, keys: list[str]) -> DataFrame:
    row_mean = safe_ratio(F.col("soma_salario"), F.col("total_admissoes"))
    return baseline.groupBy(*keys).agg(F.max(row_mean).alias("prior_max_mean_sal"))


def data_bounds(cube: DataFrame, fallback=vocab.FALLBACK_BOUNDS) -> DataFrame:
    """First and last month; on a cube partitioned by month only partition values are read."""
    return cube.agg(
        F.coalesce(F.min("data"), F.lit(fallback[0])).alias("min_d"),
        F.coalesce(F.max("data"), F.lit(fallback[1])).alias("max_d"),
    )


def five_number(
    cube: DataFrame,
    year: str | int | None = None,
    by: str = vocab.DISABILITY,
    excluded=(vocab.UNKNOWN_CODE,),
    snap: int | None = None,
) -> DataFrame:
    """Box-plot numbers of the monthly means in a year, per category.

    The percentile sees at most one value per month and category: pay is
    aggregated to monthly means first.
    """
    rows = exclude_codes(year_filter(positive_weight(cube), year), by, excluded)
    monthly = weighted_mean(rows, ["data", by], snap=snap)
    quartiles = F.percentile("salario_medio", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ["minimo", "q1", "mediana", "q3", "maximo"]
    return monthly.groupBy(by).agg(quartiles.alias("q")).select(
        by, *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(names)]
    )
