"""Pivots, month-by-category grids and chart-ready series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.months import month_index, month_text
from hirecube.functions.numbers import report_round, safe_ratio, weighted
from hirecube.operators.filters import exclude_codes, positive_weight
from hirecube.operators.means import weighted_mean
from hirecube.session import checkpoint


def pivot_mean(cube: DataFrame, dim: str, codes: list[str], prefix: str = "", snap: int | None = None) -> DataFrame:
    """One row per month, one column per code. The codes are given, so no job runs to find them."""
    mean = weighted("soma_salario", "total_admissoes", snap)
    wide = positive_weight(cube).groupBy("data").pivot(dim, codes).agg(mean)
    return wide.select("data", *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in codes])


def counts_by_month(
    cube: DataFrame, dim: str = "grau_instrucao", excluded=tuple(vocab.UNIDENTIFIED_EDUCATION)
) -> DataFrame:
    rows = exclude_codes(positive_weight(cube), dim, excluded)
    return rows.groupBy("data", dim).agg(F.sum("total_admissoes").alias("total"))


def month_category_grid(counts: DataFrame, dim: str = "grau_instrucao", value: str = "total") -> DataFrame:
    """Every observed month for every observed category, absent pairs as 0.

    Each category brings its own calendar (a generated sequence), reduced to the
    observed months: the grid grows by generation, not by a product of two tables.
    The counts are checkpointed, as every part of the grid looks at them.
    """
    counts = checkpoint(counts)
    span = counts.agg(F.min(month_index(F.col("data"))).alias("a"), F.max(month_index(F.col("data"))).alias("b"))
    first, last = span.select("a").scalar(), span.select("b").scalar()
    categories = counts.select(dim).distinct()
    calendar = categories.select(dim, F.explode(F.sequence(first, last)).alias("t")).select(
        month_text(F.col("t")).alias("data"), dim
    )
    grid = calendar.join(counts.select("data").distinct(), "data", "left_semi")
    return grid.join(counts, ["data", dim], "left").select(
        "data", dim, F.coalesce(F.col(value), F.lit(0)).cast("bigint").alias(value)
    )


def percent_stack(counts: DataFrame, dim: str = "grau_instrucao", value: str = "total") -> DataFrame:
    """Share of each category in its month.

    The monthly total is joined from a second, tiny aggregate, so a month with
    very many categories is never gathered in one window. Both read the
    checkpointed counts.
    """
    counts = checkpoint(counts)
    months = counts.groupBy("data").agg(F.sum(value).alias("_month"))
    return counts.join(months, "data").select(
        "data", dim, value, (safe_ratio(F.col(value), F.col("_month")) * 100).alias("participacao_pct")
    )


def mean_by_education_stack(cube: DataFrame, snap: int | None = None) -> DataFrame:
    """Mean pay per month and education level, unidentified levels left out."""
    rows = exclude_codes(positive_weight(cube), "grau_instrucao")
    return weighted_mean(rows, ["data", "grau_instrucao"], snap=snap)


def series_arrays(
    means: DataFrame, dim: str, codes: list[str], value: str = "salario_medio", keep_absent: bool = False,
    kind: str = "chart",
) -> DataFrame:
    """Per category the ordered values, aligned to the list of observed months.

    A category without any value is dropped, or kept as all nulls. The arrays
    are as long as the list of months.
    """
    months = means.groupBy("data").agg(*[
        F.max(F.when(F.col(dim) == c, F.struct(F.col(value).alias("v")))).alias(f"c{i}") for i, c in enumerate(codes)
    ])
    # one row per (month, code): the code list is a constant, so this is a projection
    cells = months.select("data", F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("ordem"), F.lit(c).alias(dim),
            F.col(f"c{i}").isNotNull().alias("presente"), F.col(f"c{i}.v").alias("v"),
        ) for i, c in enumerate(codes)
    ])))
    points = F.sort_array(F.collect_list(F.struct(F.col("data"), report_round(F.col("v"), 2).alias("v"))))
    out = cells.groupBy("ordem", dim).agg(
        points.alias("p"), F.bool_or("presente").alias("presente")
    )
    if not keep_absent:
        out = out.where("presente")
    return out.select(
        "ordem", dim,
        dims.label(F.col(dim), dim, kind, "Código {}").alias("nome"),
        F.transform("p", lambda x: x["data"]).alias("meses"),
        F.transform("p", lambda x: x["v"]).alias("valores"),
    )


def count_series(grid: DataFrame, dim: str = "grau_instrucao", value: str = "total", kind: str = "chart") -> DataFrame:
    """Per category the counts in month order; categories in natural order of their codes.

    The position of a category is its rank among the categories, of which there
    are as many as series in one chart.
    """
    folded = grid.groupBy(dim).agg(F.sort_array(F.collect_list(F.struct("data", F.col(value).alias("v")))).alias("p"))
    codes = F.array_sort(F.collect_set(F.struct(F.length(dim).alias("n"), F.col(dim).alias("c"))))
    ranked = folded.agg(codes.alias("codes")).select("codes").scalar()
    place = F.array_position(ranked, F.struct(F.length(dim).alias("n"), F.col(dim).alias("c"))) - 1
    return folded.select(
        place.cast("int").alias("ordem"), dim,
        dims.label(F.col(dim), dim, kind, "Código {}").alias("nome"),
        F.transform("p", lambda x: x["data"]).alias("meses"),
        F.transform("p", lambda x: x["v"]).alias("valores"),
    )
