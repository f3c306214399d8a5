"""Monthly pay series per scenario and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.functions.months import month_index
from hirecube.functions.numbers import safe_ratio, total
from hirecube.operators.filters import positive_weight, quality_filter, scenario_condition
from hirecube.operators.joins import join_quality

SERIES_KEYS = ["filtro_tipo", "filtro_valor", "grupo_tipo", "grupo_codigo"]
COUNTRY = [("geral", "brasil")]
PROJECTED_DIMS = list(vocab.LABELS)
ALL = "*"


def _scenario_column(kind: str) -> Column:
    return {
        "municipio": F.col("municipio"),
        "regiao": F.col("regiao"),
        "cnae": dims.activity_division(F.col("cnae20subclasse")),
    }[kind]


def _memberships(scenarios) -> Column:
    """Scenarios of a row, as an array of (kind, value). ``*`` stands for every value of a kind."""

    def member(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("filtro_tipo"), value.alias("filtro_valor"))

    entries = []
    for kind in dict.fromkeys(k for k, _ in scenarios):
        values = [v for k, v in scenarios if k == kind]
        if kind == "geral":
            entries += [member(kind, F.lit(v)) for v in values]
        elif ALL in values:
            entries.append(member(kind, _scenario_column(kind)))
        elif kind == "cnae":  # prefixes may overlap
            entries += [F.when(scenario_condition(kind, v), member(kind, F.lit(v))) for v in values]
        else:
            column = _scenario_column(kind)
            entries.append(F.when(column.isin(values), member(kind, column)))
    return F.filter(F.array(*entries), lambda m: m.isNotNull())


def group_series(cube: DataFrame, scenarios=None, dimensions=None, snap: int | None = None) -> DataFrame:
    """Sums per month for every scenario x dimension x known code.

    Places become the scenarios they belong to before the cube is folded, so the
    fold's keys are month, profile and scenarios, however fine the places are. Only
    that much smaller table is repeated per scenario and dimension.
    """
    scenarios = COUNTRY if scenarios is None else scenarios
    dimensions = PROJECTED_DIMS if dimensions is None else dimensions
    rows = positive_weight(cube, salary_too=True)
    if any(k == "regiao" for k, _ in scenarios):
        rows = rows.withColumn("regiao", dims.region(F.col("municipio")))
    rows = rows.withColumn("_cenarios", _memberships(scenarios))

    def sums(df: DataFrame, by: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(
            total("soma_salario", snap).alias("soma_salario"), F.sum("total_admissoes").alias("total_admissoes")
        )

    profile = sums(rows, ["data", *dimensions, "_cenarios"])
    groups = F.filter(
        F.array(*[
            F.when(
                F.col(d).isin(list(vocab.LABELS[d]["model"])),
                F.struct(F.lit(d).alias("grupo_tipo"), F.col(d).alias("grupo_codigo")),
            ) for d in dimensions
        ]),
        lambda g: g.isNotNull(),
    )
    base = ["data", "soma_salario", "total_admissoes"]
    # the outer form keeps Catalyst from inferring "array not empty" and testing it on every cube row
    spread = profile.select(*base, groups.alias("g"), F.inline_outer("_cenarios"))
    spread = spread.select(*base, "filtro_tipo", "filtro_valor", F.inline_outer("g")).where(
        F.col("filtro_tipo").isNotNull() & F.col("grupo_codigo").isNotNull()
    )
    return sums(spread, [*SERIES_KEYS, "data"]).withColumnsRenamed(
        {"soma_salario": "soma_salario_total", "total_admissoes": "total_admissoes_total"}
    )


def salary_series(groups: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """Mean pay per series and month; months of low quality left out."""
    rows = groups.where(F.col("total_admissoes_total") > 0)
    if quality is not None:
        rows = quality_filter(join_quality(rows, quality))
    mean = safe_ratio(F.col("soma_salario_total"), F.col("total_admissoes_total"))
    return rows.select(*SERIES_KEYS, "data", month_index(F.col("data")).alias("t"), mean.alias("media_salario"))


def min_history(series: DataFrame, months: int = vocab.MIN_HISTORY_MONTHS) -> DataFrame:
    """Only series with enough observed months (a series has one row per month)."""
    size = F.count(F.lit(1)).over(Window.partitionBy(*SERIES_KEYS))
    return series.withColumn("_n", size).where(F.col("_n") >= months).drop("_n")


def calendar_complete(series: DataFrame) -> DataFrame:
    """Every calendar month between first and last, missing months with a null mean.

    Adds ``n_obs``, and ``centro`` and ``escala`` for standardising. A series is
    at most as long as the calendar, so folding it to one map is bounded.
    """
    folded = series.groupBy(*SERIES_KEYS).agg(
        F.map_from_entries(F.collect_list(F.struct("t", "media_salario"))).alias("m"),
        F.count("media_salario").alias("n_obs"),
        F.min("t").alias("t0"),
        F.max("t").alias("t1"),
        F.avg("media_salario").alias("centro"),
        F.stddev_pop("media_salario").alias("sd"),
    )
    return folded.select(
        *SERIES_KEYS, "n_obs", "t1", "centro",
        F.when(F.col("sd") > 1e-9, F.col("sd")).otherwise(1.0).alias("escala"),
        "m", F.explode(F.sequence("t0", "t1")).alias("t"),
    ).select(
        *SERIES_KEYS, "n_obs", "t1", "centro", "escala", "t", F.try_element_at("m", "t").alias("media_salario")
    )
