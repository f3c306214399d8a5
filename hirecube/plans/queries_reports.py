"""Report, history and chart queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims
from hirecube.operators import filters, history, means, reshape
from hirecube.plans import bindings as b
from hirecube.plans.catalog import register

D = vocab.DISABILITY
YEAR = 1998
MEAN = "round(sum(soma_salario), 2) / nullif(sum(total_admissoes), 0)"
AGE = "round(sum(soma_idade), 2) / nullif(sum(total_admissoes), 0)"


def mean_where(condition: str) -> str:
    return (
        f"round(sum(soma_salario) FILTER ({condition}), 2) / "
        f"nullif(sum(total_admissoes) FILTER ({condition}), 0)"
    )


def case(col: str, table: dict[str, str], otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {col} {whens} ELSE {otherwise} END"


STATE = case("substr(municipio, 1, 2)", {k: v[0] for k, v in vocab.STATES.items()}, "'NA'")
REGION = case("substr(municipio, 1, 2)", {k: v[1] for k, v in vocab.STATES.items()}, "'NA'")


# --- weighted means and pivots -------------------------------------------------


def _register_pivot(name: str, dim: str, prefix: str, codes: list[str]) -> None:
    cols = ", ".join(f"{mean_where(chr(34) + dim + chr(34) + f' = {c!r}')} AS {prefix}{c}" for c in codes)
    sql = b.with_sql(f"SELECT data, {cols} FROM cube_rows WHERE total_admissoes > 0 GROUP BY data")

    @register(name, sql)
    def run(spark, sf):
        return reshape.pivot_mean(b.rows(spark, sf), dim, codes, prefix, snap=2)


_register_pivot("mean_pay_by_month_gender", "genero", "genero_", ["1", "3"])
_register_pivot("mean_pay_by_month_race", "raca_cor", "raca_", ["1", "2", "3", "4", "5"])
_register_pivot("mean_pay_by_month_disability", D, "def_", ["0", "1", "2", "9"])


@register("weighted_mean_by_month_gender", b.with_sql(f"""
SELECT data, genero, {MEAN} AS salario_medio, {AGE} AS idade_media
FROM cube_rows WHERE total_admissoes > 0 GROUP BY data, genero
"""))
def _weighted_mean(spark, sf):
    return means.weighted_mean(filters.positive_weight(b.rows(spark, sf)), ["data", "genero"], age_too=True, snap=2)


@register("weighted_mean_by_state", b.with_sql(f"""
SELECT {STATE} AS uf, {REGION} AS regiao, {MEAN} AS salario_medio FROM cube_rows GROUP BY ALL
"""))
def _mean_by_state(spark, sf):
    return means.weighted_mean(dims.with_region(b.rows(spark, sf)), ["uf", "regiao"], snap=2)


@register("weighted_mean_by_activity_division", b.with_sql(f"""
SELECT substr(cnae20subclasse, 1, 2) AS cnae_divisao, {MEAN} AS salario_medio, {AGE} AS idade_media
FROM cube_rows GROUP BY ALL
"""))
def _mean_by_division(spark, sf):
    return means.weighted_mean(dims.with_cnae_division(b.rows(spark, sf)), ["cnae_divisao"], age_too=True, snap=2)


@register("overall_mean", b.with_sql(f"SELECT {MEAN} AS salario_medio FROM cube_rows"))
def _overall_mean(spark, sf):
    return means.overall_mean(b.rows(spark, sf), snap=2)


@register("monthly_mean", b.with_sql(f"""
SELECT data, {MEAN} AS salario_medio FROM cube_rows WHERE data IN ('1998-08', '1998-09') GROUP BY data
"""))
def _monthly_mean(spark, sf):
    return means.monthly_mean(b.rows(spark, sf), ["1998-08", "1998-09"], snap=2)


@register("data_bounds", b.with_sql("SELECT min(data) AS min_d, max(data) AS max_d FROM cube_rows"))
def _data_bounds(spark, sf):
    return means.data_bounds(b.rows(spark, sf))


# --- gaps, ratios, shares, distributions ----------------------------------------


@register("gender_gap", b.with_sql(
    "SELECT periodo, masc, fem, fem / masc * 100 AS hiato_pct, (1 - fem / masc) * 100 AS gap_pct FROM gap",
    f"""gap AS (
  SELECT '{YEAR}' AS periodo, {mean_where("genero = '1'")} AS masc, {mean_where("genero = '3'")} AS fem
  FROM cube_rows WHERE data LIKE '{YEAR}-%' AND total_admissoes > 0
  UNION ALL
  SELECT 'geral', {mean_where("genero = '1'")}, {mean_where("genero = '3'")}
  FROM cube_rows WHERE total_admissoes > 0
)"""))
def _gender_gap(spark, sf):
    return means.gender_gap(b.rows(spark, sf), YEAR, snap=2)


def _register_ratio(name: str, year: int | None) -> None:
    where = f"AND data LIKE '{year}-%'" if year else ""
    sql = b.with_sql(
        f"""SELECT raca_cor, {case("raca_cor", vocab.LABELS["raca_cor"]["chart"], "NULL")} AS nome,
  salario_medio, salario_medio / base * 100 AS razao_pct, (1 - salario_medio / base) * 100 AS gap_pct
FROM by_race CROSS JOIN (SELECT salario_medio AS base FROM by_race WHERE raca_cor = '1')""",
        f"""by_race AS (
  SELECT raca_cor, {MEAN} AS salario_medio FROM cube_rows
  WHERE total_admissoes > 0 AND raca_cor IN ('1', '2', '3', '4', '5') {where} GROUP BY raca_cor
)""",
    )

    @register(name, sql)
    def run(spark, sf):
        return means.ratio_to_reference(b.rows(spark, sf), "raca_cor", "1", year, snap=2)


_register_ratio("race_ratio_to_reference", None)
_register_ratio("race_ratio_to_reference_in_year", YEAR)


@register("education_composition", b.with_sql(
    f"""SELECT grau_instrucao, total, total / CAST(sum(total) OVER () AS DOUBLE) * 100 AS participacao_pct,
  {case("grau_instrucao", vocab.LABELS["grau_instrucao"]["chart"], "'Código ' || grau_instrucao")} AS nome
FROM t ORDER BY total DESC""",
    f"""t AS (
  SELECT grau_instrucao, CAST(sum(total_admissoes) AS BIGINT) AS total FROM cube_rows
  WHERE data LIKE '{YEAR}-%' AND grau_instrucao NOT IN ('80', '99') AND total_admissoes > 0 GROUP BY grau_instrucao
)"""))
def _composition(spark, sf):
    return means.composition(b.rows(spark, sf), YEAR)


@register("disability_summary", b.with_sql(f"""
SELECT "{D}", {MEAN} AS salario_medio, {case(f'"{D}"', vocab.LABELS[D]["chart"], f"'Código ' || {chr(34)}{D}{chr(34)}")} AS nome
FROM cube_rows WHERE data LIKE '{YEAR}-%' AND total_admissoes > 0 GROUP BY "{D}"
"""))
def _disability_summary(spark, sf):
    return means.disability_summary(b.rows(spark, sf), YEAR, snap=2)


@register("five_number_by_disability", b.with_sql(
    f"""SELECT "{D}", round(quantile_cont(m, 0.0), 6) AS minimo, round(quantile_cont(m, 0.25), 6) AS q1,
  round(quantile_cont(m, 0.5), 6) AS mediana, round(quantile_cont(m, 0.75), 6) AS q3,
  round(quantile_cont(m, 1.0), 6) AS maximo
FROM monthly GROUP BY "{D}" """,
    f"""monthly AS (
  SELECT data, "{D}", {MEAN} AS m FROM cube_rows
  WHERE data LIKE '{YEAR}-%' AND total_admissoes > 0 AND "{D}" NOT IN ('9') GROUP BY data, "{D}"
)"""))
def _five_number(spark, sf):
    out = means.five_number(b.rows(spark, sf), YEAR, snap=2)
    return out.select(D, *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# --- dashboard history -----------------------------------------------------------

FIRST, LAST = "1997-01", "1999-06"
HISTORY_SQL = f"""hist AS (
  SELECT *, soma_salario / total_admissoes AS salario_medio_ponderado,
    soma_idade / total_admissoes AS idade_media_ponderada,
    {case("genero", vocab.LABELS["genero"]["history"], "'Outro'")} AS genero_nome,
    {case("raca_cor", vocab.LABELS["raca_cor"]["history"], "'Outro'")} AS raca_nome
  FROM (
    SELECT data, genero, raca_cor, grau_instrucao, "{D}",
      CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes,
      round(sum(soma_salario), 2) AS soma_salario, round(sum(soma_idade), 2) AS soma_idade
    FROM cube_rows WHERE data >= '{FIRST}' AND data <= '{LAST}' GROUP BY ALL
  ) WHERE total_admissoes > 0
)"""


def _hist(spark, sf):
    return history.history(b.rows(spark, sf), FIRST, LAST, snap=2)


@register("history", b.with_sql("SELECT * FROM hist", HISTORY_SQL))
def _history(spark, sf):
    return _hist(spark, sf)


@register("kpis", b.with_sql(
    "SELECT *, salario_mulheres / salario_homens * 100 AS hiato_pct FROM k",
    HISTORY_SQL,
    f"""k AS (SELECT CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes,
  {mean_where("genero_nome = 'Homem'")} AS salario_homens, {mean_where("genero_nome = 'Mulher'")} AS salario_mulheres,
  {MEAN} AS salario_medio_geral FROM hist)"""))
def _kpis(spark, sf):
    return history.kpis(_hist(spark, sf), snap=2)


def _register_admissions(name: str, dim: str) -> None:
    sql = b.with_sql(
        f'SELECT data, "{dim}", CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes FROM hist GROUP BY ALL',
        HISTORY_SQL,
    )

    @register(name, sql)
    def run(spark, sf):
        return history.admissions_by(_hist(spark, sf), dim)


_register_admissions("admissions_by_gender", "genero_nome")
_register_admissions("admissions_by_race", "raca_nome")
_register_admissions("admissions_by_education", "grau_instrucao")
_register_admissions("admissions_by_disability", D)


@register("admissions_by_all_dimensions", b.with_sql(
    " UNION ALL ".join(
        f"SELECT data, '{d}' AS dimensao, \"{d}\" AS categoria, "
        "CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes FROM hist GROUP BY ALL"
        for d in ("genero_nome", "raca_nome", "grau_instrucao", D)
    ), HISTORY_SQL))
def _admissions_all(spark, sf):
    return history.admissions_by_all(_hist(spark, sf))


# --- grids, shares, chart series ---------------------------------------------------

COUNTS_SQL = """counts AS (
  SELECT data, grau_instrucao, CAST(sum(total_admissoes) AS BIGINT) AS total FROM cube_rows
  WHERE total_admissoes > 0 AND grau_instrucao NOT IN ('80', '99') GROUP BY ALL
)"""
# by activity, because some activities miss some months
SPARSE_SQL = """counts AS (
  SELECT data, cnae20subclasse, CAST(sum(total_admissoes) AS BIGINT) AS total FROM cube_rows
  WHERE total_admissoes > 0 AND genero = '3' AND grau_instrucao = '1' GROUP BY ALL
)"""


@register("month_category_grid", b.with_sql("""
SELECT m.data, c.cnae20subclasse, coalesce(k.total, 0) AS total
FROM (SELECT DISTINCT data FROM counts) m CROSS JOIN (SELECT DISTINCT cnae20subclasse FROM counts) c
LEFT JOIN counts k ON k.data = m.data AND k.cnae20subclasse = c.cnae20subclasse
""", SPARSE_SQL))
def _grid(spark, sf):
    rows = b.rows(spark, sf).where((F.col("genero") == "3") & (F.col("grau_instrucao") == "1"))
    return reshape.month_category_grid(reshape.counts_by_month(rows, "cnae20subclasse", ()), "cnae20subclasse")


@register("education_percent_stack", b.with_sql("""
SELECT data, grau_instrucao, total,
  total / CAST(sum(total) OVER (PARTITION BY data) AS DOUBLE) * 100 AS participacao_pct FROM counts
""", COUNTS_SQL))
def _percent_stack(spark, sf):
    return reshape.percent_stack(reshape.counts_by_month(b.rows(spark, sf)))


@register("mean_pay_by_education_stack", b.with_sql(f"""
SELECT data, grau_instrucao, {MEAN} AS salario_medio FROM cube_rows
WHERE total_admissoes > 0 AND grau_instrucao NOT IN ('80', '99') GROUP BY ALL
"""))
def _education_stack(spark, sf):
    return reshape.mean_by_education_stack(b.rows(spark, sf), snap=2)


@register("series_arrays_by_disability", b.with_sql(
    """SELECT ordem, codigo AS "tipodedeficiência", nome,
  list(data ORDER BY data) AS meses, list(round_even(m, 2) ORDER BY data) AS valores
FROM (
  SELECT months.data, codes.*, means.m FROM (SELECT DISTINCT data FROM means) months
  CROSS JOIN codes LEFT JOIN means ON means.data = months.data AND means.codigo = codes.codigo
) GROUP BY ALL""",
    f"""means AS (
  SELECT data, "{D}" AS codigo, {MEAN} AS m FROM cube_rows WHERE total_admissoes > 0 GROUP BY ALL
),
codes AS (
  SELECT * FROM (VALUES {", ".join(
        f"({i}, '{c}', '{n}')" for i, (c, n) in enumerate(vocab.LABELS[D]["chart"].items()))}) v(ordem, codigo, nome)
)"""))
def _series_arrays(spark, sf):
    by_month = means.weighted_mean(filters.positive_weight(b.rows(spark, sf)), ["data", D], snap=2)
    return reshape.series_arrays(by_month, D, list(vocab.LABELS[D]["chart"]), keep_absent=True)
