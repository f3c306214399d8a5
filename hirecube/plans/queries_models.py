"""Regression, series and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.operators import forecast as fc
from hirecube.operators import regression as reg
from hirecube.operators import series as ts
from hirecube.plans import bindings as b
from hirecube.plans.catalog import register
from hirecube.plans.queries_reports import REGION, case
from hirecube.session import checkpoint

D = vocab.DISABILITY

# --- regression ------------------------------------------------------------------

GROUPS_SQL = f"""groups AS (
  SELECT {case("genero", vocab.LABELS["genero"]["model"], "'NA'")} AS genero_nome, raca_cor,
    substr(cnae20subclasse, 1, 2) AS cnae_divisao, grau_instrucao, "{D}" AS tipo_def, {REGION} AS regiao,
    round(sum(soma_salario), 2) / sum(total_admissoes) AS salario_medio,
    round(sum(soma_idade), 2) / sum(total_admissoes) AS idade_media,
    CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes
  FROM cube_rows WHERE total_admissoes > 0 AND soma_salario > 0 GROUP BY ALL
)"""


def _groups(spark, sf):
    return reg.regression_groups(b.rows(spark, sf), snap=2)


@register("regression_groups", b.with_sql("SELECT * FROM groups", GROUPS_SQL))
def _regression_groups(spark, sf):
    return _groups(spark, sf)


def _one_factor_sql(column: str) -> list[str]:
    """Least squares on one category in closed form: level means against the first level."""
    return [
        f"""obs AS (SELECT {column} AS nivel, ln(salario_medio) AS y FROM groups)""",
        """lv AS (SELECT nivel, count(*) AS n, avg(y) AS m FROM obs GROUP BY nivel)""",
        """s2 AS (SELECT (SELECT sum((y - m) * (y - m)) FROM obs JOIN lv USING (nivel))
  / ((SELECT count(*) FROM obs) - (SELECT count(*) FROM lv)) AS v)""",
        """b0 AS (SELECT * FROM lv ORDER BY nivel LIMIT 1)""",
        f"""coef AS (
  SELECT 'const' AS variavel, m AS b, sqrt(v / n) AS se, CAST(NULL AS VARCHAR) AS base FROM b0, s2
  UNION ALL
  SELECT '{column}_' || lv.nivel, lv.m - b0.m, sqrt(v * (1.0 / lv.n + 1.0 / b0.n)), b0.nivel
  FROM lv, b0, s2 WHERE lv.nivel <> b0.nivel
)""",
    ]


def _one_factor(spark, sf, column):
    return reg.ols(_groups(spark, sf), categories=[column], numbers=[], details=True)


for _column in ("genero_nome", "raca_cor"):
    def _run_factor(spark, sf, column=_column):
        return _one_factor(spark, sf, column).select(
            "variavel", F.round("coeficiente", 8).alias("coeficiente"),
            F.round("erro_padrao", 8).alias("erro_padrao"), F.round("t_valor", 5).alias("t_valor"), "base",
        )

    register(f"ols_one_factor_{_column}", b.with_sql(
        "SELECT variavel, round(b, 8) AS coeficiente, round(se, 8) AS erro_padrao, round(b / se, 5) AS t_valor, base "
        "FROM coef", GROUPS_SQL, *_one_factor_sql(_column)))(_run_factor)


@register("ols_one_number", b.with_sql("""
SELECT 'const' AS variavel, round(regr_intercept(ln(salario_medio), idade_media), 8) AS coeficiente FROM groups
UNION ALL SELECT 'idade_media', round(regr_slope(ln(salario_medio), idade_media), 8) FROM groups
""", GROUPS_SQL))
def _ols_number(spark, sf):
    return reg.ols(_groups(spark, sf), categories=[], numbers=["idade_media"]).select(
        "variavel", F.round("coeficiente", 8).alias("coeficiente")
    )


@register("ols_factor_and_number", b.with_sql("""
SELECT 'const' AS variavel, round(my - slope * mx, 8) AS coeficiente FROM lv, slope WHERE nivel = 'FEM'
UNION ALL
SELECT 'genero_nome_' || l.nivel, round((l.my - slope * l.mx) - (f.my - slope * f.mx), 8)
FROM lv l, lv f, slope WHERE l.nivel <> 'FEM' AND f.nivel = 'FEM'
UNION ALL SELECT 'idade_media', round(slope, 8) FROM slope
""", GROUPS_SQL,
    "obs AS (SELECT genero_nome AS nivel, ln(salario_medio) AS y, idade_media AS x FROM groups)",
    "lv AS (SELECT nivel, avg(y) AS my, avg(x) AS mx FROM obs GROUP BY nivel)",
    """slope AS (SELECT sum((x - mx) * (y - my)) / sum((x - mx) * (x - mx)) AS slope FROM obs JOIN lv USING (nivel))"""))
def _ols_both(spark, sf):
    return reg.ols(_groups(spark, sf), categories=["genero_nome"]).select(
        "variavel", F.round("coeficiente", 8).alias("coeficiente")
    )


@register("ols_all_terms")
def _ols_all(spark, sf):
    return reg.ols(_groups(spark, sf), details=True)


@register("effect_table_race", b.with_sql(
    f"""SELECT codigo, categoria, CASE WHEN codigo = '1' THEN 0.0 ELSE coalesce(round_even(b * 100, 2), 0.0) END AS impacto_pct,
  CASE WHEN codigo = '1' THEN 0.0 ELSE round_even((exp(coalesce(b, 0.0)) - 1) * 100, 2) END AS impacto_exato_pct,
  codigo = '1' AS base
FROM (VALUES {", ".join(f"('{c}', '{n}')" for c, n in vocab.LABELS["raca_cor"]["factor"].items())}) k(codigo, categoria)
LEFT JOIN coef ON variavel = 'raca_cor_' || codigo""", GROUPS_SQL, *_one_factor_sql("raca_cor")))
def _effects(spark, sf):
    coefs = _one_factor(spark, sf, "raca_cor").select(*reg.COEFFICIENT_COLUMNS)
    return reg.effect_table(coefs, "raca_cor").select(
        "codigo", "categoria", "impacto_pct", "impacto_exato_pct", "base"
    )


# --- series ------------------------------------------------------------------------

_DIMS = list(vocab.LABELS)


def _series_sql(where: str = "true", kind: str = "geral", value: str = "'brasil'") -> str:
    parts = []
    for d in _DIMS:
        codes = ", ".join(f"'{c}'" for c in vocab.LABELS[d]["model"])
        parts.append(
            f"SELECT '{kind}' AS filtro_tipo, {value} AS filtro_valor, '{d}' AS grupo_tipo, \"{d}\" AS grupo_codigo, data, "
            "round(sum(soma_salario), 2) AS soma_salario_total, "
            "CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes_total "
            f'FROM cube_rows WHERE total_admissoes > 0 AND soma_salario > 0 AND "{d}" IN ({codes}) AND {where} GROUP BY ALL'
        )
    return " UNION ALL ".join(parts)


COUNTRY_SQL = f"""g AS ({_series_sql()}),
s AS (
  SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, data,
    CAST(CAST(substr(data, 1, 4) AS INTEGER) * 12 + CAST(substr(data, 6, 2) AS INTEGER) - 1 AS INTEGER) AS t,
    soma_salario_total / total_admissoes_total AS media_salario
  FROM g WHERE total_admissoes_total > 0
)"""


def _series(spark, sf):
    return checkpoint(ts.salary_series(ts.group_series(b.rows(spark, sf), snap=2)))


@register("group_series", b.with_sql("SELECT * FROM g", COUNTRY_SQL))
def _group_series(spark, sf):
    return ts.group_series(b.rows(spark, sf), snap=2)


@register("group_series_all_scenarios", b.with_sql(" UNION ALL ".join([
    _series_sql(), _series_sql("municipio = '130000'", "municipio", "'130000'"),
    _series_sql("true", "regiao", REGION), _series_sql("cnae20subclasse LIKE '4%'", "cnae", "'4'"),
])))
def _group_series_scenarios(spark, sf):
    scenarios = [("geral", "brasil"), ("municipio", "130000"), ("regiao", ts.ALL), ("cnae", "4")]
    return ts.group_series(b.rows(spark, sf), scenarios, snap=2)


@register("group_series_every_municipality", b.with_sql(_series_sql("true", "municipio", "municipio")))
def _group_series_municipalities(spark, sf):
    return ts.group_series(b.rows(spark, sf), [("municipio", ts.ALL)], snap=2)


@register("salary_series_with_quality", b.with_sql("""
SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, data, t, media_salario FROM s
LEFT JOIN q ON s.data = q.mes WHERE coalesce(peso_qualidade, 1.0) >= 0.6
""", COUNTRY_SQL, """q AS (
  SELECT data AS mes, (count(*) % 10) / CAST(10 AS DOUBLE) AS peso_qualidade FROM cube_rows
  WHERE data < '2000-01' GROUP BY data
)"""))
def _quality_series(spark, sf):
    weights = (
        b.rows(spark, sf).where(F.col("data") < "2000-01").groupBy(F.col("data").alias("mes"))
        .agg((F.count(F.lit(1)) % 10 / F.lit(10.0)).alias("peso_qualidade"))
    )
    return ts.salary_series(ts.group_series(b.rows(spark, sf), snap=2), weights)


_GAPPY = "t % 5 <> 0 AND NOT (grupo_codigo = '3' AND t > 23980)"


@register("min_history_and_calendar", b.with_sql("""
SELECT c.filtro_tipo, c.filtro_valor, c.grupo_tipo, c.grupo_codigo, c.n_obs, c.t, k.media_salario
FROM (
  SELECT *, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM (
    SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, count(*) AS n_obs, min(t) AS t0, max(t) AS t1
    FROM kept GROUP BY ALL HAVING count(*) >= 40
  )
) c LEFT JOIN kept k ON k.grupo_tipo = c.grupo_tipo AND k.grupo_codigo = c.grupo_codigo AND k.t = c.t
""", COUNTRY_SQL, f"kept AS (SELECT * FROM s WHERE {_GAPPY})"))
def _calendar(spark, sf):
    gappy = _series(spark, sf).where(_GAPPY)
    return ts.calendar_complete(ts.min_history(gappy, 40)).select(
        *ts.SERIES_KEYS, "n_obs", "t", "media_salario"
    )


# --- forecasts ------------------------------------------------------------------------

AR1 = [fc.Order(1, 0, 0, False)]
PERIODS = 60

AR1_SQL = """lagged AS (
  SELECT *, lag(media_salario) OVER (PARTITION BY grupo_tipo, grupo_codigo ORDER BY t) AS x FROM s
),
fit AS (
  SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, count(*) AS n, max(t) AS t1,
    regr_slope(media_salario, x) AS phi, regr_intercept(media_salario, x) AS c,
    regr_syy(media_salario, x) - regr_slope(media_salario, x) * regr_sxy(media_salario, x) AS rss,
    arg_max(media_salario, t) AS ultimo
  FROM lagged WHERE x IS NOT NULL GROUP BY ALL
)"""


def _ar1(spark, sf):
    return fc.fit_seasonal_ar(ts.calendar_complete(ts.min_history(_series(spark, sf))), AR1)


@register("fit_first_order", b.with_sql("""
SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, CAST(n AS INTEGER) AS n_linhas, round(phi, 7) AS phi1,
  round(c, 3) AS constante, round(sqrt(rss / (n - 2)), 4) AS sigma
FROM fit
""", COUNTRY_SQL, AR1_SQL))
def _fit_first(spark, sf):
    phi = F.get("phi", F.lit(0))
    return _ar1(spark, sf).select(
        *ts.SERIES_KEYS, "n_linhas", F.round(phi, 7).alias("phi1"),
        F.round(F.col("centro") * (1 - phi) + F.col("escala") * F.col("c"), 3).alias("constante"),
        F.round(F.col("escala") * F.sqrt("sigma2"), 4).alias("sigma"),
    )


Z95 = "1.959963984540054"
AR1_PATH_SQL = f"""path AS (
  SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, CAST(t1 + j AS INTEGER) AS t,
    c / (1 - phi) + pow(phi, j) * (ultimo - c / (1 - phi)) AS m,
    {Z95} * sqrt(rss / (n - 2) * (1 - pow(phi * phi, j)) / (1 - phi * phi)) AS half
  FROM fit, range(1, {PERIODS + 1}) r(j)
)"""


@register("forecast_first_order", b.with_sql("""
SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, t, round(m, 3) AS salario_projetado,
  round(m - half, 3) AS salario_projetado_low, round(m + half, 3) AS salario_projetado_high FROM path
""", COUNTRY_SQL, AR1_SQL, AR1_PATH_SQL))
def _forecast_first(spark, sf):
    out = fc.forecast(_ar1(spark, sf), PERIODS)
    return out.select(*ts.SERIES_KEYS, "t", *[F.round(c, 3).alias(c) for c in out.columns[5:]])


def _projection_sql(where: str = "true") -> str:
    label = "CASE " + " ".join(
        f"WHEN grupo_tipo = '{d}' AND grupo_codigo = '{c}' THEN '{n}'"
        for d in _DIMS for c, n in vocab.LABELS[d]["model"].items()
    ) + " ELSE 'NA' END"
    date = "make_date(CAST(t // 12 AS INTEGER), CAST(t % 12 + 1 AS INTEGER), 1)"
    return f"""
SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, {label} AS grupo_valor, {date} AS data,
  round(media_salario, 3) AS salario_real, CAST(NULL AS DOUBLE) AS salario_projetado,
  CAST(NULL AS DOUBLE) AS salario_projetado_low, CAST(NULL AS DOUBLE) AS salario_projetado_high FROM s WHERE {where}
UNION ALL
SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, {label}, {date}, NULL, round(m, 3), round(m - half, 3),
  round(m + half, 3) FROM path WHERE {where}
"""


def _projections(spark, sf):
    out = fc.project_groups(b.rows(spark, sf), grid=AR1, periods=PERIODS, snap=2)
    return out.select(*out.columns[:6], *[F.round(c, 3).alias(c) for c in out.columns[6:]])


@register("project_groups_first_order", b.with_sql(_projection_sql(), COUNTRY_SQL, AR1_SQL, AR1_PATH_SQL))
def _project_first(spark, sf):
    return _projections(spark, sf)


@register("projection_lookup", b.with_sql(
    _projection_sql("grupo_tipo = 'grau_instrucao' AND grupo_codigo IN ('1', '5')"), COUNTRY_SQL, AR1_SQL, AR1_PATH_SQL))
def _lookup(spark, sf):
    return fc.projection_lookup(_projections(spark, sf), "geral", "brasil", "grau_instrucao", ["1", "MED COMPL"])


@register("fit_seasonal_ar")
def _fit_all(spark, sf):
    return fc.fit_seasonal_ar(ts.calendar_complete(ts.min_history(_series(spark, sf)))).select(
        *ts.SERIES_KEYS, "n_obs", "p", "d", "q", "sazonal", "n_linhas", F.round("sigma2", 6).alias("sigma2"),
        F.round("aic", 6).alias("aic"),
    )


@register("project_groups")
def _project_all(spark, sf):
    return fc.project_groups(b.rows(spark, sf), snap=2)


@register("projection_status", b.with_sql("""
SELECT filtro_tipo, filtro_valor, grupo_tipo, grupo_codigo, CAST(count(*) AS BIGINT) AS meses,
  CASE WHEN count(*) < 24 THEN 'insufficient_history' ELSE 'ok' END AS status FROM s
WHERE NOT (grupo_codigo = '3' AND t > 23960) GROUP BY ALL
""", COUNTRY_SQL))
def _status(spark, sf):
    """Some series are cut short, so that both outcomes occur."""
    series = _series(spark, sf).where("NOT (grupo_codigo = '3' AND t > 23960)")
    fits = fc.fit_seasonal_ar(ts.calendar_complete(ts.min_history(series)))
    return fc.projection_status(series, fits).select(*ts.SERIES_KEYS, "meses", "status")
