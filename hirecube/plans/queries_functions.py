"""Scalar functions and filters, driven by texts that the tables yield; results are folded to small groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions import dims, months, numbers, text
from hirecube.operators import filters
from hirecube.operators.cube import with_disability
from hirecube.plans import bindings as b
from hirecube.plans.catalog import register

D = vocab.DISABILITY


def _price_texts(spark, sf):
    """Prices written the way source files write them, with some dirt."""
    line = b.table(spark, sf, "lineitem")
    euro = F.translate(F.format_number("l_extendedprice", 2), ",.", ".,")
    kind = F.col("l_linenumber") % 7
    dirty = (
        F.when(kind == 0, F.concat(euro, F.lit("d")))
        .when(kind == 1, F.concat(F.lit("  "), euro, F.lit(" ")))
        .when(kind == 2, F.replace(euro, F.lit("."), F.lit("")))
        .when(kind == 3, F.concat(F.lit("R$"), euro))
        .when(kind == 4, F.concat(F.lit("-"), euro))
        .when(kind == 5, F.lit(None).cast("string"))
        .otherwise(euro)
    )
    return line.select(kind.alias("forma"), dirty.alias("txt"))


PRICE_SQL = """WITH e AS (
  SELECT l_linenumber % 7 AS forma, translate(format('{:,.2f}', l_extendedprice), ',.', '.,') AS euro FROM lineitem
),
t AS (
  SELECT forma, CASE forma WHEN 0 THEN euro || 'd' WHEN 1 THEN '  ' || euro || ' ' WHEN 2 THEN replace(euro, '.', '')
    WHEN 3 THEN 'R$' || euro WHEN 4 THEN '-' || euro WHEN 5 THEN NULL ELSE euro END AS txt FROM e
)"""


@register("parse_decimal_comma", PRICE_SQL + """
SELECT forma, CAST(count(*) AS BIGINT) AS linhas, CAST(count(v) AS BIGINT) AS lidas, round(sum(v), 2) AS soma
FROM (SELECT forma, TRY_CAST(trim(replace(replace(txt, '.', ''), ',', '.')) AS DOUBLE) AS v FROM t) GROUP BY forma
""")
def _parse_decimal(spark, sf):
    parsed = _price_texts(spark, sf).select("forma", numbers.parse_decimal_comma(F.col("txt")).alias("v"))
    return parsed.groupBy("forma").agg(
        F.count(F.lit(1)).alias("linhas"), F.count("v").alias("lidas"), numbers.total("v", 2).alias("soma")
    )


@register("to_number_or_null", """
WITH t AS (
  SELECT l_linenumber AS forma, CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)
    WHEN 2 THEN ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.0 ' WHEN 3 THEN 'x'
    WHEN 4 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.5'
    WHEN 5 THEN '' ELSE '+' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS txt FROM lineitem
), n AS (SELECT forma, TRY_CAST(trim(txt) AS DOUBLE) AS v FROM t)
SELECT forma, CAST(count(v) AS BIGINT) AS numeros, round(sum(v), 2) AS soma,
  CAST(count(*) FILTER (v = floor(v)) AS BIGINT) AS inteiros,
  CAST(sum(CAST(v AS INTEGER)) FILTER (v = floor(v)) AS BIGINT) AS soma_inteiros
FROM n GROUP BY forma
""")
def _to_number(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber")
    txt = (
        F.when(kind == 1, q)
        .when(kind == 2, F.concat(F.lit(" "), q, F.lit(".0 ")))
        .when(kind == 3, F.lit("x"))
        .when(kind == 4, F.concat(q, F.lit(".5")))
        .when(kind == 5, F.lit(""))
        .otherwise(F.concat(F.lit("+"), q))
    )
    rows = b.table(spark, sf, "lineitem").select(
        kind.alias("forma"), numbers.to_number_or_null(txt).alias("v"), numbers.to_integer_or_null(txt).alias("i")
    )
    return rows.groupBy("forma").agg(
        F.count("v").alias("numeros"), numbers.total("v", 2).alias("soma"),
        F.count("i").alias("inteiros"), F.sum("i").alias("soma_inteiros"),
    )


@register("norm_name", """
SELECT regexp_replace(strip_accents(lower(trim(x))), '[^a-z0-9_]+', '', 'g') AS nome, CAST(count(*) AS BIGINT) AS n
FROM (
  SELECT CASE c_nationkey % 4 WHEN 0 THEN ' Município-' WHEN 1 THEN 'SALÁRIO / ' WHEN 2 THEN 'Tipo_Movimentação '
    ELSE 'Raça/Cor º' END || c_mktsegment AS x FROM customer
) GROUP BY nome
""".replace("º", "ñ"))
def _norm_name(spark, sf):
    kind = F.col("c_nationkey") % 4
    head = (
        F.when(kind == 0, " Município-").when(kind == 1, "SALÁRIO / ").when(kind == 2, "Tipo_Movimentação ")
        .otherwise("Raça/Cor ñ")
    )
    rows = b.table(spark, sf, "customer").select(text.norm_name(F.concat(head, "c_mktsegment")).alias("nome"))
    return rows.groupBy("nome").agg(F.count(F.lit(1)).alias("n"))


def _competence_texts(spark, sf):
    kind = F.col("l_linenumber") % 6
    d = F.col("l_shipdate")
    txt = (
        F.when(kind == 0, F.date_format(d, "yyyy/MM"))
        .when(kind == 1, F.concat(F.lit(" "), F.date_format(d, "yyyyMM")))
        .when(kind == 2, F.date_format(d, "yyyyMMdd"))
        .when(kind == 3, F.date_format(d, "yyMM"))
        .when(kind == 4, F.concat(F.date_format(d, "yyyy"), F.lit("13")))
        .otherwise(F.lit(None).cast("string"))
    )
    return b.table(spark, sf, "lineitem").select(kind.alias("forma"), txt.alias("txt"))


@register("norm_competence_and_month_of", """
WITH t AS (
  SELECT l_linenumber % 6 AS forma, CASE l_linenumber % 6 WHEN 0 THEN strftime(l_shipdate, '%Y/%m')
    WHEN 1 THEN ' ' || strftime(l_shipdate, '%Y%m') WHEN 2 THEN strftime(l_shipdate, '%Y%m%d')
    WHEN 3 THEN strftime(l_shipdate, '%y%m') WHEN 4 THEN strftime(l_shipdate, '%Y') || '13' END AS txt FROM lineitem
), c AS (SELECT forma, regexp_replace(trim(coalesce(txt, '')), '[^0-9]', '', 'g') AS d FROM t),
p AS (SELECT forma, CASE WHEN length(d) < 6 THEN lpad(d, 6, '0') ELSE d END AS competencia FROM c)
SELECT forma, competencia, CASE WHEN length(competencia) = 6 AND substr(competencia, 5, 2) BETWEEN '01' AND '12'
    AND substr(competencia, 1, 4) BETWEEN '1678' AND '2261'
    THEN substr(competencia, 1, 4) || '-' || substr(competencia, 5, 2) END AS mes, CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY ALL
""")
def _competence(spark, sf):
    rows = _competence_texts(spark, sf).select(
        "forma", months.norm_competence(F.col("txt")).alias("competencia")
    )
    return rows.groupBy("forma", "competencia").agg(F.count(F.lit(1)).alias("n")).select(
        "forma", "competencia", months.month_of(F.col("competencia")).alias("mes"), "n"
    )


@register("clean_code_and_null_key", """
SELECT coalesce(upper(trim(CASE o_orderstatus WHEN 'P' THEN NULL ELSE ' ' || lower(o_orderstatus) || ' ' END)), 'nan')
  AS codigo, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY codigo
""")
def _clean_code(spark, sf):
    raw = F.when(F.col("o_orderstatus") != "P", F.concat(F.lit(" "), F.lower("o_orderstatus"), F.lit(" ")))
    rows = b.table(spark, sf, "orders").select(text.key_text(text.clean_code(raw, upper=True)).alias("codigo"))
    return rows.groupBy("codigo").agg(F.count(F.lit(1)).alias("n"))


@register("with_disability", b.with_sql(f"""
SELECT "{D}", CAST(count(*) AS BIGINT) AS n FROM movements GROUP BY ALL
UNION ALL SELECT 'ausente ' || '9', CAST(count(*) AS BIGINT) FROM movements
"""))
def _with_disability(spark, sf):
    rows = b.movements(spark, sf)
    floaty = rows.withColumn("Deficiencia", F.concat(F.col(D), F.lit(".0"))).drop(D)
    found = with_disability(floaty).groupBy(D).agg(F.count(F.lit(1)).alias("n"))
    absent = with_disability(rows.drop(D)).groupBy(F.concat(F.lit("ausente "), F.col(D)).alias(D)).agg(
        F.count(F.lit(1)).alias("n")
    )
    return found.unionByName(absent)


@register("with_region", b.with_sql("""
SELECT substr(municipio, 1, 2) AS prefixo, CASE substr(municipio, 1, 2) %s ELSE 'NA' END AS uf,
  CASE substr(municipio, 1, 2) %s ELSE 'NA' END AS regiao, CAST(count(*) AS BIGINT) AS n
FROM movements GROUP BY ALL
""" % (
    " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in vocab.STATES.items()),
    " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in vocab.STATES.items()),
)))
def _with_region(spark, sf):
    return dims.with_region(b.movements(spark, sf)).groupBy(
        F.substring("municipio", 1, 2).alias("prefixo"), "uf", "regiao"
    ).agg(F.count(F.lit(1)).alias("n"))


@register("labels_with_unknowns", """
WITH p AS (SELECT CAST(mod(p_size, 14) AS VARCHAR) AS codigo FROM part)
SELECT codigo, CASE codigo %s ELSE 'Código ' || codigo END AS escolaridade, CASE codigo %s ELSE 'Outro' END AS raca,
  CASE codigo %s ELSE 'NA' END AS genero,
  CASE WHEN codigo IN ('1', '2', '3', '4', '5', '6', '9') THEN codigo ELSE '9' END AS raca_modelo,
  upper(coalesce(nullif(codigo, '0'), 'None')) AS nivel, CAST(count(*) AS BIGINT) AS n,
  CAST(length(codigo) AS INTEGER) AS ordem
FROM p GROUP BY codigo ORDER BY length(codigo), codigo
""" % tuple(
    " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LABELS[dim][kind].items())
    for dim, kind in (("grau_instrucao", "chart"), ("raca_cor", "history"), ("genero", "model"))
))
def _labels(spark, sf):
    code = F.col("codigo")
    counts = b.table(spark, sf, "part").groupBy((F.col("p_size") % 14).cast("string").alias("codigo")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.select(
        "codigo",
        dims.label(code, "grau_instrucao", "chart", "Código {}").alias("escolaridade"),
        dims.label(code, "raca_cor", "history", "Outro").alias("raca"),
        dims.gender_name(code).alias("genero"),
        dims.bucket_unknown(code, vocab.VALID_RACES).alias("raca_modelo"),
        text.upper_category(F.nullif(code, F.lit("0"))).alias("nivel"),
        "n",
        text.natural_order(code)[0].alias("ordem"),
    ).orderBy(*text.natural_order(code))


@register("safe_ratio_log_and_rounding", """
SELECT c_mktsegment, round(sum(c_acctbal), 2) / nullif(count(*) FILTER (c_nationkey = 99), 0) AS vazio,
  round(ln(round(sum(c_acctbal) FILTER (c_acctbal > 0), 2)), 9) AS logaritmo,
  round_even(CAST(count(*) AS DOUBLE) / 8, 2) AS oitavos, round_even(round(sum(c_acctbal), 2) / count(*), 2) AS media
FROM customer GROUP BY c_mktsegment
""")
def _ratio(spark, sf):
    rows = b.table(spark, sf, "customer")
    n = F.count(F.lit(1))
    return rows.groupBy("c_mktsegment").agg(
        numbers.safe_ratio(numbers.total("c_acctbal", 2), F.count(F.when(F.col("c_nationkey") == 99, 1))).alias("vazio"),
        F.round(numbers.log_target(numbers.total(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")), 2)), 9)
        .alias("logaritmo"),
        numbers.report_round(n / 8, 2).alias("oitavos"),
        numbers.report_round(numbers.safe_ratio(numbers.total("c_acctbal", 2), n), 2).alias("media"),
    )


@register("month_dates", """
SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS data, CAST(date_trunc('month', l_shipdate) AS DATE) AS primeiro,
  CAST(date_trunc('month', l_shipdate) + INTERVAL 60 MONTH AS DATE) AS apos_60,
  CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS indice
FROM lineitem
""")
def _month_dates(spark, sf):
    t = F.col("indice")
    rows = b.table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy-MM").alias("data")).distinct()
    return rows.select(
        months.month_text(months.month_index(F.col("data"))).alias("data"),
        months.first_of_month(F.col("data")).alias("primeiro"),
        months.month_index(F.col("data")).alias("indice"),
    ).select("data", "primeiro", months.month_date(t + 60).alias("apos_60"), "indice")


# --- filters -----------------------------------------------------------------------


@register("only_admissions", b.with_sql(f"""
SELECT tipo_movimentacao, "{vocab.BALANCE}", CAST(count(*) AS BIGINT) AS n FROM movements
WHERE TRY_CAST(tipo_movimentacao AS DOUBLE) IN (10, 20, 25)
  OR strip_accents(lower(tipo_movimentacao)) LIKE '%admi%' OR TRY_CAST("{vocab.BALANCE}" AS DOUBLE) = 1
GROUP BY ALL
"""))
def _only_admissions(spark, sf):
    return filters.only_admissions(b.movements(spark, sf)).groupBy("tipo_movimentacao", vocab.BALANCE).agg(
        F.count(F.lit(1)).alias("n")
    )


@register("quality_bounds", b.with_sql("""
SELECT idade, CAST(count(*) AS BIGINT) AS n, max(salario) AS maior FROM movements
WHERE idade BETWEEN 14 AND 80 AND salario > 0 AND salario < 100000 GROUP BY idade
"""))
def _quality_bounds(spark, sf):
    rows = filters.quality_bounds(b.movements(spark, sf), max_salary=b.MAX_SALARY)
    return rows.groupBy("idade").agg(F.count(F.lit(1)).alias("n"), F.max("salario").alias("maior"))


@register("require_fields", b.with_sql("""
SELECT genero, CAST(count(*) AS BIGINT) AS n FROM movements
WHERE nullif(idade, 14) IS NOT NULL AND nullif(genero, '9') IS NOT NULL GROUP BY genero
"""))
def _require(spark, sf):
    rows = b.movements(spark, sf).select(
        F.nullif("idade", F.lit(14)).alias("idade"), F.nullif("genero", F.lit("9")).alias("genero")
    )
    return filters.require(rows, ["idade", "genero"]).groupBy("genero").agg(F.count(F.lit(1)).alias("n"))


@register("month_and_year_filters", b.with_sql("""
SELECT data, CAST(count(*) AS BIGINT) AS n FROM cube_rows
WHERE data >= '1998-03' AND data <= '1999-02' AND data LIKE '1998-%' AND grau_instrucao NOT IN ('1', '5') GROUP BY data
"""))
def _month_filters(spark, sf):
    rows = filters.year_filter(filters.month_range(b.rows(spark, sf), "1998-03", "1999-02"), 1998)
    return filters.exclude_codes(rows, "grau_instrucao", ("1", "5")).groupBy("data").agg(F.count(F.lit(1)).alias("n"))


_SCENARIOS = {
    "geral": ("brasil", "true"),
    "municipio": ("130000", "municipio = '130000'"),
    "regiao": ("SUL", "substr(municipio, 1, 2) IN ('41', '42', '43')"),
    "cnae": ("4", "cnae20subclasse LIKE '4%'"),
}


@register("scenario_filters", b.with_sql(" UNION ALL ".join(
    f"SELECT '{kind}' AS filtro_tipo, '{value}' AS filtro_valor, CAST(count(*) AS BIGINT) AS n, "
    f"round(sum(soma_salario), 2) AS soma FROM cube_rows WHERE {sql}"
    for kind, (value, sql) in _SCENARIOS.items()
)))
def _scenarios(spark, sf):
    """All scenarios in one scan: each row is counted under every scenario it belongs to."""
    rows = b.rows(spark, sf)
    members = F.filter(
        F.array(*[
            F.when(
                filters.scenario_condition(kind, value),
                F.struct(F.lit(kind).alias("filtro_tipo"), F.lit(value).alias("filtro_valor")),
            ) for kind, (value, _) in _SCENARIOS.items()
        ]),
        lambda x: x.isNotNull(),
    )
    each = rows.select("soma_salario", F.explode_outer(members).alias("s")).where("s is not null")
    return each.groupBy("s.filtro_tipo", "s.filtro_valor").agg(
        F.count(F.lit(1)).alias("n"), numbers.total("soma_salario", 2).alias("soma")
    )


@register("known_groups_and_positive_weight", b.with_sql("""
SELECT raca_cor, CAST(sum(total_admissoes) AS BIGINT) AS n FROM cube_rows
WHERE total_admissoes > 0 AND soma_salario > 0 AND raca_cor IN ('1', '2', '3') GROUP BY raca_cor
"""))
def _known_groups(spark, sf):
    rows = filters.positive_weight(b.rows(spark, sf), salary_too=True)
    return filters.known_groups(rows, "raca_cor", ["1", "2", "3"]).groupBy("raca_cor").agg(
        F.sum("total_admissoes").alias("n")
    )
