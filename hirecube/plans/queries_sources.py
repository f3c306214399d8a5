"""Round trips through files: raw text, clean data, cube snapshots, streams, charts.

The files hold what Spark derives from the benchmark tables and lie in the shared
folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions.months import month_of
from hirecube.operators import clean as cl
from hirecube.operators import cube as cubes
from hirecube.operators import filters, means, reshape
from hirecube.plans import bindings as b
from hirecube.plans.catalog import register
from hirecube.plans.queries_reports import MEAN, case
from hirecube.session import scratch_path
from hirecube.sources import charts, raw, tables
from hirecube.streaming.ingest import CubeStore, ingest_new_months

D = vocab.DISABILITY


def write_raw(df: DataFrame, path: str, encoding: str = "ISO-8859-1", mode: str = "append") -> None:
    """Movements as source files: ``;``, accented header, decimal comma, one byte per letter."""
    euro = F.translate(F.format_number("salario", 2), ",.", ".,")
    rows = df.select(
        F.col("competencia_mov").alias("competênciamov"),
        F.col("municipio").alias("município"),
        F.col("cnae20subclasse").alias("subclasse"),
        F.col("cbo2002ocupacao").alias("cbo2002ocupação"),
        F.col("grau_instrucao").alias("graudeinstrução"),
        F.col("idade").cast("string").alias("idade"),
        F.col("raca_cor").alias("raça/cor"),
        F.col("genero").alias("sexo"),
        euro.alias("salário"),
        F.col("tipo_movimentacao").alias("tipomovimentação"),
        F.col(vocab.BALANCE).alias(vocab.BALANCE),
        F.col(D).alias(D),
    )
    rows.write.mode(mode).option("sep", ";").option("header", True).option("encoding", encoding).csv(path)


ADMITTED_SQL = f"""admitted AS (
  SELECT * FROM movements WHERE tipo_movimentacao IN ('10', 'Admissão') OR "{vocab.BALANCE}" = '1'
)"""
SUMMARY = """SELECT data, genero, "tipodedeficiência", CAST(sum(total_admissoes) AS BIGINT) AS total_admissoes,
  round(sum(soma_salario), 2) AS soma_salario, round(sum(soma_idade), 2) AS soma_idade FROM cube GROUP BY ALL"""
ADMITTED_CUBE_SQL = """cube AS (
  SELECT data, genero, "tipodedeficiência", count(*) AS total_admissoes, sum(salario) AS soma_salario,
    CAST(sum(idade) AS DOUBLE) AS soma_idade FROM admitted WHERE idade BETWEEN 14 AND 80 AND salario > 0 AND salario < 200000 GROUP BY ALL
)"""


def _summary(cube: DataFrame) -> DataFrame:
    return cubes.merge_cube(cube, keys=["data", "genero", D], snap=2)


def _raw_files(spark: SparkSession, sf: str, encoding: str = "ISO-8859-1") -> str:
    path = scratch_path(spark, "raw")
    write_raw(b.movements(spark, sf), path, encoding)
    return path


@register("read_raw_files_to_cube", b.with_sql(SUMMARY, ADMITTED_SQL, ADMITTED_CUBE_SQL))
def _read_raw(spark, sf):
    path = _raw_files(spark, sf)
    return _summary(cl.to_cube(cl.clean_movements(raw.read_movements(spark, path, glob="*.csv"))))


@register("ingest_audit", b.with_sql(f"""
SELECT CAST(count(*) AS BIGINT) AS linhas, CAST(count(*) FILTER (a) AS BIGINT) AS admissoes,
  CAST(count(*) FILTER (a AND idade BETWEEN 14 AND 80) AS BIGINT) AS no_cubo
FROM (SELECT *, tipo_movimentacao IN ('10', 'Admissão') OR "{vocab.BALANCE}" = '1' AS a FROM movements)
"""))
def _audit(spark, sf):
    rows = raw.read_movements(spark, _raw_files(spark, sf, "UTF-8"), glob="*.csv")
    per_file = cl.ingest_audit(rows)
    return per_file.agg(*[F.sum(c).alias(c) for c in ("linhas", "admissoes", "no_cubo")])


@register("file_profile", b.with_sql("""
SELECT 'cp1252' AS encoding, true AS accepted, CAST(count(*) AS BIGINT) AS data_lines FROM movements
"""))
def _file_profile(spark, sf):
    path = _raw_files(spark, sf)
    profile = cl.file_audit(raw.profile_files(raw.raw_lines(spark, path, glob="*.csv")))
    return profile.groupBy("encoding", "accepted").agg(F.sum("data_lines").alias("data_lines"))


@register("clean_data_round_trip", b.with_sql(
    """SELECT competencia_mov, genero, CAST(count(*) AS BIGINT) AS n, round(sum(salario), 2) AS soma
FROM movements GROUP BY ALL"""))
def _clean_round_trip(spark, sf):
    path = scratch_path(spark, "clean")
    tables.write_clean(b.movements(spark, sf).select(*cl.OUTPUT_NAMES.values()), path)
    rows = tables.read_clean(spark, path)
    return rows.groupBy("competencia_mov", "genero").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("salario"), 2).alias("soma")
    )


@register("cube_round_trip", b.with_sql(SUMMARY, b.cube_sql()))
def _cube_round_trip(spark, sf):
    path = scratch_path(spark, "cube")
    tables.write_cube(b.cube(spark, sf), path)
    return _summary(tables.read_cube(spark, path))


@register("replace_months_in_snapshot", b.with_sql(
    SUMMARY.replace("round(sum(soma_salario), 2)", "round(sum(CASE WHEN data = '1998-08' THEN 2 * soma_salario ELSE soma_salario END), 2)"),
    b.cube_sql()))
def _replace_months(spark, sf):
    table = tables.VersionedTable(spark, scratch_path(spark, "versions"))
    table.write(b.cube(spark, sf), "data")
    fixed = table.read(schema=cubes.CUBE_SCHEMA).where("data = '1998-08'").withColumn(
        "soma_salario", F.col("soma_salario") * 2
    )
    table.replace_months(fixed, ["1998-08"])
    return _summary(table.read(schema=cubes.CUBE_SCHEMA))


@register("restore_before_replace", b.with_sql(SUMMARY, b.cube_sql()))
def _restore(spark, sf):
    """A month replaced by its manifest, then the first version made current again: the cube as first written."""
    table = tables.VersionedTable(spark, scratch_path(spark, "restore"))
    table.write(b.cube(spark, sf), "data")
    fixed = table.read(schema=cubes.CUBE_SCHEMA).where("data = '1998-08'").withColumn("soma_salario", F.col("soma_salario") * 2)
    table.replace_months(fixed, ["1998-08"])
    table.restore(1)
    return _summary(table.read(schema=cubes.CUBE_SCHEMA))


@register("upsert_by_key", b.with_sql("""
SELECT genero, raca_cor, CAST(sum(total_admissoes) AS BIGINT) AS n, 'velho' AS origem FROM cube_rows
WHERE genero <> '3' GROUP BY ALL
UNION ALL
SELECT genero, raca_cor, CAST(sum(total_admissoes) AS BIGINT) * 10, 'novo' FROM cube_rows WHERE genero = '3' GROUP BY ALL
"""))
def _upsert(spark, sf):
    counts = b.rows(spark, sf).groupBy("genero", "raca_cor").agg(F.sum("total_admissoes").alias("n"))
    table = tables.VersionedTable(spark, scratch_path(spark, "upsert"))
    table.write(counts.withColumn("origem", F.lit("velho")))
    new = counts.where("genero = '3'").select("genero", "raca_cor", (F.col("n") * 10).alias("n"), F.lit("novo").alias("origem"))
    table.upsert(new, ["genero", "raca_cor"])
    return table.read()


@register("ingest_stream_of_new_files", b.with_sql(SUMMARY, ADMITTED_SQL, ADMITTED_CUBE_SQL))
def _stream(spark, sf):
    """Two runs over a growing folder; the second takes only what is new."""
    source, store, progress = (scratch_path(spark, n) for n in ("landing", "store", "progress"))
    moves = b.movements(spark, sf)
    write_raw(moves.where("competencia_mov < '199807'"), source)
    ingest_new_months(spark, source, store, progress, glob="*.csv")
    write_raw(moves.where("competencia_mov >= '199807'"), source)
    ingest_new_months(spark, source, store, progress, glob="*.csv")
    kept = CubeStore(spark, store)
    kept.compact()
    return _summary(kept.read())


@register("ingest_with_two_progress_folders", b.with_sql(SUMMARY, ADMITTED_SQL, ADMITTED_CUBE_SQL))
def _two_progress(spark, sf):
    """The second run has a progress folder of its own and a third run goes back to the first: the store's ledger
    takes each file once, so the cube is that of all files."""
    source, store = scratch_path(spark, "landing"), scratch_path(spark, "store")
    moves = b.movements(spark, sf)
    write_raw(moves.where("competencia_mov < '199807'"), source)
    first = scratch_path(spark, "progress")
    ingest_new_months(spark, source, store, first, glob="*.csv")
    write_raw(moves.where("competencia_mov >= '199807'"), source)
    ingest_new_months(spark, source, store, scratch_path(spark, "progress"), glob="*.csv")
    ingest_new_months(spark, source, store, first, glob="*.csv")
    return _summary(CubeStore(spark, store).read())


@register("read_quality_weights", b.with_sql("""
SELECT data AS mes, (count(*) % 10) / CAST(10 AS DOUBLE) AS peso_qualidade FROM cube_rows GROUP BY data
"""))
def _quality(spark, sf):
    path = scratch_path(spark, "quality")
    weights = b.rows(spark, sf).groupBy(F.col("data").alias("mes")).agg(
        (F.count(F.lit(1)) % 10 / F.lit(10.0)).alias("peso_qualidade")
    )
    weights.write.option("sep", ";").option("header", True).csv(path)
    return tables.read_quality(spark, path)


@register("with_month_of_clean_rows", b.with_sql(
    "SELECT data, CAST(count(*) AS BIGINT) AS n FROM movements GROUP BY data"))
def _month_of(spark, sf):
    rows = b.movements(spark, sf).drop("data").withColumn("data", month_of(F.col("competencia_mov")))
    return rows.groupBy("data").agg(F.count(F.lit(1)).alias("n"))


# --- chart payloads -----------------------------------------------------------------


def _series_json(dim: str, codes: dict[str, str], colours: dict[str, str] | None, kind: str | None) -> str:
    """JSON of a chart whose series are monthly means, as SQL."""
    values = ", ".join(f"({i}, '{c}', '{n}', '{(colours or {}).get(c, '')}')" for i, (c, n) in enumerate(codes.items()))
    fields = (f"type: '{kind}', " if kind else "") + "name: nome, data: pts" + (", color: cor" if colours else "")
    return b.with_sql(
        f"""SELECT CAST(to_json({{title: 'T', subtitle: 'S', yAxisTitle: 'R$ (média)',
  categories: (SELECT list(data ORDER BY data) FROM months), series: list({{{fields}}} ORDER BY ordem)}}) AS VARCHAR) AS payload
FROM lines""",
        f"""means AS (SELECT data, "{dim}" AS codigo, {MEAN} AS m FROM cube_rows WHERE total_admissoes > 0 GROUP BY ALL)""",
        "months AS (SELECT DISTINCT data FROM means)",
        f"codes AS (SELECT * FROM (VALUES {values}) v(ordem, codigo, nome, cor))",
        """lines AS (
  SELECT ordem, nome, cor, list(round_even(m, 2) ORDER BY data) AS pts FROM (
    SELECT months.data, codes.*, means.m FROM months CROSS JOIN codes
    LEFT JOIN means ON means.data = months.data AND means.codigo = codes.codigo
  ) GROUP BY ALL
)""",
    )


def _mean_series(spark, sf, dim, keep_absent=False):
    by_month = means.weighted_mean(filters.positive_weight(b.rows(spark, sf)), ["data", dim], snap=2)
    return reshape.series_arrays(by_month, dim, list(vocab.LABELS[dim]["chart"]), keep_absent=keep_absent)


@register("chart_gender", _series_json("genero", vocab.LABELS["genero"]["chart"], None, None))
def _chart_gender(spark, sf):
    return charts.chart_payload(_mean_series(spark, sf, "genero"), "T", "S", "R$ (média)")


@register("chart_race", _series_json("raca_cor", vocab.LABELS["raca_cor"]["chart"], vocab.RACE_COLOURS, None))
def _chart_race(spark, sf):
    return charts.chart_payload(
        _mean_series(spark, sf, "raca_cor"), "T", "S", "R$ (média)", vocab.RACE_COLOURS, "raca_cor"
    )


@register("chart_disability", _series_json(
    D, vocab.LABELS[D]["chart"], dict(zip(vocab.LABELS[D]["chart"], vocab.DISABILITY_PALETTE)), "column"))
def _chart_disability(spark, sf):
    return charts.chart_payload(
        _mean_series(spark, sf, D, keep_absent=True), "T", "S", "R$ (média)", series_type="column",
        palette=vocab.DISABILITY_PALETTE,
    )


@register("chart_education", b.with_sql(
    """SELECT CAST(to_json({title: 'T', subtitle: 'S', yAxisTitle: 'Participação (%)',
  categories: (SELECT list(data ORDER BY data) FROM (SELECT DISTINCT data FROM counts)),
  series: list({type: 'column', name: nome, data: pts, color: cor} ORDER BY grau_instrucao),
  chart: {seriesType: 'column', stacking: 'percent', "grouping": false, tooltipMode: 'percent-with-abs'}}) AS VARCHAR) AS payload
FROM lines""",
    """counts AS (
  SELECT data, grau_instrucao, CAST(sum(total_admissoes) AS BIGINT) AS total FROM cube_rows
  WHERE total_admissoes > 0 AND grau_instrucao NOT IN ('80', '99') GROUP BY ALL
)""",
    f"""lines AS (
  SELECT grau_instrucao, {case("grau_instrucao", vocab.LABELS["grau_instrucao"]["chart"], "NULL")} AS nome,
    {case("grau_instrucao", {str(i + 1): c for i, c in enumerate(vocab.EDUCATION_PALETTE)}, "NULL")} AS cor,
    list(total ORDER BY data) AS pts FROM (
    SELECT m.data, c.grau_instrucao, coalesce(k.total, 0) AS total FROM (SELECT DISTINCT data FROM counts) m
    CROSS JOIN (SELECT DISTINCT grau_instrucao FROM counts) c
    LEFT JOIN counts k ON k.data = m.data AND k.grau_instrucao = c.grau_instrucao
  ) GROUP BY grau_instrucao
)"""))
def _chart_education(spark, sf):
    counts = reshape.counts_by_month(b.rows(spark, sf))
    series = reshape.count_series(reshape.month_category_grid(counts))
    return charts.chart_payload(
        series, "T", "S", "Participação (%)", series_type="column", palette=vocab.EDUCATION_PALETTE,
        chart={"seriesType": "column", "stacking": "percent", "grouping": False, "tooltipMode": "percent-with-abs"},
    )
