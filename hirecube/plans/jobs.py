"""The three ways in: ingest to a cube, fit the models, serve the dashboard and the charts."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from hirecube import vocab
from hirecube.operators import forecast, history, means, regression, repair, reshape
from hirecube.operators.clean import clean_movements, outcome_of_ingest, to_cube
from hirecube.operators.cube import merge_cube
from hirecube.operators.filters import positive_weight
from hirecube.session import checkpoint
from hirecube.sources import charts, tables
from hirecube.sources.raw import profile_files, raw_lines, split_lines

log = logging.getLogger(__name__)

D = vocab.DISABILITY
SOURCE_NOTE = "Fonte: cubo de admissões"


def ingest(
    spark: SparkSession,
    source: str,
    cube_path: str,
    clean_path: str | None = None,
    months: list[str] | None = None,
    glob: str = "*.txt",
    audit_path: str | None = None,
) -> None:
    """Raw files -> (clean data set ->) cube. With a clean data set the text is parsed once.

    ``audit_path`` gets one row per file, rejected files included, for one more
    pass over the text.
    """
    lines = raw_lines(spark, source, months, glob)
    profile = checkpoint(profile_files(lines))
    raw = split_lines(lines, profile)
    if audit_path is not None:
        outcome_of_ingest(profile, raw).write.mode("overwrite").parquet(audit_path)
    clean = clean_movements(raw)
    if clean_path is None:
        tables.write_cube(to_cube(clean), cube_path)
        return
    tables.write_clean(clean, clean_path)
    tables.write_cube(to_cube(tables.read_clean(spark, clean_path)), cube_path)


def repair_cube(
    table: tables.VersionedTable, plan: dict[str, list[str]], snap: int | None = None, **options
) -> DataFrame:
    """Repair months of a stored cube as one new version; returns their means before and after."""
    before = table.read(schema=tables.CUBE_SCHEMA)
    fixed = repair.repair_months_in_sequence(before, plan, **options)
    months = list(fixed)
    old = means.monthly_mean(before, months, snap).withColumnRenamed("salario_medio", "antes")
    rows = None
    for frame in fixed.values():
        rows = frame if rows is None else rows.unionByName(frame)
    table.replace_months(rows, months)
    new = means.monthly_mean(table.read(schema=tables.CUBE_SCHEMA), months, snap)
    return old.join(new.withColumnRenamed("salario_medio", "depois"), "data")


def fit_models(
    spark: SparkSession,
    cube: DataFrame,
    root: str,
    scenarios=None,
    quality: DataFrame | None = None,
    **forecast_options,
) -> dict[str, str]:
    """Coefficients and projections as versioned tables under ``root``.

    One stage failing is reported and does not keep the other from running.
    """

    def coefficients() -> None:
        table = tables.VersionedTable(spark, f"{root}/coeficientes_regressao")
        table.write(regression.ols(regression.regression_groups(cube)))

    def projections() -> None:
        rows, status = forecast.project_groups(cube, scenarios, quality=quality, with_status=True, **forecast_options)
        table = tables.VersionedTable(spark, f"{root}/projecoes_salariais")
        table.upsert(checkpoint(rows), tables.PROJECTION_KEYS)
        tables.VersionedTable(spark, f"{root}/situacao_projecoes").upsert(checkpoint(status), forecast.SERIES_KEYS)

    outcome = {}
    for name, stage in (("coefficients", coefficients), ("projections", projections)):
        try:
            stage()
            outcome[name] = "ok"
        except Exception as error:
            log.exception("stage %s failed", name)
            outcome[name] = f"failed: {error}"
    return outcome


def dashboard(cube: DataFrame, first: str, last: str, snap: int | None = None) -> dict[str, DataFrame]:
    """History of a range of months, headline numbers and counts per dimension.

    The history is a small fold of the cube; it is cached for its consumers.
    """
    hist = history.history(cube, first, last, snap).cache()
    return {
        "history": hist,
        "kpis": history.kpis(hist, snap),
        "by_gender": history.admissions_by(hist, "genero_nome"),
        "by_race": history.admissions_by(hist, "raca_nome"),
        "by_education": history.admissions_by(hist, "grau_instrucao"),
        "by_disability": history.admissions_by(hist, D),
    }


def write_charts(cube: DataFrame, root: str, snap: int | None = None) -> None:
    """The four chart payloads as JSON text under ``root``.

    All charts are drawn from one fold of the cube to month x profile, so the
    cube is read once.
    """
    cube = checkpoint(merge_cube(cube, keys=["data", *history.PROFILE], snap=snap))
    mean_title, mean_axis = "Salário Médio de Admissão por {}", "R$ (média)"

    def mean_series(dim: str, keep_absent: bool = False) -> DataFrame:
        by_month = means.weighted_mean(positive_weight(cube), ["data", dim], snap=snap)
        return reshape.series_arrays(by_month, dim, list(vocab.LABELS[dim]["chart"]), keep_absent=keep_absent)

    counts = reshape.counts_by_month(cube)
    payloads = {
        "genero": charts.chart_payload(mean_series("genero"), mean_title.format("Gênero"), SOURCE_NOTE, mean_axis),
        "raca": charts.chart_payload(
            mean_series("raca_cor"), mean_title.format("Raça/Cor"), SOURCE_NOTE, mean_axis,
            colours=vocab.RACE_COLOURS, dim="raca_cor",
        ),
        "deficiencia": charts.chart_payload(
            mean_series(D, keep_absent=True), mean_title.format("Tipo de Deficiência"), SOURCE_NOTE, mean_axis,
            series_type="column", palette=vocab.DISABILITY_PALETTE, chart={"seriesType": "column"},
        ),
        "escolaridade": charts.chart_payload(
            reshape.count_series(reshape.month_category_grid(counts)),
            "Admissões por Escolaridade (colunas empilhadas)",
            f"{SOURCE_NOTE} — Excluídos: Não identificado/Não se aplica", "Participação (%)",
            series_type="column", palette=vocab.EDUCATION_PALETTE,
            chart={
                "seriesType": "column", "stacking": "percent", "grouping": False, "tooltipMode": "percent-with-abs",
            },
        ),
    }
    for name, payload in payloads.items():
        charts.write_payload(payload, f"{root}/{name}")
