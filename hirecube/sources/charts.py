"""Chart payloads as one JSON document per chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube.functions.numbers import finite_or_null


def chart_payload(
    series: DataFrame,
    title: str,
    subtitle: str,
    y_title: str,
    colours: dict[str, str] | None = None,
    dim: str | None = None,
    series_type: str | None = None,
    chart: dict | None = None,
    palette: list[str] | None = None,
) -> DataFrame:
    """One row with the payload of ordered series (see ``reshape.series_arrays``).

    ``series`` has one row per category: ``ordem``, ``nome``, ``meses``, ``valores``.
    The result is as long as a chart. Values that JSON cannot say become null.
    """
    whole = series.schema["valores"].dataType.elementType.typeName() in ("integer", "long")
    value = F.col("valores") if whole else F.transform("valores", finite_or_null)
    fields: list[Column] = []
    if series_type:
        fields.append(F.lit(series_type).alias("type"))
    fields += [F.col("nome").alias("name"), value.alias("data")]
    if colours:
        pairs = [F.lit(x) for pair in colours.items() for x in pair]
        fields.append(F.try_element_at(F.create_map(*pairs), F.col(dim)).alias("color"))
    elif palette:
        picks = F.array(*[F.lit(p) for p in palette])
        fields.append(F.get(picks, F.pmod(F.col("ordem"), F.lit(len(palette)))).alias("color"))
    one = series.agg(
        F.sort_array(F.collect_list(F.struct(F.col("ordem"), F.struct(*fields).alias("s")))).alias("lines"),
        F.max("meses").alias("categories"),
    )
    body = [
        F.lit(title).alias("title"),
        F.lit(subtitle).alias("subtitle"),
        F.lit(y_title).alias("yAxisTitle"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
        F.transform("lines", lambda x: x["s"]).alias("series"),
    ]
    if chart:
        body.append(F.struct(*[F.lit(v).alias(k) for k, v in chart.items()]).alias("chart"))
    return one.select(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).alias("payload"))


def write_payload(payload: DataFrame, path: str) -> None:
    payload.select(F.col("payload").alias("value")).coalesce(1).write.mode("overwrite").text(path)
