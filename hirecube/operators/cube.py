"""The additive cube: sums and counts per key, never means."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirecube import vocab
from hirecube.functions.numbers import total
from hirecube.functions.text import disability_code, key_text

CUBE_SCHEMA = (
    ", ".join(f"`{k}` string" for k in vocab.CUBE_KEYS)
    + ", soma_salario double, soma_idade double, total_admissoes bigint"
)


def with_disability(
    df: DataFrame,
    candidates=tuple(vocab.CLEAN_DISABILITY_SPELLINGS),
    default: str = vocab.UNKNOWN_CODE,
) -> DataFrame:
    """The disability column under its canonical name, whatever its spelling; constant when absent."""
    present = {c.strip().lower(): c for c in reversed(df.columns)}
    for name in candidates:
        source = present.get(name.lower())
        if source == vocab.DISABILITY:
            return df.withColumn(source, disability_code(F.col(source)))
        if source is not None:
            return df.withColumn(vocab.DISABILITY, disability_code(F.col(f"`{source}`"))).drop(source)
    return df.withColumn(vocab.DISABILITY, F.lit(default))


def cube_rows(clean: DataFrame, month: str = "data", null_key: str = vocab.NULL_KEY, more: tuple[str, ...] = ()) -> DataFrame:
    """Each clean movement as a cube row of weight one.

    Sums and counts are additive, so a query that only adds gets the same answer
    from these rows as from the grouped cube, without the shuffle on seven keys.
    """
    keys = [
        F.col(month).alias("data") if k == "data" else key_text(F.col(f"`{k}`"), null_key).alias(k)
        for k in vocab.CUBE_KEYS
    ]
    extra = [c for c in clean.columns if c in set(more)]
    return clean.select(
        *keys, *extra,
        F.col("salario").cast("double").alias("soma_salario"),
        F.col("idade").cast("double").alias("soma_idade"),
        F.lit(1).cast("bigint").alias("total_admissoes"),
    )


def merge_cube(*parts: DataFrame, keys: list[str] | None = None, snap: int | None = None) -> DataFrame:
    """Add up cubes key by key (each part may hold a key many times)."""
    keys = vocab.CUBE_KEYS if keys is None else keys
    rows = reduce(DataFrame.unionByName, parts)
    return rows.groupBy(*keys).agg(
        total("soma_salario", snap).alias("soma_salario"),
        total("soma_idade", snap).alias("soma_idade"),
        F.sum("total_admissoes").alias("total_admissoes"),
    )


def build_cube(clean: DataFrame, keys: list[str] | None = None, snap: int | None = None) -> DataFrame:
    """Clean movements folded to one row per key: one shuffle, with map-side partial sums."""
    more = tuple(k for k in keys or () if k not in vocab.CUBE_KEYS)
    return merge_cube(cube_rows(clean, more=more), keys=keys, snap=snap)


def empty_cube(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CUBE_SCHEMA)
