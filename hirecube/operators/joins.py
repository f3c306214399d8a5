"""Joins of a very large side with a lookup table whose size is only known at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube.session import checkpoint

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 64


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    salts: int = SALTS,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Join ``lookup`` (at most one row per key) to ``facts``.

    The lookup is measured first and broadcast only up to ``max_rows`` rows and
    ``max_bytes`` of text form. Beyond that both sides are shuffled, with each lookup row copied to every
    salt, so that one key holding a large part of the facts is spread over many
    tasks. ``lookup`` should be materialised, as measuring it runs it.
    """
    length = F.octet_length(F.to_json(F.struct(*lookup.columns)))
    size = lookup.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(length), F.lit(0)).alias("bytes")).first()
    if size["rows"] <= max_rows and size["bytes"] <= max_bytes:
        return facts.join(F.broadcast(lookup), key, how)
    cols = [F.col(c) for c in (spread_by or facts.columns)]
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def join_quality(series: DataFrame, quality: DataFrame) -> DataFrame:
    """Monthly quality weights joined to rows keyed by month; months without a weight stay."""
    weights = checkpoint(quality.select(F.col("mes").alias("data"), "peso_qualidade"))
    return lookup_join(series, weights, "data", "left")
