"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Blocks of ``block_words`` words are the seats: they go to sources, and then to
the shards of each source, by highest quotients. A shard is one seeded part of
a source; its documents stand in seeded order, and the mix takes the first
blocks of that stream, going round again where a shard gives more blocks than
it has. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube.session import checkpoint

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
SEED = 20240229
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``target`` per source (columns ``source``, ``source_size``): shares by weight, none above ``repeats`` times its size.

    Sources in code point order, null last, get the weights in turn. Resharing
    the excess by weight ends at ``min(cap, level * weight)`` for one level. With
    the sources ordered by cap over weight, that level is the largest of what
    each prefix of full sources leaves per weight of the rest.
    """
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    by_ratio = whole.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("target", F.least("cap", F.max("level").over(whole) * F.col("weight")))
        .drop("weight", "cap", "ratio", "level")
    )


def apportion(parties: DataFrame, by: list[Column], order: list[str], weight: str, seats: str, into: str) -> DataFrame:
    """Sainte-Laguë within each group: ``seats`` seats to the highest quotients ``weight / (2a + 1)``, ties by ``order``.

    Rounding at the mean weight per seat gives each party all its quotients above
    one threshold; only the seats that this leaves over, or gives too many,
    are then ranked. A party's part of those is at most its share of
    (left-over seats + parties) and one, so the ranked rows are bounded by a few
    per party.
    """
    group = Window.partitionBy(*by)
    share = F.col(weight) / F.sum(weight).over(group)
    parties = (
        parties.withColumn("_share", F.when(F.sum(weight).over(group) > 0, share).otherwise(0.0))
        .withColumn("_first", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
        .withColumn("_gap", F.when(F.sum(weight).over(group) > 0, F.col(seats) - F.sum("_first").over(group)).otherwise(0))
        .withColumn("_reach", F.ceil(F.col("_share") * (F.abs("_gap") + F.count(F.lit(1)).over(group))).cast("long") + 1)
    )
    up = F.sequence(F.col("_first"), F.col("_first") + F.col("_reach"))
    down = F.sequence(F.col("_first") - 1, F.greatest(F.lit(0), F.col("_first") - F.col("_reach") - 1), F.lit(-1))
    none = F.array().cast("array<bigint>")
    seat = F.when(F.col("_gap") > 0, up).when((F.col("_gap") < 0) & (F.col("_first") > 0), down).otherwise(none)
    names = [c for c in parties.columns if not c.startswith("_")]
    ranked = (
        parties.withColumn("_seat", F.explode_outer(seat))
        .withColumn("_q", F.col(weight) / (2 * F.col("_seat") + 1))
        .withColumn("_up", F.row_number().over(group.orderBy(F.col("_q").desc_nulls_last(), *order)))
        .withColumn("_down", F.row_number().over(group.orderBy(F.col("_q").asc_nulls_last(), *[F.col(c).desc() for c in order])))
    )
    change = F.when(F.col("_q").isNull(), 0).when(F.col("_up") <= F.col("_gap"), 1).when(F.col("_down") <= -F.col("_gap"), -1)
    return (
        ranked.groupBy(*names, "_first").agg(F.coalesce(F.sum(F.coalesce(change, F.lit(0))), F.lit(0)).alias("_more"))
        .select(*names, (F.col("_first") + F.col("_more")).cast("long").alias(into))
    )


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS,
    repeats: int = MAX_REPEATS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    Null sources are a source of their own, the last one; null and empty texts
    have size 0 and nothing is taken from them; null and repeated ids count as
    any other; equal rows are interchangeable. An empty table gives an empty
    result. Other columns are not read.
    """
    sized = checkpoint(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("draw"),
    ))
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    n_shards, n_blocks = max(1, -(-total // shard_words)), (2 * total + block_words) // (2 * block_words)
    shard = F.pmod(F.shiftright("draw", 20), F.lit(n_shards))
    per_shard = checkpoint(sized.groupBy("source", shard.alias("shard")).agg(F.sum("size").alias("shard_size")))
    wanted = targets(per_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, repeats)
    wanted = checkpoint(apportion(
        wanted.withColumn("seats", F.lit(n_blocks)), [F.lit(0)], ["source"], "target", "seats", "blocks").drop("seats"))
    quotas = checkpoint(apportion(
        per_shard.alias("p").join(wanted.alias("w"), F.col("p.source").eqNullSafe(F.col("w.source")))
        .select("p.source", "shard", "shard_size", "source_size", "target", "blocks"),
        [F.col("source")], ["shard"], "shard_size", "blocks", "quota"))
    stream = Window.partitionBy("source", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sized.withColumn("shard", shard)
        .withColumn("begins", F.sum("size").over(stream) - F.col("size"))
    )
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * repeats)
    part = F.col("words") - F.col("rounds") * F.col("shard_size")
    last = F.greatest(F.lit(0), F.least("size", F.col("part") - F.col("begins")))
    q = quotas.withColumn("words", words).withColumn(
        "rounds", F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0)).withColumn("part", part)
    return (
        placed.alias("d").join(q.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.shard") == F.col("q.shard")))
        .select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + last).cast("long").alias("taken"))
    )
