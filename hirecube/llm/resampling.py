"""Target-distribution importance resampling: hashed n-gram weights, then an exact top share by median-of-medians.

Features of a text are its runs of one and two words (``A-Z`` lower-cased; a
word is a run of ``0-9 a-z`` and code points above U+007F), joined by a space,
repeats counted. Each falls in the bucket ``crc32(UTF-8) mod BUCKETS``. A
bucket's gain is the log ratio of its smoothed share in the target (the
benchmark) to its share in the corpus; a document's weight is the floored mean
gain of its features. A Gumbel key from the document's id turns weights into a
draw without replacement: the ``SHARE`` highest scores among documents of at
least ``MIN_WORDS`` words are drawn.

Weights are scored on arrays of bucket ids against the gain table (a fixed
``BUCKETS`` longs, the only thing that goes through the driver). The cutoff
score is found by weighted median of medians: each partition gives the median
and size of its remaining candidates; the median of those medians, weighted by
size, is a pivot with at least a quarter of the candidates on either side, so
one count per round discards a guaranteed fraction until the pivot is the
exact cutoff. Only the winners are sorted, by range, to give ranks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube.session import checkpoint

# Fixed values of the contract.
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ by its complement, which Java matches faster than a negated class
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
SEED = 7
SHARE = 25  # percent of the eligible documents that are drawn
MIN_WORDS = 20
TWO_32 = 4294967296.0

#: Candidates are written anew once they have shrunk to this part of the last copy.
REWRITE_BELOW = 0.5
_SIDES = "n_b long, n_e long, n_w long, bs long, bd long, bt long, ws long, wd long, wt long"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def buckets(w: Column, n_buckets: int = BUCKETS) -> Column:
    """Bucket of every feature: each word, then each pair of neighbouring words joined by a space."""
    def bucket(x: Column) -> Column:
        return (F.crc32(x.cast("binary")) % n_buckets).cast("int")
    pairs = F.slice(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: bucket(F.concat(a, F.lit(" "), b))),
                    1, F.greatest(F.size(w) - 1, F.lit(0)))
    return F.concat(F.transform(w, bucket), pairs)


def _histogram(n_buckets: int):
    """One row per partition: how many features fell in each bucket, by ``bincount`` over the flattened arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_buckets, np.int64)
        for batch in batches:
            flat = batch.column("_b").flatten().to_numpy(zero_copy_only=False)
            counts += np.bincount(flat, minlength=n_buckets)[:n_buckets]
        yield pa.RecordBatch.from_pydict({"counts": [counts]}, schema=pa.schema([("counts", pa.list_(pa.int64()))]))
    return run


def bucket_counts(texts: DataFrame, text: str, n_buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` over all features of all texts: a histogram per partition, then one sum per bucket."""
    # the words are a column of their own: ``buckets`` reads them five times, the regular expression runs once
    w = texts.select(words(F.col(text)).alias("_w"))
    per_part = w.select(buckets(F.col("_w"), n_buckets).alias("_b")).mapInArrow(_histogram(n_buckets), "counts array<bigint>")
    return per_part.select(F.posexplode("counts").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> list[int]:
    """``floor(1000 ln((t+1)(S+B) / ((s+1)(T+B))))`` for every bucket, in doubles; ``B`` is the number of buckets."""
    spark = corpus.sparkSession
    s, t = corpus.withColumnRenamed("n", "s"), target.withColumnRenamed("n", "t")
    table = spark.range(n_buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0)
    whole = Window.partitionBy(F.lit(0))
    total_s, total_t = F.sum("s").over(whole).cast("double"), F.sum("t").over(whole).cast("double")
    ratio = ((F.col("t") + 1).cast("double") * (total_s + n_buckets)) / ((F.col("s") + 1).cast("double") * (total_t + n_buckets))
    rows = table.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    out = [0] * n_buckets
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``, ``h`` the first 8 hex digits of SHA-256 of ``<seed>:<doc_id>``."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / TWO_32)))


def _gain_sums(gain: list[int]):
    """Per row: the number of features and the sum of their gains, one ``take`` and ``reduceat`` per batch."""
    table = np.asarray(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column("_b")
            offsets = b.offsets.to_numpy()
            offsets = offsets - offsets[0]
            flat = b.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(offsets)
            totals = np.zeros(len(sizes), np.int64)
            full = np.flatnonzero(sizes > 0)
            if len(full):
                totals[full] = np.add.reduceat(table[flat], offsets[:-1][full])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tie"), batch.column("n_words"), pa.array(sizes.astype(np.int64)), pa.array(totals)],
                names=["doc_id", "tie", "n_words", "n_features", "total"])
    return run


def scored(docs: DataFrame, gain: list[int], text: str = "text", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, n_words, tie`` per row; the gain of each feature looked up in one array."""
    per = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("tie"), words(F.col(text)).alias("_w"))
    per = per.select("doc_id", "tie", F.size("_w").cast("long").alias("n_words"), buckets(F.col("_w"), len(gain)).alias("_b"))
    per = per.mapInArrow(_gain_sums(gain), "doc_id long, tie long, n_words long, n_features long, total long")
    total, n = F.col("total"), F.col("n_features")
    weight = F.when(n > 0, (total - F.pmod(total, n)) / n).otherwise(F.lit(0)).cast("long")
    return per.select(
        "doc_id", n.alias("n_features"), weight.alias("weight"),
        (weight.cast("double") + gumbel(F.col("doc_id"), seed)).cast("long").alias("score"), "n_words", "tie",
    )


def _better(score: Column, doc_id: Column, tie: Column, pivot: tuple[int, int, int]) -> Column:
    s, d, t = (F.lit(v).cast("long") for v in pivot)
    return (score > s) | ((score == s) & ((doc_id < d) | ((doc_id == d) & (tie < t))))


def _same(score: Column, doc_id: Column, tie: Column, pivot: tuple[int, int, int]) -> Column:
    s, d, t = (F.lit(v).cast("long") for v in pivot)
    return (score == s) & (doc_id == d) & (tie == t)


def _median(keys: np.ndarray) -> tuple[int, int, int] | tuple[None, None, None]:
    """The middle key in draw order (higher score, then smaller id, then smaller tie first)."""
    if not len(keys):
        return None, None, None
    order = np.lexsort((keys[:, 2], keys[:, 1], -keys[:, 0]))
    return tuple(int(v) for v in keys[order[(len(keys) - 1) // 2]])


def _sides(pivot: tuple[int, int, int] | None):
    """Per partition: counts better than, equal to and worse than ``pivot``, and the median key of each outer side."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b[["score", "doc_id", "tie"]].to_numpy(np.int64) for b in batches]
        keys = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        if pivot is None:
            better, same = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        else:
            s, d, t = pivot
            better = (keys[:, 0] > s) | ((keys[:, 0] == s) & ((keys[:, 1] < d) | ((keys[:, 1] == d) & (keys[:, 2] < t))))
            same = (keys[:, 0] == s) & (keys[:, 1] == d) & (keys[:, 2] == t)
        worse = ~better & ~same
        yield pd.DataFrame([[int(better.sum()), int(same.sum()), int(worse.sum()), *_median(keys[better]), *_median(keys[worse])]],
                           columns=["n_b", "n_e", "n_w", "bs", "bd", "bt", "ws", "wd", "wt"])
    return run


def _weighted_median(medians: list[tuple[tuple[int, int, int], int]]) -> tuple[int, int, int]:
    medians = sorted(medians, key=lambda m: (-m[0][0], m[0][1], m[0][2]))
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in medians:
        seen += n
        if seen >= half:
            return key
    return medians[-1][0]


def cutoff(keys: DataFrame, k: int) -> tuple[int, int, int]:
    """The ``k``-th key in draw order among ``keys`` (columns ``score, doc_id, tie``, no nulls; ``1 <= k <= rows``).

    Each round reads the candidates once; the driver holds one summary row per partition.
    """
    kept, size = keys, None
    cands, left, bounds = kept, k, []
    pivot = None
    while True:
        rows = cands.mapInPandas(_sides(pivot), _SIDES).collect()
        n_b, n_e = sum(r["n_b"] for r in rows), sum(r["n_e"] for r in rows)
        if pivot is not None and n_b < left <= n_b + n_e:
            return pivot
        if pivot is not None and n_b >= left:
            side, counts, bounds = [(r["bs"], r["bd"], r["bt"]) for r in rows], [r["n_b"] for r in rows], bounds + [("better", pivot)]
        else:
            left -= n_b + n_e
            side, counts = [(r["ws"], r["wd"], r["wt"]) for r in rows], [r["n_w"] for r in rows]
            if pivot is not None:
                bounds = bounds + [("worse", pivot)]
        remaining = sum(counts)
        pivot = _weighted_median([(m, c) for m, c in zip(side, counts) if c])
        score, doc_id, tie = F.col("score"), F.col("doc_id"), F.col("tie")
        cond = F.lit(True)
        for how, p in bounds:
            cond = cond & (_better(score, doc_id, tie, p) if how == "better" else ~_better(score, doc_id, tie, p) & ~_same(score, doc_id, tie, p))
        cands = kept.where(cond)
        if size is None:
            size = sum(r["n_b"] + r["n_e"] + r["n_w"] for r in rows)
        if remaining < REWRITE_BELOW * size:
            kept, size, bounds = checkpoint(cands), remaining, []
            cands = kept


def resample(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    share: int = SHARE, min_words: int = MIN_WORDS, n_buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (all long) for every row of ``docs``.

    Null and empty texts have no features and weight 0. A null id has no key,
    so its score and rank are null and it is never drawn (nor counted among
    the eligible). Of the ``N`` rows with a score and at least ``min_words``
    words, the ``floor(share * N / 100)`` highest scores are drawn, ties to the
    smaller id and then to the smaller 64-bit hash of the text; rows equal in
    all three are interchangeable. Ranks run 1, 2, ... in that order; others are
    null. An empty benchmark gives every bucket the same target share. Only the
    named columns are read.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    table = gains(bucket_counts(docs, "text", n_buckets), bucket_counts(benchmark.select(F.col(item_text).alias("text")), "text", n_buckets), n_buckets)
    rows = checkpoint(scored(docs, table, "text", "doc_id", seed))
    eligible = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    n = rows.where(eligible).count()
    k = share * n // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if k == 0:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    keys = rows.where(eligible).select("score", "doc_id", "tie")
    pivot = cutoff(keys, k)
    top = eligible & (_better(F.col("score"), F.col("doc_id"), F.col("tie"), pivot) | _same(F.col("score"), F.col("doc_id"), F.col("tie"), pivot))
    winners = rows.where(top).repartitionByRange(F.col("score").desc(), F.col("doc_id").asc(), F.col("tie").asc())
    winners = checkpoint(winners.withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in winners.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part], before = before, before + sizes[part]
    start = F.element_at(F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p), F.lit(o))]), F.col("_part"))
    within = Window.partitionBy("_part").orderBy(F.col("score").desc(), F.col("doc_id").asc(), F.col("tie").asc())
    ranked = winners.withColumn("rank", (start + F.row_number().over(within)).cast("long"))
    ranked = ranked.select(*out, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return ranked.unionByName(rows.where(~top).select(*out, F.lit(None).cast("long").alias("rank")))
