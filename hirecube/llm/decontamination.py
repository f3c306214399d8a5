"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words: ``A-Z`` are lower-cased, then a word is a run of ``0-9 a-z`` and of code
points above U+007F. A window is ``WINDOW`` consecutive words of a benchmark
item, or the whole item when it has fewer words (but some). A document word
inside any occurrence of any window is hit.

Method. For a window length ``L``, every run of ``t = min(5, ceil(L / 2))``
words has a 64-bit hash, and in every run of ``w = L - t + 1`` consecutive such
hashes the smallest is kept (winnowing; all positions that hold it). An
occurrence of a window spans exactly ``w`` of these hashes on both sides, so
document and item keep the same smallest value there: joining kept hashes
finds every occurrence, however long or short the shared span. Each hit is then
extended to the ``w`` alignments of windows that contain it; an alignment is
confirmed when the window's own key agrees on both sides: the hashes of its
first and of its last ``t`` words, which together cover all ``L`` words.

The kept hashes of the benchmark are measured: below ``MAX_BROADCAST_ROWS`` they
are broadcast and the documents stream past them without a shuffle; above,
document rows are salted over ``SALTS`` tasks and the benchmark rows copied to
every salt, so a passage that a third of all documents share is still split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube.session import checkpoint

# Fixed values of the contract: the word pattern, the window of ten words.
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ by its complement, which Java matches faster than a negated class
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10

MAX_T = 5
MAX_BROADCAST_ROWS = 2_000_000
SALTS = 64
_LONGS = "array<bigint>"


def words(text: Column) -> Column:
    """The words of a text; null is empty."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def tier(length: int) -> tuple[int, int]:
    """``(t, w)`` for windows of ``length`` words: words per hash and hashes per winnowing window."""
    t = min(MAX_T, (length + 1) // 2)
    return t, length - t + 1


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value``: the value is named once, so plans stay linear however often ``x`` is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0))) if by else a


def _pairwise(a: Column, by: int, how) -> Column:
    """``how(a[i], a[i + by])`` for ``i`` up to ``len(a) - by``; empty if none."""
    if not by:
        return a
    return let(a, lambda x: F.slice(F.zip_with(x, _shift(x, by), how), 1, F.greatest(F.size(x) - by, F.lit(0))))


def sliding(a: Column, width: int, how) -> Column:
    """``how`` over every run of ``width`` consecutive elements, by doubling (``how`` idempotent, skips nulls)."""
    step, out = 1, a
    while 2 * step <= width:
        out = _pairwise(out, step, how)
        step *= 2
    return _pairwise(out, width - step, how) if width > step else out


def gram_hashes(one: Column, t: int) -> Column:
    """Hash of each run of ``t`` words from the hashes ``one`` of single words, chained; empty when there are fewer words."""
    def chain(o: Column) -> Column:
        out = o
        for k in range(1, t):
            out = F.slice(F.zip_with(out, _shift(o, k), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(o) - k, F.lit(0)))
        return out
    return let(one, chain)


_FP = "array<struct<L:int,p:int,fh:bigint,keys:array<bigint>>>"


def _tier_rows(h: Column, n: int, t: int) -> Column:
    """The kept runs of one tier as structs: where a run's hash is the smallest of some window holding it.

    ``p`` is a 1-based position of a run of ``t`` words, ``fh`` its hash and
    ``keys[j]`` the key of the window that starts ``j`` words before ``p`` (null
    where that window would leave the text).
    """
    width = n - t + 1
    pad = F.array_repeat(F.lit(None).cast("bigint"), width - 1)
    lows = sliding(h, width, lambda a, b: F.least(a, b))
    highs = sliding(F.concat(pad, lows, pad), width, lambda a, b: F.greatest(a, b))
    keys = F.slice(F.zip_with(h, _shift(h, n - t), lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(h) - (n - t), F.lit(0)))

    def rows(high: Column, key: Column) -> Column:
        def around(p: Column) -> Column:
            return F.array(*[F.when((p - j >= 1) & (p - j <= F.size(key)), F.element_at(key, F.greatest(p - j, F.lit(1))))
                             for j in range(n - t + 1)])
        chosen = F.filter(F.sequence(F.lit(1), F.size(h)), lambda p: F.element_at(h, p) == F.element_at(high, p))
        return F.transform(chosen, lambda p: F.struct(
            F.lit(n).alias("L"), p.alias("p"), F.element_at(h, p).alias("fh"), around(p).alias("keys")))

    return let(highs, lambda high: let(keys, lambda key: rows(high, key)))


def _tier(n: int, t: int):
    return lambda h: _tier_rows(h, n, t)


def kept(w: Column, lengths: list[int], length_of_row: Column | None = None) -> Column:
    """For each window length, the winnowed runs of the words ``w`` as ``struct<L, p, fh, keys>`` (see ``_tier_rows``).

    Where ``length_of_row`` is given, a row gets only the tier of that length.
    """
    def tiers(one: Column) -> Column:
        grams = {t: gram_hashes(one, t) for t in {tier(n)[0] for n in lengths}}
        parts = []
        for n in lengths:
            t = tier(n)[0]
            use = F.size(one) >= n if length_of_row is None else (length_of_row == n) & (F.size(one) >= n)
            parts.append(F.when(use, let(grams[t], _tier(n, t))).otherwise(F.array().cast(_FP)))
        return F.concat(*parts) if len(parts) > 1 else parts[0]
    return let(F.transform(w, lambda x: F.xxhash64(x)), tiers)


def _joined(doc_fp: DataFrame, item_fp: DataFrame, max_rows: int, salts: int) -> DataFrame:
    n = item_fp.count()
    if n <= max_rows:
        return doc_fp.join(F.broadcast(item_fp), ["L", "fh"])
    salted = doc_fp.withColumn("_salt", F.pmod(F.xxhash64("_key", "_tkey", "p"), F.lit(salts)).cast("int"))
    copies = item_fp.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, ["L", "fh", "_salt"]).drop("_salt")


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id", window: int = WINDOW, max_broadcast_rows: int = MAX_BROADCAST_ROWS, salts: int = SALTS,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``.

    One row per input row, in no order; rows of equal id and text get equal
    results, rows of one id with other texts their own. Null and empty texts
    have no words and are clean; a null id is an id like any other. Benchmark
    rows with a null id or text take no part; rows of one id are one item
    whatever their texts. ``items_sha256`` is the SHA-256 of the distinct
    item ids found, as decimal strings sorted as strings and joined by commas
    (of the empty string where there are none). Only the four named columns are
    read, so other columns of either table may have any names. Empty tables give
    an empty result, or all documents clean.
    """
    base = docs.select(F.col(doc_id).alias("_key"), F.xxhash64(F.col(text)).alias("_tkey"), words(F.col(text)).alias("_w"))
    items = (
        benchmark.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull())
        .select(F.col(item_id).cast("long").alias("item_id"), words(F.col(item_text)).alias("_w"))
        .where(F.size("_w") > 0)
    )
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_w"), F.lit(window))).distinct().collect())
    if lengths:
        item_fp = checkpoint(
            items.select("item_id", F.inline(kept(F.col("_w"), lengths, F.least(F.size("_w"), F.lit(window)))))
            .select("item_id", "L", F.col("p").alias("q"), "fh", F.col("keys").alias("ikeys")))
        doc_fp = base.select("_key", "_tkey", F.inline(kept(F.col("_w"), lengths))).withColumnRenamed("keys", "dkeys")
        found = _joined(doc_fp, item_fp, max_broadcast_rows, salts)
        same = F.filter(F.sequence(F.lit(0), F.size("dkeys") - 1), lambda j: F.element_at(F.col("dkeys"), j + 1) == F.element_at(F.col("ikeys"), j + 1))
        occ = (
            found.select("_key", "_tkey", "item_id", "L", "p", F.explode(same).alias("j"))
            .select("_key", "_tkey", "item_id", (F.col("p") - F.col("j")).alias("s"), (F.col("p") - F.col("j") + F.col("L") - 1).alias("e"))
        )
    else:
        occ = base.sparkSession.createDataFrame([], "_key long, _tkey long, item_id long, s int, e int")
    occ = checkpoint(occ.distinct())
    order = Window.partitionBy("_key", "_tkey").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(order), F.lit(0))
    hit = (
        occ.select("_key", "_tkey", "s", "e").distinct()
        .withColumn("_new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), reach + 1) + 1))
        .groupBy("_key", "_tkey").agg(F.sum("_new").cast("long").alias("n_hit"))
    )
    named = (
        occ.select("_key", "_tkey", "item_id").distinct()
        .groupBy("_key", "_tkey").agg(
            F.count(F.lit(1)).alias("n_items"),
            F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("item_id").cast("string"))), ","), 256).alias("items_sha256"))
    )
    summary = hit.alias("h").join(
        named.alias("n"), F.col("h._key").eqNullSafe(F.col("n._key")) & (F.col("h._tkey") == F.col("n._tkey"))
    ).select("h._key", "h._tkey", "n_hit", "n_items", "items_sha256")
    out = base.select("_key", "_tkey", F.size("_w").cast("long").alias("n_words")).alias("d").join(
        summary.alias("s"), F.col("d._key").eqNullSafe(F.col("s._key")) & (F.col("d._tkey") == F.col("s._tkey")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        F.col("d._key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col("items_sha256"), F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
