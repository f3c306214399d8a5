"""Near-duplicates by min-max hashing of five-word shingles, confirmed on full sets.

Every permutation gives two signature components, the least and the greatest
hash. Bands of ``ROWS`` components deal documents into buckets. Texts with
equal sets are one class, and classes are what is compared:

1. each bucket compares its members with one of them, another one in every band;
2. where a bucket still holds members that aren't connected, those outside its
   largest group meet all others inside the join's condition. There 16 bits of
   every shingle bound the similarity from above, so that no link is missed and
   full sets aren't copied to every bucket; pairs that pass, few besides links,
   are confirmed on full sets.

Two sets at the threshold share no bucket with probability
``(1 - 0.75 ** ROWS) ** BANDS``, about 2.5e-7. Components come from hooking
each node to its least neighbour and contracting, over tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube.llm import words
from hirecube.operators.joins import lookup_join
from hirecube.session import checkpoint

U64 = words.U64
SHINGLE = 5
ROWS = 4
BANDS = 40
SIMILARITY = 75  # percent
PERMUTATIONS = ROWS * BANDS // 2
LOOKUP_ROWS = 2_000_000

_rng = np.random.default_rng(17)
FACTORS = _rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * U64(2) + U64(1)
DEALT = _rng.permutation(2 * PERMUTATIONS).reshape(BANDS, ROWS)  # which components each band has


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, sorted distinct shingle hashes, bounds of rows)`` per chunk."""
    for first, hashes, rows in words.word_hashes(texts):
        run = np.zeros(max(len(hashes) - SHINGLE + 1, 0), U64)
        for j in range(SHINGLE):
            run = words.combine(run, hashes[j:len(hashes) - SHINGLE + 1 + j])
        parts = []
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= SHINGLE:
                parts.append(np.unique(run[a:b - SHINGLE + 1]))
            else:
                whole = np.array([b - a], U64)
                for j in range(a, b):
                    whole = words.combine(whole, hashes[j:j + 1])
                parts.append(whole[:b > a])
        yield first, np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]


def nodes_of(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit identity per set."""
    size = np.diff(bounds).astype(U64)
    return words.combine(words.sums(words.mix(hashes), bounds), size).view(np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Band keys of non-empty sets: rows by ``BANDS``."""
    n = len(bounds) - 1
    parts = np.empty((2 * PERMUTATIONS, n), U64)
    scratch = np.empty_like(hashes)
    for p, factor in enumerate(FACTORS):
        np.multiply(hashes, factor, out=scratch)
        np.minimum.reduceat(scratch, bounds[:-1], out=parts[2 * p])
        np.maximum.reduceat(scratch, bounds[:-1], out=parts[2 * p + 1])
    keys = np.empty((n, BANDS), U64)
    for band, chosen in enumerate(DEALT):
        key = np.full(n, band, U64)
        for c in chosen:
            key = words.combine(key, parts[c])
        keys[:, band] = key
    return keys.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n, node, bands`` per row; an empty set has no node and no bands."""
    kinds = "doc_id long, text_hash long, n long, node long, bands array<bigint>"
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "text_hash", "n", "node")] + [("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for first, hashes, bounds in shingle_sets(many.column("text")):
                n = np.diff(bounds)
                full = n > 0
                keys = signatures(hashes, np.r_[bounds[:-1][full], len(hashes)]) if full.any() else np.zeros((0, BANDS), np.int64)
                where = np.r_[0, np.cumsum(full) * BANDS].astype(np.int32)
                yield words.batch(
                    schema, doc_id=many.column("doc_id").slice(first, len(n)), text_hash=many.column("text_hash").slice(first, len(n)),
                    n=n, node=pa.array(nodes_of(hashes, bounds), mask=~full),
                    bands=pa.ListArray.from_arrays(pa.array(where), pa.array(keys.reshape(-1))))

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, kinds)


def _sets(docs: DataFrame) -> DataFrame:
    """``node, shingles`` of rows that come with the ``node`` they stand for."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for _, hashes, bounds in shingle_sets(many.column("text")):
                yield words.batch(
                    schema, node=nodes_of(hashes, bounds),
                    shingles=pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))))

    return docs.select("text").mapInArrow(run, "node long, shingles array<bigint>")


def alike(a: Column, b: Column, percent: int = SIMILARITY) -> Column:
    """Whether two sets reach the similarity; their sizes are looked at first."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (100 * small >= percent * large) & ((100 + percent) * both >= percent * (F.size(a) + F.size(b)))


def brief(shingles: Column) -> Column:
    """The distinct 16-bit heads of a set's hashes."""
    return F.array_distinct(F.transform(shingles, lambda x: F.shiftright(x, 48).cast("short")))


def maybe_alike(a: Column, n_a: Column, b: Column, n_b: Column, percent: int = SIMILARITY) -> Column:
    """True wherever :func:`alike` is, of two sets' ``brief`` forms and sizes; seldom otherwise.

    A set loses to equal heads at least as many members as any part of it does,
    so the common heads and the lesser loss bound the common members. Heads of
    sets of many times 65,536 shingles say little; such pairs all pass.
    """
    both = F.size(F.array_intersect(a, b)) + F.least(n_a - F.size(a), n_b - F.size(b))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * both >= percent * (n_a + n_b))


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the edges ``a, b``; ``comp`` names the connected component."""
    edges = checkpoint(edges.select("a", "b"))
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    named = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = checkpoint(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
        # the first round hooks every node itself, later ones what it has become
        named = hook.select(F.col("a").alias("node"), F.col("to").alias("comp")) if named is None else checkpoint(
            named.join(hook, F.col("comp") == F.col("a"), "left").select("node", F.coalesce("to", "comp").alias("comp")))
        x, y = hook.select("a", F.col("to").alias("x")), hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = checkpoint(
            edges.join(x, "a").join(y, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if edges.isEmpty():
            return named


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash, stays`` for every row.

    ``kept`` is ``doc_id = component_id``; ``stays`` marks one (id, text) of each
    component, also where ids are null or repeated. Rows without words have no
    shingles, are their own component and stay. A null id counts as the largest;
    a component of such alone has a null id. Repeated rows are in one class. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    signed = checkpoint(_signed(rows))
    classes = checkpoint(
        signed.where("n > 0").groupBy("node").agg(
            F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), "text_hash", "doc_id")).alias("first"),
            F.first("bands").alias("bands")))
    members = classes.select("node", F.posexplode("bands").alias("band", "value"))
    members = members.select("node", F.xxhash64("band", "value").alias("key")).repartition("key")
    # the pivot of a bucket has the least node by an order of the bucket's own
    sizes = members.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("least")).where("size > 1")
    buckets = checkpoint(members.join(sizes, "key").select("key", "node", F.col("least").bitwiseXOR(F.col("key")).alias("pivot")))
    wanted = checkpoint(
        buckets.select("node").distinct().join(classes, "node").select("first.text_hash", F.col("first.doc_id").alias("rep")))
    chosen = lookup_join(rows, wanted, "text_hash", max_rows=LOOKUP_ROWS, spread_by=["doc_id"])
    sets = checkpoint(_sets(chosen.where(F.col("doc_id").eqNullSafe(F.col("rep")))).groupBy("node").agg(F.first("shingles").alias("shingles")))

    pairs = buckets.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    of = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"of_{name}"))
    confirmed = lambda pairs: pairs.join(of("a"), "a").join(of("b"), "b").where(alike(F.col("of_a"), F.col("of_b"), percent))
    links = checkpoint(confirmed(pairs).select("a", "b"))
    named = components(links)

    placed = buckets.select("key", "node").join(named, "node", "left").select(
        "key", "node", F.coalesce("comp", "node").alias("comp"))
    groups = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = groups.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "comp"))["comp"].alias("largest"))
    left = checkpoint(placed.join(open_.where("groups > 1").select("key", "largest"), "key"))
    heads = sets.select("node", brief(F.col("shingles")).alias("heads"), F.size("shingles").alias("n"))
    held = checkpoint(left.join(heads, "node").select("key", "node", "comp", (F.col("comp") != F.col("largest")).alias("outside"), "heads", "n"))
    l, r = held.where("outside").alias("l"), held.alias("r")
    one, other = F.struct("l.node", "l.comp"), F.struct("r.node", "r.comp")
    near = checkpoint(l.join(
        r, (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp"))
        & (~F.col("r.outside") | (F.col("l.node") < F.col("r.node")))
        & maybe_alike(F.col("l.heads"), F.col("l.n"), F.col("r.heads"), F.col("r.n"), percent),
    ).select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y")).distinct().select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.comp").alias("of_x"), F.col("y.comp").alias("of_y")))
    more = confirmed(near).select(F.least("of_x", "of_y").alias("a"), F.greatest("of_x", "of_y").alias("b")).distinct()
    # the new links join components that are whole already
    joined = components(more).withColumnRenamed("comp", "to").withColumnRenamed("node", "comp")

    whole = checkpoint(
        classes.select("node", "first").join(named, "node", "left").select("node", "first", F.coalesce("comp", "node").alias("comp"))
        .join(joined, "comp", "left").select("node", "first", F.coalesce("to", "comp").alias("comp")))
    first = whole.groupBy("comp").agg(F.min("first").alias("best"))
    of_node = checkpoint(whole.join(first, "comp").select("node", "best"))
    # empty sets have no node and so no match; a filter that says so would have Spark build
    # a Bloom filter of all nodes and hold it on the driver, where the join needs none
    full = signed.join(of_node, "node").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("best.doc_id").alias("component_id"), "text_hash",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("stays"))
    empty = signed.where("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_hash", F.lit(True).alias("stays"))
    return full.unionByName(empty).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash", "stays")
