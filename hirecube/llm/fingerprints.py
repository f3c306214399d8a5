"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each text's five-word shingles are hashed once; the hash's top bits name a bin
and each bin keeps its least value. Empty bins are filled by optimal
densification: a bin goes through bins in its own random order and takes the
value of the first one that isn't empty. The fingerprint is the low four bits
of every bin, and the likeness of two is the share of equal digits, less what
chance makes equal.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube.session import checkpoint

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
DIGIT_BITS = 4
LOW = 63 - BIN_BITS  # bits of a value within its bin
EMPTY = (1 << LOW) - 1
PROBES = 6
PARTS = 3  # ranges of documents for each shuffle partition

_orders = [random.Random(1000 + t) for t in range(PROBES)]
# of each bin, the bins that it tries one after the other
PROBE = [[r.randrange(BINS) for _ in range(BINS)] for r in _orders]


def _constant(values: list[int], kind: str) -> Column:
    """An array literal as one expression, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def shingle_hashes(text: Column) -> Column:
    """Non-negative hashes of all runs of five words, or of the whole of a shorter text; no words give none."""
    words = F.filter(F.split(F.lower(text), r"[ \t-\r]+"), lambda w: w != "")
    one = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        n = F.size(h)
        whole = F.aggregate(h, F.lit(n).cast("long"), lambda a, x: F.xxhash64(a, x))
        run = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(SHINGLE)]))
        found = F.when(n >= SHINGLE, run).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << 63) - 1)))

    # a one-element array binds the words, so that they are not split again for each use
    return F.get(F.transform(F.array(one), runs), F.lit(0))


def minima(hashes: Column) -> Column:
    """The least hash of every bin in order; a bin's greatest possible value where it is empty."""
    ends = _constant([(b << LOW) | EMPTY for b in range(BINS)], "bigint")
    firsts = lambda a: F.filter(a, lambda x, i: (i == 0) | (F.shiftright(x, LOW) != F.shiftright(F.get(a, i - 1), LOW)))
    return F.get(F.transform(F.array(F.sort_array(F.concat(hashes, ends))), firsts), F.lit(0))


def densify(values: Column) -> Column:
    """Fill empty bins; the array must hold a value. A bin that its probes leave empty asks all bins in a random order."""
    probe = [_constant(order, "int") for order in PROBE]
    is_empty = lambda x: x.bitwiseAND(F.lit(EMPTY)) == EMPTY

    def fill(a: Column) -> Column:
        held = F.transform(a, lambda x: F.when(~is_empty(x), x))

        def from_held(h: Column) -> Column:
            some = F.filter(h, lambda x: x.isNotNull())

            def one(x: Column, i: Column) -> Column:
                rank = lambda y: F.struct(F.xxhash64(i, F.shiftright(y, LOW)).alias("r"), y.alias("y"))
                last = F.array_min(F.transform(some, rank))["y"]
                return F.coalesce(x, *[F.get(h, F.get(p, i)) for p in probe], last)

            return F.transform(h, one)

        return F.get(F.transform(F.array(held), from_held), F.lit(0))

    return F.get(F.transform(F.array(values), fill), F.lit(0))


def digits(hashes: Column) -> Column:
    """The fingerprint as longs of sixteen digits each; an empty array for no shingles."""
    low = F.transform(densify(minima(hashes)), lambda x: x.bitwiseAND(F.lit(15)))
    per_long = 64 // DIGIT_BITS

    def pack(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per_long - 1)), lambda k: F.aggregate(
            F.slice(a, k * per_long + 1, per_long), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, DIGIT_BITS).bitwiseOR(x)))

    packed = F.get(F.transform(F.array(low), pack), F.lit(0))
    return F.when(F.size(hashes) > 0, packed).otherwise(F.array().cast("array<bigint>"))


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of the shingle sets: 1 for two without shingles, 0 for one without."""
    ones = int("1" * (64 // DIGIT_BITS), 16)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseAND(F.lit(ones)))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -DIGIT_BITS
    estimate = (1 - unequal / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))
    )


def _ranges(rows: DataFrame, parts: int) -> list[int]:
    """Descending ids that cut the rows into about equal parts; an id of many rows stands several times."""
    at = [i / parts for i in range(1, parts)] or [0.5]
    found = rows.agg(F.percentile_approx("doc_id", at, 10 * parts).alias("q")).first()["q"]
    return sorted(found or [], reverse=True)


def edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """``doc_id, text, edited, digits, next_digits``: each text with its last half replaced from the next document.

    Documents stand in descending id order, null ids last, equal ids by a hash
    of their text; the first follows the last. They are dealt by id ranges, an
    id of many rows over several ranges. The first document of each range also
    stands, marked, at the end of the range before it.
    """
    parts = parts or PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = _constant(_ranges(rows, parts), "bigint")
    draw = F.shiftrightunsigned("tie", 12) / float(1 << 52)
    ahead = F.size(F.filter(cuts, lambda c: c > F.col("doc_id")))
    equal = F.size(F.filter(cuts, lambda c: c == F.col("doc_id")))
    part = F.when(F.col("doc_id").isNull(), parts + F.floor(parts * draw)).otherwise(ahead + F.floor(equal * draw))
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("part", part.cast("long")).withColumn("guest", F.lit(False))

    # one row for each range, of which there are a fixed number
    first_id = checkpoint(rows.groupBy("part").agg(F.max("doc_id").alias("first_id")))
    whole = Window.partitionBy(F.lit(0)).orderBy("part")
    before = first_id.select("part", F.coalesce(F.lag("part").over(whole), F.last("part").over(
        whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("host"), "first_id")
    guests = (
        rows.join(F.broadcast(before), "part").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("host", "doc_id").agg(F.min_by("text", F.struct(F.shiftrightunsigned("tie", 12).alias("a"), F.col("tie").alias("b"))).alias("text"))
        .select("doc_id", "text", F.xxhash64("text").alias("tie"), F.col("host").alias("part"), F.lit(True).alias("guest"))
    )
    own = Window.partitionBy("part").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.shiftrightunsigned("tie", 12), F.col("tie"))
    joined = (
        rows.unionByName(guests).withColumn("digits", digits(shingle_hashes(F.col("text"))))
        .withColumn("next", F.lead(F.struct("text", "digits")).over(own)).where("not guest")
    )
    half = F.floor(F.char_length("text") / 2).cast("int")
    change = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.col("next")["text"], F.lit(1), half))
    return joined.select("doc_id", "text", change.alias("edited"), "digits", F.col("next")["digits"].alias("next_digits"))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Null texts are empty, with an empty fingerprint. A single document is its
    own next one. Repeated rows are documents of their own. An empty table gives
    an empty result. Other columns are not read.
    """
    rows = edited(docs, text, doc_id).withColumn("edited_digits", digits(shingle_hashes(F.col("edited"))))
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("digits")).alias("fingerprint"), as_text(F.col("edited_digits")).alias("edited_fingerprint"),
        likeness(F.col("digits"), F.col("edited_digits")).alias("near_edited"),
        likeness(F.col("digits"), F.col("next_digits")).alias("near_next"),
    )
