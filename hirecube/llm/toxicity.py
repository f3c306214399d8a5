"""Toxicity of texts by a convolutional network over hashed word embeddings.

A word (a run of letters, in lower case) is the sum of the embeddings of its
hash and of the hashes of its first bytes, so inflected forms share a stem.
Filters of several widths slide over the words, max pooling keeps the best
place of each filter, and a logistic layer weighs them. The first embedding
dimension starts from how much likelier the hash is in toxic texts. All labelled
rows are used: they are dealt by hash over shards of bounded size, counts are
summed over shards, and in each epoch every shard trains the network in numpy
from where the last epoch left it; then what the shards changed is averaged,
each embedding over the shards that met it. Each language gets the threshold
that divides its labelled texts best, found on all of them by sorted ranges, and
a score of 0.5 is put there; the language is told from the text alone.
"""

from __future__ import annotations

import copy
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube.llm import language_id, samples, words
from hirecube.session import checkpoint

BUCKETS = 1 << 18
STEMS = (3, 4, 5, 6, 7, 8, 10)
SIZE = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
SHARD = 1 << 15  # labelled rows that one task trains on
BROADCAST = 500_000  # labelled rows up to which the labels are broadcast
BLOCK = 1 << 10  # buckets whose changes travel as one row
EPOCHS = 4
STEP = 32
RATE = 0.02
CALIBRATE = 4  # one row in so many, by hash, sets thresholds and trains nothing
CLEAN_WEIGHT = 3.0  # of a clean text called toxic against a toxic one missed, at equal rates
LEAST = 30  # rows of each label below which a language keeps the common threshold

GAPS = np.ones(256, bool)
GAPS[97:123] = GAPS[128:] = False


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, buckets of each distinct word, word number of each token, bounds of rows)``.

    Bucket 0 and word 0 are nothing; every row ends with enough of the latter to
    keep filters that begin at its words from reaching into the next.
    """
    pad = max(WIDTHS) - 1
    for first, data, offsets in words.lower_chunks(texts):
        starts, ends, rows = words.spans(data, offsets, GAPS)
        prefix = words.prefixes(data)
        hashes = words.hash_spans(data, starts, ends, prefix)
        distinct, where, which = np.unique(hashes, return_index=True, return_inverse=True)
        a, b = starts[where], ends[where]
        buckets = np.zeros((len(distinct) + 1, 1 + len(STEMS)), np.int32)
        buckets[1:, 0] = 1 + (distinct % words.U64(BUCKETS - 1)).astype(np.int32)
        for j, n in enumerate(STEMS, 1):
            longer = np.flatnonzero(b - a > n)
            stem = words.mix(words.hash_spans(data, a[longer], a[longer] + n, prefix))
            buckets[1 + longer, j] = 1 + (stem % words.U64(BUCKETS - 1)).astype(np.int32)
        tokens = np.insert(which + 1, np.repeat(rows[1:], pad), 0)
        yield first, buckets, tokens, rows + pad * np.arange(len(rows))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    embedding: np.ndarray
    kernels: list[np.ndarray]  # width by size by filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray  # one number

    def pooled(self, buckets: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, where: bool = False):
        """Best value of each filter per row (and its place)."""
        vectors = self.embedding.take(buckets, axis=0).sum(axis=1)
        best, place, nothing = [], [], np.flatnonzero(tokens == 0)
        for kernel in self.kernels:
            value = (vectors @ kernel[0]).take(tokens, axis=0)
            for j in range(1, len(kernel)):
                value[:-j] += (vectors @ kernel[j]).take(tokens[j:], axis=0)
            value[nothing] = 0  # from there on a filter would see the next row
            best.append(np.maximum.reduceat(value, bounds[:-1], axis=0))
            if where:
                hit = value == np.repeat(best[-1], np.diff(bounds), axis=0)
                at = np.where(hit, np.arange(len(value), dtype=np.int32)[:, None], np.int32(len(value)))
                place.append(np.minimum.reduceat(at, bounds[:-1], axis=0))
        best = np.concatenate(best, axis=1) + self.bias
        return (best, np.concatenate(place, axis=1)) if where else best

    def logit(self, buckets, tokens, bounds) -> np.ndarray:
        return np.maximum(self.pooled(buckets, tokens, bounds), 0) @ self.out + self.out_bias

    def parameters(self) -> dict[str, np.ndarray]:
        return {"e": self.embedding, "b": self.bias, "o": self.out, "c": self.out_bias} | {f"k{i}": k for i, k in enumerate(self.kernels)}

    def train(self, texts: pa.Array, labels: np.ndarray, rng: np.random.Generator, seen: dict[str, np.ndarray], met: np.ndarray) -> None:
        """One pass of Adagrad on the logistic loss; only the places that pooling chose pass a gradient on.

        ``seen`` holds the sums of squared gradients and ``met`` marks the buckets that were moved.
        """

        def update(name: str, x: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
            seen[name][at] += grad * grad
            x[at] -= RATE * grad / (np.sqrt(seen[name][at]) + 1e-6)

        order = rng.permutation(len(texts))
        for first in range(0, len(order), STEP):
            some = order[first:first + STEP]
            for at, buckets, tokens, bounds in features(texts.take(pa.array(some))):
                n = len(bounds) - 1
                best, place = self.pooled(buckets, tokens, bounds, where=True)
                active = np.maximum(best, 0)
                error = (_sigmoid(active @ self.out + self.out_bias) - labels[some[at:at + n]]) / n
                back = error[:, None] * self.out * (best > 0)
                update("o", self.out, active.T @ error)
                update("c", self.out_bias, error.sum(keepdims=True))
                update("b", self.bias, back.sum(axis=0))
                vectors = self.embedding.take(buckets, axis=0).sum(axis=1)
                rows, grads = [], []
                for i, kernel in enumerate(self.kernels):
                    mine = slice(i * FILTERS, (i + 1) * FILTERS)
                    grad = np.zeros_like(kernel)
                    for j in range(len(kernel)):
                        at_j = np.minimum(place[:, mine] + j, len(tokens) - 1)
                        word = tokens[at_j]
                        grad[j] = np.einsum("nfs,nf->sf", vectors[word], back[:, mine])
                        rows.append(buckets[word].reshape(-1, buckets.shape[1]))
                        grads.append((back[:, mine, None] * kernel[j].T[None]).reshape(-1, SIZE))
                    update(f"k{i}", kernel, grad)
                rows, grads = np.concatenate(rows), np.concatenate(grads)
                moved = np.abs(grads).sum(axis=1) > 0
                rows, grads = rows[moved], np.repeat(grads[moved], rows.shape[1], axis=0)
                touched, slot = np.unique(rows, return_inverse=True)
                slot = slot.reshape(-1)
                total = np.stack([np.bincount(slot, column, len(touched)) for column in grads.T], axis=1)
                total[touched == 0] = 0
                update("e", self.embedding, total.astype(np.float32), touched)
                met[touched] = True


def count(texts: pa.Array, labels: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` (buckets by label) the number of texts of each label that hold the bucket."""
    for first, buckets, tokens, bounds in features(texts):
        for row, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            out[np.unique(buckets[np.unique(tokens[a:b])]), labels[first + row]] += 1


def start(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> Network:
    counts = np.zeros((BUCKETS, 2))
    count(pa.array(texts, pa.string()), labels, counts)
    return start_from(counts, np.bincount(labels, minlength=2), rng)


def start_from(counts: np.ndarray, n: np.ndarray, rng: np.random.Generator) -> Network:
    """Small random values, but for one dimension of log odds, which one filter of each width reads as it is.

    ``counts`` are texts per bucket and label, ``n`` the texts of each label.
    """
    rate = np.log((counts + 2) / (n + 4))
    embedding = rng.normal(0, 0.02, (BUCKETS, SIZE)).astype(np.float32)
    odds = rate[:, 1] - rate[:, 0] - np.log((n[0] + 4) / (n[1] + 4))
    # what is seen too rarely says little
    embedding[:, 0] = odds * np.minimum(1, counts.sum(axis=1) / 8)
    embedding[0] = 0
    kernels = [rng.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
    for kernel in kernels:
        kernel[:, 0, 0] = 1.0 / len(kernel)
    bias, out = np.zeros(FILTERS * len(WIDTHS), np.float32), rng.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    out[0] = 1.0
    return Network(embedding, kernels, bias, out, np.full(1, -3.0, np.float32))


def thresholds(rows: DataFrame) -> dict[str | None, float]:
    """Per group of ``grp, logit, toxic`` the middle of the widest gap among those that leave the fewest weighted errors.

    Exact for any number of rows: equal values are counted together, sorted
    ranges tell how much of each group lies before them, and each range then
    finds its own best cut. A few numbers per range and group reach the driver.
    """
    counted = rows.groupBy("grp", "logit").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    ranges = checkpoint(counted.repartitionByRange("grp", "logit").sortWithinPartitions("grp", "logit"))
    ranges = ranges.withColumn("part", F.spark_partition_id())
    found = ranges.groupBy("grp", "part").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.max("logit").alias("last")).collect()
    groups: dict[str | None, list] = {}
    for r in sorted(found, key=lambda r: r["part"]):
        groups.setdefault(r["grp"], []).append(r)
    # per group and part: rows of either label before it, all rows of the group, the value before it, whether it is the last
    known = {}
    for grp, parts in groups.items():
        all1, all0 = sum(r["n1"] for r in parts), sum(r["n0"] for r in parts)
        before1 = before0 = 0
        for i, r in enumerate(parts):
            known[grp, r["part"]] = (before1, before0, all1, all0, parts[i - 1]["last"] if i else None, i == len(parts) - 1)
            before1, before0 = before1 + r["n1"], before0 + r["n0"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [x for x in batches if x.num_rows]
        if not some:
            return
        table = pa.Table.from_batches(some)
        names = table.column("grp").to_pylist()
        edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
        for first, last in zip(edges[:-1], edges[1:]):
            some = table.slice(first, last - first)
            logit, n1, n0 = (some.column(c).to_numpy() for c in ("logit", "n1", "n0"))
            before1, before0, all1, all0, previous, final = known[names[first], some.column("part")[0].as_py()]
            # errors with the cut before place i
            missed = before1 + np.r_[0, np.cumsum(n1)]
            false = all0 - before0 - np.r_[0, np.cumsum(n0)]
            errors = missed / max(all1, 1) + CLEAN_WEIGHT * false / max(all0, 1)
            low = np.r_[logit[0] - 2 if previous is None else previous, logit]
            high = np.r_[logit, logit[-1] + 2]
            if not final:  # the cut after the last value belongs to the next range
                errors, low, high = errors[:-1], low[:-1], high[:-1]
            best = np.flatnonzero(errors <= errors.min() + 1e-12)
            at = best[np.argmax((high - low)[best])]
            yield pa.RecordBatch.from_pydict({
                "grp": pa.array([names[first]], pa.string()), "errors": [float(errors[at])], "low": [float(low[at])], "high": [float(high[at])]})

    cuts: dict[str | None, list] = {}
    for r in ranges.select("grp", "logit", "n1", "n0", "part").mapInArrow(run, "grp string, errors double, low double, high double").collect():
        cuts.setdefault(r["grp"], []).append(r)
    out = {}
    for grp, some in cuts.items():
        least = min(r["errors"] for r in some) + 1e-12
        widest = min((r for r in some if r["errors"] <= least), key=lambda r: (r["low"] - r["high"], r["low"]))
        out[grp] = (widest["low"] + widest["high"]) / 2
    return out


@dataclass
class Model:
    network: Network | None
    constant: float
    languages: language_id.Classifier | None = None
    common: float = 0.0
    by_language: dict[str, float] = field(default_factory=dict)

    def _levels(self, texts: pa.Array) -> np.ndarray:
        level = np.full(len(texts), self.common)
        if self.by_language:
            each = np.array([self.by_language.get(c, self.common) for c in self.languages.classes])
            for first, present in language_id.presence(texts):
                level[first:first + len(present)] = each[self.languages.predict(present)[0]]
        return level

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for first, *parts in features(texts):
            got = self.network.logit(*parts)
            out[first:first + len(got)] = got
        return _sigmoid(out - self._levels(texts))


def _over_shards(rows: DataFrame, work: Callable[[int, Iterator[tuple[pa.Array, np.ndarray]]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The arrays that ``work`` makes of each shard's texts and labels, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (x for x in batches if x.num_rows)
        first = next(batches, None)
        if first is not None:
            parts = ((x.column("text"), x.column("toxic").to_numpy().astype(np.int64)) for x in itertools.chain([first], batches))
            at = first.column("shard")[0].as_py()
            yield samples.pieces(at, work(at, parts))

    return samples.summed(rows.select("shard", "text", "toxic").mapInArrow(run, samples.PIECES))


def _blocks(x: np.ndarray) -> dict[int, np.ndarray]:
    """What of ``x`` (a row per bucket) isn't zero, by blocks of buckets."""
    parts = {i: x[a:a + BLOCK] for i, a in enumerate(range(0, BUCKETS, BLOCK))}
    return {i: part for i, part in parts.items() if part.any()}


def _start(rows: DataFrame, n: np.ndarray, rng: np.random.Generator) -> Network:
    def work(_: int, parts) -> dict[int, np.ndarray]:
        held = np.zeros((BUCKETS, 2))
        for texts, labels in parts:
            count(texts, labels, held)
        return _blocks(held)

    counts = np.zeros((BUCKETS, 2))
    for i, part in _over_shards(rows, work).items():
        counts[i * BLOCK:(i + 1) * BLOCK] = part.reshape(-1, 2)
    return start_from(counts, n, rng)


def _epoch(rows: DataFrame, network: Network, seen: dict[str, np.ndarray], seed: tuple[int, int]) -> None:
    """One pass of every shard from the same start; the mean of what they changed moves ``network`` and ``seen``."""
    shared = rows.sparkSession.sparkContext.broadcast((network, seen))  # of fixed size

    def work(shard: int, parts) -> dict[int, np.ndarray]:
        before, before_seen = shared.value
        own, own_seen = copy.deepcopy(shared.value)
        met = np.zeros(BUCKETS, bool)
        rng = np.random.default_rng([*seed, shard])
        for texts, labels in parts:
            own.train(texts, labels, rng, own_seen, met)
        was, now = before.parameters(), own.parameters()
        small = [(now[k] - was[k]).ravel() for k in was if k != "e"] + [(own_seen[k] - before_seen[k]).ravel() for k in was if k != "e"]
        moved = np.c_[own.embedding - before.embedding, own_seen["e"] - before_seen["e"], met]
        return {**_blocks(moved), -1: np.concatenate([*small, [1]])}

    got = _over_shards(rows, work)
    shared.destroy()
    small = got.pop(-1).astype(np.float64)
    for i, part in got.items():
        moved, here = part.reshape(-1, 2 * SIZE + 1), slice(i * BLOCK, (i + 1) * BLOCK)
        mean = moved[:, :-1] / np.maximum(moved[:, -1:], 1)
        network.embedding[here] += mean[:, :SIZE]
        seen["e"][here] += mean[:, SIZE:]
    small, at = small[:-1] / small[-1], 0
    for target in (network.parameters(), seen):
        for name, x in target.items():
            if name != "e":
                x += small[at:at + x.size].reshape(x.shape).astype(x.dtype)
                at += x.size


def _logits(rows: DataFrame, network: Network) -> DataFrame:
    """``lang, toxic, logit`` of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            out = np.zeros(many.num_rows)
            for first, *parts in features(many.column("text")):
                got = shared.value.logit(*parts)
                out[first:first + len(got)] = got
            yield pa.RecordBatch.from_arrays([many.column("lang"), many.column("toxic"), pa.array(out)], names=["lang", "toxic", "logit"])

    return rows.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic int, logit double")


def learn(docs: DataFrame, labels: DataFrame, shard: int = SHARD, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """From all rows of ``labels`` (``doc_id, toxic``) and their ``text`` and ``lang``, about ``shard`` of them to a task.

    A document labelled more than once is toxic if one label says so; null
    labels and labels without a document or text teach nothing. With one label
    only, every score is that label (0 without any).
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    parts = max(1, -(-n // shard))
    draw = F.xxhash64(F.lit(10), "doc_id")
    place = F.pmod("draw", F.lit(samples.UNIT))
    rows = (
        docs.where(F.col("text").isNotNull()).join(F.broadcast(known) if n <= BROADCAST else known, "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))
        .select("doc_id", "toxic", draw.alias("draw"), "x.text", F.col("x.lang").cast("string").alias("lang"))
        .withColumn("shard", F.floor(place * parts / samples.UNIT).cast("int"))
        .withColumn("check", F.pmod(F.shiftright("draw", 40), F.lit(CALIBRATE)) == 0)
    )
    rows = checkpoint(rows.repartitionById(parts, "shard").sortWithinPartitions("draw", "doc_id"))
    found = {(r["check"], r["toxic"]): r["count"] for r in rows.groupBy("check", "toxic").count().collect()}
    if len({toxic for _, toxic in found}) < 2:
        return Model(None, float(max((toxic for _, toxic in found), default=0)))
    apart = len(found) == 4  # else all rows both train and set thresholds
    training, checked = (rows.where("not check"), rows.where("check")) if apart else (rows, rows)
    sizes = np.array([sum(n for (check, toxic), n in found.items() if toxic == label and not (apart and check)) for label in (0, 1)])
    network = _start(training, sizes, np.random.default_rng(seed))
    seen = {name: np.zeros_like(x) for name, x in network.parameters().items()}
    for epoch in range(epochs):
        _epoch(training, network, seen, (seed, epoch))
    model = Model(network, 0.0)
    model.languages = language_id.fit_all(rows.where("lang is not null and text != ''"), F.col("draw"), F.col("shard"))
    logits = checkpoint(_logits(checked, network))
    by_label = logits.where("lang is not null").groupBy("lang").agg(
        F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    enough = [r["lang"] for r in by_label.where(F.least("n0", "n1") >= LEAST).collect()]
    common = logits.select(F.lit(None).cast("string").alias("grp"), "logit", "toxic")
    own = logits.where(F.col("lang").isin(enough)).select(F.col("lang").alias("grp"), "logit", "toxic")
    cuts = thresholds(common.unionByName(own))
    model.common = cuts.pop(None)
    model.by_language = {lang: cut for lang, cut in cuts.items() if lang in model.languages.classes}
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every row."""
    kept = docs.select(*keep).schema
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"]
    source = text if text in kept.names else "_text"
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets, filters and languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            got = shared_model.value.score(many.column(source))
            yield pa.RecordBatch.from_arrays(
                [*(many.column(c) for c in kept.names), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                names=[*kept.names, "score", "predicted"])

    # a text that is kept is sent once
    more = [] if source == text else [F.col(text).alias(source)]
    return docs.select(*keep, *more).mapInArrow(run, ", ".join(kinds))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, shard: int = SHARD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id, text, lang``).

    Labels count only where ``held_out``, a condition on ``doc_id``, is not true.
    Scores see the text alone. Null and empty texts get the score of no word at
    all; null and repeated ids pass through; an empty table gives an empty
    result. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    out = F.coalesce(held_out, F.lit(False))
    model = learn(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~out), shard)
    return score(rows.withColumn("held_out", out), model, ["doc_id", "held_out"])
