"""Interpolated modified Kneser-Ney scores of whole texts from a bigram model counted in Spark.

Tokens are the lower-cased words of a text and one end. The model lies in the
shared folder as sorted hash arrays, which scoring workers map into memory:

* ``vocab-*``: sorted 64-bit word hashes with their counts; a word's id is its place in all of them;
* ``lower-*``: for the same words, distinct words before them (the continuation count), and how many distinct
  words follow them once, twice and more often;
* ``pair-*``: sorted 64-bit hashes of (word id, next id) with their counts in one byte, and the larger counts apart.

With ``c`` the count of a pair, ``t`` that of its first word, ``a`` the
continuation count, ``A`` its sum and ``V`` the number of words,

    p(w | v) = (max(c - D(c), 0) + g(v) p(w)) / t,    p(w) = (max(a - E(a), 0) + g / (V + 1)) / A,

where ``D`` and ``E`` are the three discounts from the counts of counts, and
``g`` is what they took off. After an unseen word p(w | v) is p(w); all unseen
words together count as one more word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube.llm import shared, words
from hirecube.session import checkpoint

U64 = words.U64
END = words.mix(np.array([0xE0D], U64))[0]
SHARD_WORDS = 4_000_000
SHARD_TOKENS = 8_000_000
PART_BITS = 2  # a shard's pairs are merged in so many bits of parts, one part in memory at a time
GROUP_TOKENS = 1_500_000
FALLBACK = (0.5, 1.0, 1.5)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many counts are 1, 2, 3 and 4; fixed ones where those don't allow an estimate."""
    if min(n) <= 0:
        return FALLBACK
    y = n[0] / (n[0] + 2 * n[1])
    d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return d if all(0 <= x <= k for k, x in zip((1, 2, 3), d)) else FALLBACK


def _minus(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(count - np.array([0.0, *d])[np.minimum(count, 3)], 0.0)


def _shard(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, keys)
    found = at < len(sorted_keys)
    found[found] = sorted_keys[at[found]] == keys[found]
    return at, found


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _save(path: str, array: np.ndarray) -> None:
    shared.publish(path, lambda out: np.save(out, array))


def _schema(kinds: str) -> pa.Schema:
    return pa.schema([(n.split()[0], pa.int64()) for n in kinds.split(", ")])


KNOWN = "kind long, id long, a long, b long, c long, d long"  # of a word (kind 0), or sums
PAIRS = "shard int, part long, a binary, b binary, c binary"  # word ids, next ids and counts, as little-endian 32-bit arrays


def sequences(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, token hashes, tokens before each row)``: words and an end per row."""
    for first, hashes, rows in words.word_hashes(texts):
        yield first, np.insert(hashes, rows[1:], END), rows + np.arange(len(rows))


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    vocab_bits: int
    offsets: list[int]  # ids before each vocabulary shard
    pair_bits: int
    n_tokens: int = 0
    after_begin: tuple[int, ...] = (0, 0, 0)  # distinct words that begin texts once, twice, more often
    n_texts: int = 0
    pair_counts: tuple[int, ...] = (0, 0, 0, 0)  # how many pairs have count 1, 2, 3, 4
    lower_counts: tuple[int, ...] = (0, 0, 0, 0)
    lower_many: int = 0  # words with a continuation count of 3 or more
    n_pairs: int = 0

    def __post_init__(self):
        self.size = self.offsets[-1]
        self.begin, self.unknown = self.size, self.size + 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def array(self, name: str, shard: int) -> np.ndarray | None:
        """A mapped array; None for a shard without rows, which has no file."""
        held = self.__dict__.setdefault("_held", {})
        if (name, shard) not in held:
            try:
                held[name, shard] = np.load(f"{self.folder}/{name}-{shard:06d}.npy", mmap_mode="r")
            except FileNotFoundError:
                held[name, shard] = None
        return held[name, shard]

    def _by_shard(self, keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
        """Runs of sorted keys by shard."""
        shards = _shard(keys, bits)
        cut = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True]) if len(keys) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(shards[a]), slice(int(a), int(b))

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes."""
        out = np.full(len(hashes), self.unknown, np.int64)
        for shard, run in self._by_shard(hashes, self.vocab_bits):
            known = self.array("vocab", shard)
            if known is not None:
                at, found = _find(known, hashes[run])
                out[run][found] = at[found] + self.offsets[shard]
        return out

    def by_id(self, name: str, ids: np.ndarray, width: int) -> np.ndarray:
        """Rows of a per-word array for sorted ids; zeros for ids that are no words."""
        out = np.zeros((len(ids), width), np.int64)
        shards = np.searchsorted(self.offsets, ids, "right") - 1
        for shard in np.unique(shards[ids < self.size]).tolist():
            mine = np.flatnonzero((shards == shard) & (ids < self.size))
            rows = self.array(name, shard)
            if rows is not None:
                out[mine] = rows[ids[mine] - self.offsets[shard]].reshape(-1, width)
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pair hashes."""
        out = np.zeros(len(keys), np.int64)
        for shard, run in self._by_shard(keys, self.pair_bits):
            known = self.array("pair", shard)
            if known is not None:
                at, found = _find(known, keys[run])
                count = self.array("pair_count", shard)[at[found]].astype(np.int64)
                big = np.flatnonzero(count == 255)
                if len(big):
                    place = self.array("pair_large", shard)
                    count[big] = place[1][np.searchsorted(place[0], at[found][big])]
                out[run][found] = count
        return out

    def score(self, hashes: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        """Sums per row over its tokens."""
        distinct, which = np.unique(hashes, return_inverse=True)
        ids = self.ids(distinct)
        order = np.argsort(ids, kind="stable")
        raw, lower = np.zeros(len(ids), np.int64), np.zeros((len(ids), 4), np.int64)
        raw[order] = self.by_id("count", ids[order], 1)[:, 0]
        lower[order] = self.by_id("lower", ids[order], 4)
        d, e = discounts(list(self.pair_counts)), discounts(list(self.lower_counts))
        v, n = self.size, self.n_tokens
        off = e[0] * self.lower_counts[0] + e[1] * self.lower_counts[1] + e[2] * self.lower_many
        unigram = (_minus(lower[:, 0], e) + off / (v + 1)) / self.n_pairs if self.n_pairs else np.full(len(ids), 1 / (v + 1))
        # the word before each token; texts begin with one of their own
        before = np.r_[np.int64(0), which[:-1] + 1]
        before[rows[:-1][rows[1:] > rows[:-1]]] = 0
        context_id = np.r_[self.begin, ids]
        total = np.r_[self.n_texts, raw]
        left = np.r_[[np.array(self.after_begin) @ d], lower[:, 1:] @ np.array(d)]
        packed = before.astype(np.int64) * len(ids) + which
        two, where = np.unique(packed, return_inverse=True)
        first, second = two // max(len(ids), 1), two % max(len(ids), 1)
        key = words.combine(context_id[first].astype(U64), ids[second].astype(U64))
        order = np.argsort(key)
        count = np.zeros(len(two), np.int64)
        count[order] = self.pairs(key[order])
        count[(ids[second] >= v) | (context_id[first] > v)] = 0
        t, back = total[first], unigram[second]
        p = np.where(t > 0, (_minus(count, d) + left[first] * back) / np.maximum(t, 1), back)
        base = np.log10((raw + 1) / (n + (v + 1)))
        return {
            "n_tokens": np.diff(rows), "n_known": words.sums((raw > 0)[which].astype(np.int64), rows),
            "base_score": words.sums(base[which], rows), "score": words.sums(np.log10(p)[where], rows),
        }


def _count_words(train: DataFrame, folder: str) -> tuple[int, list[int], int, int]:
    """Write the vocabulary; its bits, offsets, tokens and texts."""
    part = pa.schema([("h", pa.int64()), ("c", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for _, hashes, _ in sequences(many.column("text")):
                h, c = np.unique(hashes, return_counts=True)
                yield words.batch(part, h=h.view(np.int64), c=c)

    counted = checkpoint(train.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    seen = counted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("tokens")).first()
    bits = max(0, (max(seen["n"] // SHARD_WORDS, 0)).bit_length())
    made = pa.schema([("shard", pa.int64()), ("n", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("h").to_numpy().view(U64), b.column("c").to_numpy()) for b in batches]
        if not got:
            return
        h, c = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(h)
        h, c = h[order], c[order]
        shards = _shard(h, bits)
        for shard in np.unique(shards).tolist():
            mine = shards == shard
            _save(f"{folder}/vocab-{shard:06d}.npy", h[mine])
            _save(f"{folder}/count-{shard:06d}.npy", c[mine])
            yield words.batch(made, shard=[shard], n=[int(mine.sum())])

    # shiftrightunsigned by 64 is no shift, so one shard is put as a constant
    shard = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
    files = checkpoint(counted.repartitionById(1 << bits, shard.cast("int")).mapInArrow(write, "shard long, n long"))
    size = dict((r["shard"], r["n"]) for r in files.collect())
    offsets = np.r_[0, np.cumsum([size.get(s, 0) for s in range(1 << bits)])].tolist()
    return bits, offsets, int(seen["tokens"])


def pair_rows(packed: np.ndarray, count: np.ndarray, bits: int) -> pa.RecordBatch:
    """Counted pairs (``word id << 32 | next id``) as one row of ``PAIRS`` for each part of each shard."""
    first, second = packed >> 32, packed & 0xFFFFFFFF
    place = _shard(words.combine(first.astype(U64), second.astype(U64)), bits + PART_BITS)
    order = np.argsort(place, kind="stable")
    place = place[order]
    cut = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
    where = pa.py_buffer((4 * cut).astype(np.int32))
    arrays = [pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, where, pa.py_buffer(x[order].astype("<i4"))]) for x in (first, second, count)]
    place = place[cut[:-1]]
    return pa.RecordBatch.from_arrays([
        pa.array(place >> PART_BITS, pa.int32()), pa.array(place & ((1 << PART_BITS) - 1), pa.int64()), *arrays,
    ], names=["shard", "part", "a", "b", "c"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """``(shard, [ids, next ids, counts])`` for each part of each shard, from ``PAIRS`` in their order."""
    now, held = None, []
    for many in batches:
        place = np.stack([many.column(x).to_numpy().astype(np.int64) for x in ("shard", "part")], axis=1)
        if not len(place):
            continue
        columns = []
        for x in "abc":
            column = many.column(x)
            _, where, raw = column.buffers()
            columns.append((np.frombuffer(where, np.int32)[column.offset:column.offset + len(column) + 1] // 4, np.frombuffer(raw, "<i4")))
        cut = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]).any(1), True])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if now is not None and tuple(place[a]) != now:
                yield now[0], [np.concatenate(x).astype(np.int64) for x in zip(*held)]
                held = []
            now = tuple(place[a].tolist())
            held.append([values[at[a]:at[b]].copy() for at, values in columns])
    if held:
        yield now[0], [np.concatenate(x).astype(np.int64) for x in zip(*held)]


def merge_pairs(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Write the pairs of each shard; give for each word what is known of it here.

    ``PAIRS`` come ordered by shard and part, and parts are runs of the key's
    order, so only a part is held with its counts and of a shard its keys.
    """
    part = _schema(KNOWN)

    def write(shard: int, parts: list) -> None:
        key, count, large, big = (np.concatenate(x) for x in zip(*parts))
        _save(f"{folder}/pair-{shard:06d}.npy", key)
        _save(f"{folder}/pair_count-{shard:06d}.npy", count)
        _save(f"{folder}/pair_large-{shard:06d}.npy", np.stack([large, big]))

    shard, size, done = None, 0, []
    for now, (first, second, count) in _runs(batches):
        if now != shard:
            if done:
                write(shard, done)
            shard, size, done = now, 0, []
        packed, count = _totals(first << 32 | second, count)
        first, second = packed >> 32, packed & 0xFFFFFFFF
        key = words.combine(first.astype(U64), second.astype(U64))
        order = np.argsort(key)
        large = np.flatnonzero(count[order] >= 255)
        done.append((key[order], np.minimum(count[order], 255).astype(np.uint8), large + size, count[order][large]))
        size += len(key)
        follow = [_totals(first, (count == 1).astype(np.int64)), *(
            _totals(first, x.astype(np.int64)) for x in (count == 2, count > 2))]
        before, n_before = _totals(second, np.ones(len(second), np.int64))
        nothing = np.zeros(len(before), np.int64)
        yield words.batch(part, kind=nothing, id=before, a=n_before, b=nothing, c=nothing, d=nothing)
        ids = follow[0][0]
        nothing = np.zeros(len(ids), np.int64)
        yield words.batch(part, kind=nothing, id=ids, a=nothing, b=follow[0][1], c=follow[1][1], d=follow[2][1])
        yield words.batch(part, kind=[1], id=[-1], **{x: [int((count == k).sum())] for k, x in enumerate("abcd", 1)})
    if done:
        write(shard, done)


def write_words(batches: Iterator[pa.RecordBatch], folder: str, offsets: list[int]) -> Iterator[pa.RecordBatch]:
    """Write the per-word rows of each vocabulary shard; give the sums that the driver needs."""
    part, begin = _schema(KNOWN), offsets[-1]
    whole: dict[int, np.ndarray] = {}
    for many in batches:
        kind, ids = (many.column(x).to_numpy() for x in ("kind", "id"))
        values = np.stack([many.column(x).to_numpy() for x in "abcd"], axis=1)
        for i in np.flatnonzero((kind == 1) | (ids == begin)).tolist():
            yield words.batch(part, kind=[1 if kind[i] else 2], id=[0], **{x: [int(v)] for x, v in zip("abcd", values[i])})
        usual = (kind == 0) & (ids < begin)
        ids, values = ids[usual], values[usual]
        shards = np.searchsorted(offsets, ids, "right") - 1
        for shard in np.unique(shards).tolist():
            mine = shards == shard
            if shard not in whole:
                whole[shard] = np.zeros((offsets[shard + 1] - offsets[shard], 4), np.uint32)
            whole[shard][ids[mine] - offsets[shard]] = values[mine]
        a = values[:, 0]
        yield words.batch(part, kind=[3], id=[0], **{x: [int((a == k).sum())] for k, x in enumerate("abcd", 1)})
        yield words.batch(part, kind=[4], id=[0], a=[int((a > 2).sum())], b=[int(a.sum())], c=[0], d=[0])
    for shard, rows in whole.items():
        _save(f"{folder}/lower-{shard:06d}.npy", rows)


def train(rows: DataFrame) -> Model:
    """Count the ``text`` column of ``rows`` and write the model; the driver gets one number per shard."""
    spark = rows.sparkSession
    folder = shared.folder(spark, "kneser-ney")
    vocab_bits, offsets, n_tokens = _count_words(rows, folder)
    bits = (n_tokens // SHARD_TOKENS).bit_length()
    model = Model(folder, vocab_bits, offsets, bits, n_tokens)
    begin = model.begin
    if begin + 2 >= 1 << 31:
        raise ValueError("more than 2**31 distinct words: pair keys need wider ids")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct pairs of groups of texts, as one row of arrays per part of a shard."""
        held: list[np.ndarray] = []

        def groups() -> Iterator[pa.RecordBatch]:
            packed, count = np.unique(np.concatenate(held), return_counts=True)
            yield pair_rows(packed, count, bits)

        for many in batches:
            for _, hashes, bounds in sequences(many.column("text")):
                distinct, which = np.unique(hashes, return_inverse=True)
                now = model.ids(distinct)[which]
                before = np.r_[np.int64(begin), now[:-1]]
                before[bounds[:-1]] = begin
                held.append(before << 32 | now)
                if sum(map(len, held)) >= GROUP_TOKENS:
                    yield from groups()
                    held.clear()
        if held:
            yield from groups()

    place = F.when(F.col("id") < 0, 0)
    for shard in range(1 << vocab_bits):
        place = place.when(F.col("id") < offsets[shard + 1], shard)
    known = (
        rows.select("text").mapInArrow(pairs, PAIRS).repartitionById(1 << bits, "shard").sortWithinPartitions("shard", "part")
        .mapInArrow(lambda batches: merge_pairs(batches, folder), KNOWN).groupBy("kind", "id").agg(*[F.sum(x).alias(x) for x in "abcd"])
    )
    found = checkpoint(known.repartitionById(1 << vocab_bits, place.otherwise(0)).mapInArrow(
        lambda batches: write_words(batches, folder, offsets), KNOWN))
    sums = {r["kind"]: [r[x] for x in "abcd"] for r in found.groupBy("kind").agg(*[F.sum(x).alias(x) for x in "abcd"]).collect()}
    model.pair_counts = tuple(sums.get(1, (0,) * 4))
    model.after_begin = tuple(sums.get(2, (0,) * 4)[1:])
    model.lower_counts = tuple(sums.get(3, (0,) * 4))
    model.lower_many, model.n_pairs = sums.get(4, (0,) * 4)[:2]
    model.n_texts = rows.count()
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    names = [f.name for f in docs.select(*keep).schema]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    kinds += ["n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for first, hashes, rows in sequences(many.column("_text")):
                got = model.score(hashes, rows)
                n = len(rows) - 1
                got["train_tokens"] = np.full(n, model.n_tokens)
                yield pa.RecordBatch.from_arrays([
                    *(many.column(c).slice(first, n) for c in names),
                    *(pa.array(got[c]) for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score")),
                ], names=[*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(run, ", ".join(kinds))


def score_held_out(docs: DataFrame, held_out: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out`` and the scores of :func:`score`, from a model of the rows that aren't held out.

    A null ``held_out`` counts as false, so rows without an id are learned
    from. Null and empty texts are an end alone. Repeated rows count each time.
    Without training rows every score is 0 by word: one unseen word is all
    there is. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    return score(rows, train(rows.where(~F.col("held_out")).select("text")), ["doc_id", "held_out"])
