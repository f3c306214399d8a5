"""Packing documents into windows of tokens that hold the sources in target proportions.

Each source is a queue of its documents' tokens. A round robin with deficits
fills every window: the next token comes from the queue that is furthest behind
its share, a deficit that goes on from window to window. With ``m`` of ``M``
tokens due to a queue, its token ``j`` falls due at ``(2j + 1) M / 2m``, and
windows take the tokens by due time, ties by queue. What a queue has served
before any window, so the deficit that it carries there, follows from that
alone. Every task therefore goes on with the right deficits wherever in the
queues its documents stand, and no row is moved.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirecube.llm import tokens, words
from hirecube.operators.joins import lookup_join
from hirecube.session import checkpoint, scratch_path

LENGTH = 1024


@dataclass
class Phase:
    """Windows over which each queue serves ``due`` tokens evenly, from ``begins`` on."""

    first_window: int
    due: list[int]
    begins: list[int]
    length: int

    def __post_init__(self):
        self.total = sum(self.due)
        self.windows = -(-self.total // self.length)
        small = 2 * max(self.due, default=0) * (self.total + len(self.due) + 2) + self.total < 1 << 62
        self.kind = np.int64 if small else object  # exact whole numbers of any size
        self._due = np.array(self.due, self.kind)

    def before(self, time: np.ndarray) -> np.ndarray:
        """Tokens of each queue that fall due before each time (times down, queues across)."""
        due = np.minimum((2 * self._due * time[:, None] + self.total - 1) // (2 * self.total), self._due)
        return np.maximum(due, 0)

    def served(self, windows: np.ndarray) -> np.ndarray:
        """Tokens of each queue in all windows before each of ``windows``."""
        count = np.minimum(windows.astype(self.kind) * self.length, self.total)
        low, high = count - len(self.due) - 1, count + len(self.due) + 1
        low = np.maximum(low, 0)
        while (low < high).any():  # the last time before which no more than ``count`` fall due
            middle = (low + high + 1) // 2
            fits = self.before(middle).sum(axis=1) <= count
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        begun = self.before(low)
        at_once = self.before(low + 1) - begun
        left = (count - begun.sum(axis=1))[:, None]
        ahead = np.cumsum(at_once, axis=1) - at_once
        return (begun + np.minimum(np.maximum(left - ahead, 0), at_once)).astype(np.int64)

    def near(self, queue: int, first: int, last: int) -> tuple[int, int]:
        """Windows that hold all tokens of a queue from ``first`` to ``last``, and perhaps some more."""
        m, margin = self.due[queue], len(self.due) + 2
        low = ((2 * first + 1) * self.total // (2 * m) - margin) // self.length
        high = ((2 * last + 1) * self.total // (2 * m) + margin) // self.length + 1
        return max(0, low), min(self.windows, high)


def schedule(totals: list[int], weights: list[float] | None = None, length: int = LENGTH) -> list[Phase]:
    """Phases that serve all queues; when one runs dry the others share its place by weight.

    Without weights the target is what the queues hold, and one phase serves all.
    """
    if not sum(totals):
        return []
    if weights is None:
        return [Phase(0, list(totals), [0] * len(totals), length)]
    left, phases, window = list(totals), [], 0
    while sum(left) > 0:
        whole = sum(w for w, n in zip(weights, left) if n)
        share = [w / whole * length if n and whole else 0.0 for w, n in zip(weights, left)]
        fit = min((int(n // s) for n, s in zip(left, share) if s > 0), default=0)
        count = max(1, min(fit, sum(left) // length))
        room = min(count * length, sum(left))
        due = [min(n, int(s * count)) for n, s in zip(left, share)]
        # what rounding and queues running dry leave open goes to the queues with most room by weight
        for i in sorted(range(len(left)), key=lambda i: (-(share[i] * count - due[i]), i)):
            if sum(due) < room and due[i] < left[i] and share[i] > 0 and fit:
                due[i] += 1
        for i in sorted(range(len(left)), key=lambda i: (-weights[i], i)):
            due[i] += min(left[i] - due[i], room - sum(due))
        phases.append(Phase(window, due, [t - n for t, n in zip(totals, left)], length))
        left = [n - d for n, d in zip(left, due)]
        window += count
    return phases


def _cut_tail(offset: int, size: int, whole: int) -> Iterator[tuple[int, int, int, int]]:
    """``(sequence, its offset, begin, size)`` of a piece when a short window is cut into powers of two."""
    at, sequence = 0, 0
    while at < whole:
        power = 1 << ((whole - at).bit_length() - 1)
        low, high = max(offset, at), min(offset + size, at + power)
        if low < high:
            yield sequence, low - at, low - offset, high - low
        at, sequence = at + power, sequence + 1


def pieces(phases: list[Phase], queue: int, start: np.ndarray, size: np.ndarray):
    """``(row, start in the row, length, sequence, offset)`` of the pieces of rows at ``start`` in a queue."""
    out = []
    for phase in phases:
        low = np.maximum(start, phase.begins[queue]) - phase.begins[queue]
        high = np.minimum(start + size, phase.begins[queue] + phase.due[queue]) - phase.begins[queue]
        rows = np.flatnonzero(low < high)
        if not len(rows):
            continue
        low, high = low[rows], high[rows]
        k0, k1 = phase.near(queue, int(low.min()), int(high.max()) - 1)
        served = phase.served(np.arange(k0, k1 + 1))
        own = served[:, queue]
        ahead = (served[1:, :queue] - served[:-1, :queue]).sum(axis=1)  # what other queues have in the window before this one
        first, last = (np.searchsorted(own, x, "right") - 1 for x in (low, high - 1))
        count = last - first + 1
        row = np.repeat(np.arange(len(rows)), count)
        k = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin, end = np.maximum(low[row], own[k]), np.minimum(high[row], own[k + 1])
        full = begin < end
        row, k, begin, end = row[full], k[full], begin[full], end[full]
        base = phase.begins[queue] - start[rows][row]
        part = np.stack([rows[row], begin + base, end - begin, phase.first_window + k0 + k, ahead[k] + begin - own[k]], axis=1)
        short = phase.total - (phase.windows - 1) * phase.length
        if short < phase.length:
            tail = part[:, 3] == phase.first_window + phase.windows - 1
            cut = [
                (r, s + b, n, w + i, o)
                for r, s, size_, w, off in part[tail].tolist() for i, o, b, n in _cut_tail(off, size_, short)
            ]
            part = np.concatenate([part[~tail], np.array(cut, np.int64).reshape(-1, 5)])
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def tokenize(docs: DataFrame, tokenizer: str | None, text: str, source: str, doc_id: str, end_id: int) -> DataFrame:
    """A written table: each document's ids, its queue's name within the partition, and the tokens before it there."""
    spark = docs.sparkSession
    path = tokenizer or tokens.default_path()
    schema = pa.schema([
        ("queue", pa.string()), ("part", pa.int64()), ("source", pa.string()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()),
        ("ahead", pa.int64()), ("ids", pa.large_binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, passed = TaskContext.get().partitionId(), {}
        for many in batches:
            for at, ids, bounds in tokens.encode(many.column("text"), path, end_id):
                n, size = len(bounds) - 1, np.diff(bounds)
                names = many.column("source").slice(at, n).to_pylist()
                ahead = []
                for name, count in zip(names, size.tolist()):
                    ahead.append(passed.get(name, 0))
                    passed[name] = ahead[-1] + count
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield words.batch(
                    schema, queue=[f"{part}:" if x is None else f"{part}={x}" for x in names], part=np.full(n, part), source=names,
                    doc_id=many.column("doc_id").slice(at, n), doc_tokens=size, ahead=ahead, ids=raw)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    kinds = "queue string, part long, source string, doc_id long, doc_tokens long, ahead long, ids binary"
    place = scratch_path(spark, "packing")
    rows.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(place)
    return spark.read.schema(kinds).parquet(place)


def pack(
    docs: DataFrame, weights: dict[str | None, float] | None = None, length: int = LENGTH, tokenizer: str | None = None,
    text: str = "text", source: str = "source", doc_id: str = "doc_id", end_id: int = 0,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    ``weights`` are target proportions by source (others 0, served last); without
    them every window gets the corpus's own proportions, so all queues run dry
    together. Sequences have ``length`` tokens, but for the last window of all,
    which is cut into sequences of powers of two. A null source is a queue of
    its own; null and empty texts are their end id; null and repeated ids pass
    through; an empty table gives an empty result. Other columns are not read.
    The driver holds one number per source.
    """
    table = tokenize(docs, tokenizer, text, source, doc_id, end_id)
    held = checkpoint(table.groupBy("queue", "part", "source").agg(F.sum("doc_tokens").alias("n")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = checkpoint(held.select("queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")))
    per_source = held.groupBy("source").agg(F.sum("n").alias("n")).collect()
    per_source = sorted(((r["source"], r["n"]) for r in per_source), key=lambda r: (r[0] is None, r[0] or ""))
    number = {name: i for i, (name, _) in enumerate(per_source)}
    phases = schedule(
        [n for _, n in per_source], weights and [float(weights.get(name, 0.0)) for name, _ in per_source], length)
    schema = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            sources = many.column("source")
            queue = np.array([number[x] for x in sources.to_pylist()], np.int64)
            size = many.column("doc_tokens").to_numpy()
            start = many.column("ahead").to_numpy() + many.column("base").to_numpy()
            ids = many.column("ids")
            _, where, raw = ids.buffers()
            wide = pa.types.is_large_binary(ids.type)
            byte = np.frombuffer(where, np.int64 if wide else np.int32)[ids.offset:ids.offset + len(ids) + 1].astype(np.int64)
            found = []
            for q in np.unique(queue).tolist():
                rows = np.flatnonzero(queue == q)
                got = pieces(phases, q, start[rows], size[rows])
                got[:, 0] = rows[got[:, 0]]
                found.append(got)
            found = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
            row = found[:, 0]
            low = byte[row] + 4 * found[:, 1]
            view = memoryview(raw) if raw is not None else memoryview(b"")
            crc = [zlib.crc32(view[a:b]) for a, b in zip(low.tolist(), (low + 4 * found[:, 2]).tolist())]
            where = pa.array(row)
            yield words.batch(
                schema, doc_id=many.column("doc_id").take(where), start=found[:, 1], length=found[:, 2],
                ids_crc32=np.array(crc, np.int64), doc_tokens=size[row], sequence_id=found[:, 3], offset=found[:, 4],
                source=sources.take(where))

    placed = lookup_join(table, base, "queue", spread_by=["doc_id", "ahead"])
    return placed.select("doc_id", "source", "doc_tokens", "ahead", "base", "ids").mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
