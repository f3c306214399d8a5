"""Token ids in binary files, in document order.

A file: ``MAGIC``; the Simple-8b words of each block, little-endian; the footer
arrays (see ``FOOTER``); the footer's lengths; ``MAGIC`` again. Blocks hold
``block`` ids (the last one fewer), and the footer has the byte at which each
begins, so any block is decoded on its own. Documents follow one another
without gaps; the footer has their ids and lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube.llm import shared, simple8b, tokens, words
from hirecube.session import checkpoint

MAGIC = b"HCTOKS8B"
BLOCK_IDS = 1 << 16
# fixed values: the footer's arrays in order
FOOTER = (("block_at", "<u8"), ("block_ids", "<u8"), ("doc_id", "<i8"), ("doc_null", "u1"), ("doc_tokens", "<u8"))


class Writer:
    def __init__(self, out, block: int = BLOCK_IDS):
        self.out, self.block, self.at = out, block, len(MAGIC)
        self.rest: list[np.ndarray] = []
        self.waiting = 0
        self.footer: dict[str, list] = {name: [] for name, _ in FOOTER}
        out.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = simple8b.encode(ids).astype("<u8").tobytes()
        self.footer["block_at"].append(np.array([self.at]))
        self.footer["block_ids"].append(np.array([len(ids)]))
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: np.ndarray, null: np.ndarray, n_tokens: np.ndarray, ids: np.ndarray) -> None:
        for name, part in (("doc_id", doc_id), ("doc_null", null), ("doc_tokens", n_tokens)):
            self.footer[name].append(part)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            ids = np.concatenate(self.rest)
            full = len(ids) - len(ids) % self.block
            for first in range(0, full, self.block):
                self._put(ids[first:first + self.block])
            self.rest, self.waiting = [ids[full:].copy()], len(ids) - full

    def close(self) -> None:
        if self.waiting:
            self._put(np.concatenate(self.rest))
        sizes = []
        for name, kind in FOOTER:
            array = np.concatenate(self.footer[name] or [np.zeros(0)]).astype(kind)
            sizes.append(len(array))
            self.out.write(array.tobytes())
        self.out.write(np.array(sizes, "<u8").tobytes() + MAGIC)


class Reader:
    """Random access to a file by blocks, without reading the rest."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        n = len(FOOTER)
        if data[:8].tobytes() != MAGIC or data[-8:].tobytes() != MAGIC:
            raise ValueError(f"{path} is no token file")
        sizes = np.frombuffer(data[-8 - 8 * n:-8].tobytes(), "<u8").astype(np.int64)
        at = len(data) - 8 - 8 * n - sum(int(s) * np.dtype(k).itemsize for s, (_, k) in zip(sizes, FOOTER))
        self.end = at
        for size, (name, kind) in zip(sizes, FOOTER):
            stop = at + int(size) * np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(data[at:stop].tobytes(), kind))
            at = stop
        self.data = data

    def block(self, i: int) -> np.ndarray:
        stop = int(self.block_at[i + 1]) if i + 1 < len(self.block_at) else self.end
        return simple8b.decode(np.frombuffer(self.data[int(self.block_at[i]):stop].tobytes(), "<u8"), int(self.block_ids[i]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        rest, block = np.zeros(0, np.uint32), 0
        for doc, null, n in zip(self.doc_id.tolist(), self.doc_null.tolist(), self.doc_tokens.tolist()):
            parts = [rest]
            held = len(rest)
            while held < n:
                parts.append(self.block(block).astype("<u4"))
                held += len(parts[-1])
                block += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield None if null else doc, rest[:n]
            rest = rest[n:]


def write(
    docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, text: str = "text", doc_id: str = "doc_id",
    end_id: int = 0, block: int = BLOCK_IDS,
) -> DataFrame:
    """Encode every text, append ``end_id`` and write files in ascending id order; one row per file.

    Rows with a null id come first; null and empty texts are the end id alone;
    rows with the same id stand in the order of a hash of their text. An empty
    table may give no file. Other columns are not read. The result is
    ``(part, path, n_docs, n_tokens)``; parts are in document order.
    """
    spark = docs.sparkSession
    folder = folder or shared.folder(spark, "tokens")
    path = tokenizer or tokens.default_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("h"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}.s8b"
        total = [0, 0]

        def fill(out) -> None:
            to = Writer(out, block)
            for many in (b for source in ([first], batches) for b in source):
                keys = many.column("doc_id")
                null = keys.is_null().to_numpy(zero_copy_only=False)
                keys = keys.fill_null(0).to_numpy()
                for at, ids, bounds in tokens.encode(many.column("text"), path, end_id):
                    n = len(bounds) - 1
                    to.add(keys[at:at + n], null[at:at + n], np.diff(bounds), ids)
                    total[0] += n
                    total[1] += len(ids)
            to.close()

        shared.publish(name, fill)
        yield words.batch(schema, part=[part], path=[name], n_docs=[total[0]], n_tokens=[total[1]])

    return checkpoint(rows.select("doc_id", "text").mapInArrow(run, "part long, path string, n_docs long, n_tokens long"))


def read(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files that :func:`write` lists.

    ``start`` counts the ids of all documents before it. One task reads one
    file; only the files' lengths go through the driver.
    """
    spark = files.sparkSession
    listed = sorted(tuple(r) for r in files.select("part", "path", "n_tokens").collect())
    starts = np.r_[0, np.cumsum([n for *_, n in listed])].tolist()
    places = [(path, int(start)) for (_, path, _), start in zip(listed, starts)]
    todo = spark.createDataFrame(places, "path string, start long").repartition(max(1, len(places)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for one in many.to_pylist():
                at, out = one["start"], []
                for doc, ids in Reader(one["path"]).documents():
                    out.append((doc, at, len(ids), zlib.crc32(np.ascontiguousarray(ids))))
                    at += len(ids)
                    if len(out) == 10_000:
                        yield words.batch(schema, **dict(zip(schema.names, zip(*out))))
                        out = []
                if out:
                    yield words.batch(schema, **dict(zip(schema.names, zip(*out))))

    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write the files and read them back."""
    return read(write(docs, **options))
