"""Language identification with a blended-spectrum string kernel.

A text is the set of its byte n-grams of 1 to 3 bytes in lower case, hashed
into ``BUCKETS``. The kernel of two texts is the number of n-grams present in
both over the root of the product of their numbers. Landmarks give a Nyström
map; kernel ridge regression on it tells each language from the rest. As the
kernel is a product of presence vectors, landmarks and coefficients multiply
out to one matrix, and batches of texts are scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirecube.llm import samples, words

UNDETERMINED = "und"
LENGTHS = (1, 2, 3)
BUCKETS = 1 << 15
SAMPLE = 2400
LANDMARKS = 256
RIDGE = 1e-3
ROWS = 128


def presence(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(first row, presence of every bucket)`` for groups of at most ``ROWS`` rows."""
    shift = words.U64(64 - int(BUCKETS).bit_length() + 1)
    for at, data, offsets in words.lower_chunks(texts):
        wide = data.astype(np.uint32)
        grams = []
        for n in LENGTHS:
            code = np.full(max(len(data) - n + 1, 0), n, np.uint32)
            for j in range(n):
                code = (code << np.uint32(8)) | wide[j:len(data) - n + 1 + j] if n < 4 else code
            grams.append(((code.astype(words.U64) * words.U64(0x9E3779B97F4A7C15)) >> shift).astype(np.uint16 if BUCKETS <= 1 << 16 else np.int64))
        for first in range(0, len(offsets) - 1, ROWS):
            last = min(first + ROWS, len(offsets) - 1)
            out = np.zeros((last - first, BUCKETS), bool)
            for row, (a, b) in enumerate(zip(offsets[first:last].tolist(), offsets[first + 1:last + 1].tolist())):
                for n, gram in zip(LENGTHS, grams):
                    if b - a >= n:
                        out[row, gram[a:b - n + 1]] = True
            yield at + first, out


def unpack(rows: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.unpackbits(x, count=BUCKETS) for x in rows])


def unit(present: np.ndarray) -> np.ndarray:
    x = present.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x


def nystrom(marks: np.ndarray) -> np.ndarray:
    """What maps kernel values with the landmarks to features."""
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * max(values.max(), 1e-12)
    return vectors[:, keep] / np.sqrt(values[keep])


@dataclass
class Classifier:
    classes: list[str]
    weights: np.ndarray  # buckets by classes
    bias: np.ndarray

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
        """From packed presence vectors and their labels, in an order that does not depend on the labels."""
        classes = sorted(set(labels))
        if not classes:
            return cls([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
        # landmarks are taken from the classes in turn
        turn: dict[str, int] = {}
        place = []
        for label in labels:
            turn[label] = turn.get(label, -1) + 1
            place.append(turn[label])
        chosen = np.lexsort((np.arange(len(labels)), place))[:landmarks]
        marks = unit(unpack([rows[i] for i in chosen]))
        root = nystrom(marks)
        phi = np.concatenate([unit(unpack(rows[a:a + ROWS])) @ marks.T for a in range(0, len(rows), ROWS)]) @ root
        phi = np.c_[phi, np.ones(len(phi))]
        target = np.where(np.array(labels)[:, None] == np.array(classes)[None], 1.0, -1.0)
        return cls.solve(classes, marks, root, phi.T @ phi, phi.T @ target, len(phi), ridge)

    @classmethod
    def solve(cls, classes, marks, root, gram, moment, n: int, ridge: float = RIDGE) -> Classifier:
        """From the normal equations of ``n`` mapped rows."""
        penalty = ridge * n * np.eye(len(gram))
        penalty[-1, -1] = 0
        alpha = np.linalg.solve(gram + penalty, moment)
        return cls(classes, (marks.T @ (root @ alpha[:-1])).astype(np.float32), alpha[-1])

    def predict(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers, and their parts of the positive margins of all classes."""
        size = np.sqrt(np.maximum(present.sum(axis=1), 1))
        margin = (present.astype(np.float32) @ self.weights) / size[:, None] + self.bias
        part = np.clip((margin + 1) / 2, 1e-6, 1)
        best = margin.argmax(axis=1)
        return best, part[np.arange(len(best)), best] / part.sum(axis=1)


def _bits(rows: DataFrame) -> DataFrame:
    """``lang, draw, bits``: the packed presence vector of each ``text``."""
    schema = pa.schema([("lang", pa.string()), ("draw", pa.int64()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for first, out in presence(many.column("text")):
                bits = np.packbits(out, axis=1)
                yield words.batch(
                    schema, lang=many.column("lang").slice(first, len(out)), draw=many.column("draw").slice(first, len(out)),
                    bits=[b.tobytes() for b in bits])

    return rows.select("lang", "text", "draw").mapInArrow(run, "lang string, draw long, bits binary")


def fit(rows: DataFrame, draw: Column, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Classifier:
    """From ``text`` and ``lang`` of at most ``sample`` rows, as many of each language, drawn by hash.

    Rows without a language or without a letter teach nothing. The n-gram sets
    are made by many tasks and the model by one, from one bit per bucket and row.
    """
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", draw.alias("draw"))
    chosen = samples.by_class(usable, "lang", F.col("draw"), sample)

    def classifier(got: list[dict]) -> Classifier:
        got.sort(key=lambda r: (r["draw"], r["lang"], r["bits"]))
        return Classifier.fit([np.frombuffer(r["bits"], np.uint8) for r in got], [r["lang"] for r in got], landmarks)

    return samples.fit_in_task(_bits(chosen), classifier)


def fit_all(rows: DataFrame, draw: Column, shard: Column, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """From ``text`` and ``lang`` of all rows, both of them not null.

    The landmarks, which are the feature map and not what is learned, are about
    ``landmarks`` rows, as many of each language, drawn by hash. The normal
    equations are sums over all rows, one part per partition; ``shard`` numbers
    the partitions.
    """
    marked = rows.select("lang", "text", draw.alias("draw"), shard.cast("int").alias("shard"))
    chosen = _bits(samples.by_class(marked, "lang", F.col("draw"), landmarks)).toArrow().to_pylist()
    chosen.sort(key=lambda r: (r["draw"], r["lang"], r["bits"]))
    if not chosen:
        return Classifier.fit([], [])
    classes = sorted({r["lang"] for r in chosen})
    bits = [np.frombuffer(r["bits"], np.uint8) for r in chosen]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, total, n, at = None, 0.0, 0, 0
        for many in batches:
            if not many.num_rows:
                continue
            if marks is None:
                marks = np.ascontiguousarray(unit(unpack(bits)).T)
            at = many.column("shard")[0].as_py()
            target = np.where(np.array(many.column("lang").to_pylist(), object)[:, None] == np.array(classes, object)[None], 1.0, -1.0)
            for first, out in presence(many.column("text")):
                kernel = np.c_[unit(out) @ marks, np.ones(len(out))].astype(np.float64)
                total = total + kernel.T @ np.c_[kernel, target[first:first + len(out)]]
                n += len(out)
        if marks is not None:
            yield samples.pieces(at, {**dict(enumerate(np.array_split(total, 16))), -1: np.array([n])}, np.float64)

    sums = samples.summed(marked.mapInArrow(run, samples.PIECES), np.float64)
    marks = unit(unpack(bits))
    root = nystrom(marks)
    wide = len(marks) + 1
    total = np.concatenate([sums[b] for b in range(16) if b in sums]).reshape(wide, -1)
    turn = np.zeros((wide, root.shape[1] + 1))  # from kernel values and 1 to features and 1
    turn[:-1, :-1], turn[-1, -1] = root, 1
    return Classifier.solve(classes, marks, root, turn.T @ total[:, :wide] @ turn, turn.T @ total[:, wide:], int(sums[-1][0]), ridge)


def predict(docs: DataFrame, model: Classifier, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score`` of every row; ``und`` and 0 for texts without a letter."""
    kept = docs.select(*keep).schema
    names = kept.names
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double"]
    classes = np.array([*model.classes, UNDETERMINED], object)
    source = text if text in names else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            letters = many.column("_letters").to_numpy(zero_copy_only=False)
            for first, out in presence(many.column(source)):
                n = len(out)
                known = letters[first:first + n].astype(bool) & bool(model.classes)
                best, part = np.full(n, len(classes) - 1), np.zeros(n)
                if known.any():
                    best[known], part[known] = model.predict(out[known])
                yield pa.RecordBatch.from_arrays(
                    [*(many.column(c).slice(first, n) for c in names), pa.array(classes[best], pa.string()), pa.array(part)],
                    names=[*names, "lang_pred", "score"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    # a text that is kept is sent once
    more = [] if source == text else [F.col(text).alias(source)]
    return docs.select(*keep, *more, letters.alias("_letters")).mapInArrow(run, ", ".join(kinds))


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, learned from rows that aren't held out.

    A null ``held_out`` counts as false. Predictions see the text alone. Null
    texts and texts without a letter are ``und`` with score 0, and so is every
    text when no row can teach. Null and repeated ids pass through; an empty
    table gives an empty result. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"),
        F.col(lang).cast("string").alias("lang"))
    model = fit(rows.where(~F.col("held_out")), F.xxhash64(F.lit(4), "doc_id", "text"), sample)
    return predict(rows, model, ["doc_id", "held_out"])
