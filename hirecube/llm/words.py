"""Words of Arrow text columns as numpy spans and 64-bit hashes.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``; ``A-Z`` are
lower-cased where asked for and nothing else is changed. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = (1 << 20) - 1  # with the place after the last byte, a power of two

U64 = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered pair of hashes as one hash."""
    return mix(a * U64(_MULTIPLIER) + b)


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_MULTIPLIER))
_powers = np.ones(1, U64)
_inverse_powers = np.ones(1, U64)


def _grow(n: int) -> None:
    global _powers, _inverse_powers
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.r_[U64(1), np.full(n - 1, _MULTIPLIER, U64)])
            _inverse_powers = np.cumprod(np.r_[U64(1), np.full(n - 1, _INVERSE, U64)])


def prefixes(data: np.ndarray) -> np.ndarray:
    """Sums over the bytes before each place, from which ``hash_spans`` makes the hash of any span."""
    _grow(len(data) + 1)
    prefix = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers[:len(data)], out=prefix[1:])
    return prefix


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """Hash of ``data[start:end]`` for every span, by one prefix sum over the bytes (``prefixes``, made here if not given)."""
    if prefix is None:
        prefix = prefixes(data)
    with np.errstate(over="ignore"):
        own = (prefix[ends] - prefix[starts]) * _inverse_powers[starts]
    return mix(own ^ ((ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)))


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of whole rows of about ``size`` bytes; a longer row stands alone."""
    for array in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        if not len(array):
            continue
        array = pc.fill_null(array.cast(pa.large_string()), "")
        _, where, raw = array.buffers()
        offsets = np.frombuffer(where, np.int64)[array.offset:array.offset + len(array) + 1]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(array):
            last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
            last = min(max(last, first + 1), len(array))
            yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            first = last


def lower_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``chunks`` in lower case, with one chunk's copy in memory at a time."""
    for first, _, offsets in chunks(texts):
        part = pc.utf8_lower(pc.fill_null(texts.slice(first, len(offsets) - 1).cast(pa.large_string()), ""))
        for at, data, own in chunks(part, 1 << 62):
            yield first + at, data, own


def spans(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all runs without ``gaps``, and for each row the number of runs before it (one entry more than rows)."""
    inside = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, hashes of lower-cased words, words before each row)`` per chunk."""
    for first, data, offsets in chunks(texts, size):
        data = LOWER[data]
        starts, ends, rows = spans(data, offsets)
        yield first, hash_spans(data, starts, ends), rows


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, columns[f.name]) for f in schema)
    ], schema=schema)


def sums(values: np.ndarray, bounds: np.ndarray, how=np.add) -> np.ndarray:
    """``how`` folded over ``values[bounds[i]:bounds[i+1]]``; 0 for an empty run."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = how.reduceat(values, bounds[full], axis=0)
    return out
