"""Token ids of Arrow text columns with a tokenizer file of the ``tokenizers`` library.

Byte-level BPE first cuts a text by a pattern none of whose matches runs from
a character that isn't white space into one that is, or from a letter into
punctuation. A text may therefore be cut there as well, and the parts encoded
one by one. Parts recur, so each is given to the library once per worker
process and its ids are kept, in sorted arrays, by the part's 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from hirecube.llm import words

MAX_KEPT = 3_000_000
MAX_IDS = 1 << 24  # ids kept, where parts are long
DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_TOKENIZER)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the parts, and for each row the number of parts before it (one entry more than rows).

    Cuts stand before ASCII white space after a printing ASCII character or after the
    end of a longer character that cannot be one of Unicode's white space, and
    before ASCII punctuation after an ASCII letter.
    """
    n = len(data)
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    space, plain = words.SPACE[data], (data > 0x20) & (data < 0x7F)
    cut = np.zeros(n + 1, bool)
    digit = (data >= 0x30) & (data <= 0x39)
    cut[1:n] = (space[1:] & plain[:-1]) | (letter[:-1] & (plain & ~letter & ~digit)[1:])
    high = np.flatnonzero(space[1:] & (data[:-1] >= 0x80)) + 1  # the character before ends at high - 1
    lead2, lead3 = data[np.maximum(high - 2, 0)], data[np.maximum(high - 3, 0)]
    cut[high] = (lead2 != 0xC2) & ~np.isin(lead3, (0xE1, 0xE2, 0xE3))
    cut[offsets] = True
    cut[n] = False
    starts = np.flatnonzero(cut[:n])
    ends = np.r_[starts[1:], n] if n else starts
    return starts, ends, np.searchsorted(starts, offsets)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.clear()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return cuts(data, offsets)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.keys, self.first, self.size = np.zeros(0, words.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def keep(self, keys: np.ndarray, texts: list[str]) -> None:
        made = self.encode(texts)
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.r_[self.pool, np.zeros(len(self.pool), np.uint32)]
        self.pool[self.used:self.used + len(flat)] = flat
        first = self.used + np.cumsum(size) - size
        self.used += len(flat)
        order = np.argsort(np.r_[self.keys, keys], kind="stable")
        self.keys, self.first, self.size = (
            np.r_[old, new][order] for old, new in ((self.keys, keys), (self.first, first), (self.size, size)))

    def missing(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        return np.flatnonzero(~known)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some rows in order, and where each row's begin (one entry more than rows)."""
        starts, ends, rows = self.cuts(data, offsets)
        keys = words.hash_spans(data, starts, ends)
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        new = self.missing(distinct)
        if len(self.keys) + len(new) > MAX_KEPT or self.used > MAX_IDS:
            self.clear()
            new = np.arange(len(distinct))
        if len(new):
            raw, a, b = data.tobytes(), starts[where[new]].tolist(), ends[where[new]].tolist()
            self.keep(distinct[new], [raw[i:j].decode("utf-8", "replace") for i, j in zip(a, b)])
        slot = np.searchsorted(self.keys, distinct)[which]
        size, first = self.size[slot], self.first[slot]
        begin = np.r_[0, np.cumsum(size)]
        ids = self.pool[np.repeat(first - begin[:-1], size) + np.arange(begin[-1])]
        return ids, begin[rows]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's encoder for a tokenizer file."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(texts: pa.Array, path: str, end_id: int | None):
    """``(first row, ids, where each row begins)`` per chunk of rows; ``end_id`` follows every row."""
    own = encoder(path)
    for first, data, offsets in words.chunks(texts):
        ids, bounds = own.chunk(data, offsets)
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        yield first, ids, bounds
