"""Cross-tokenizer alignment of two tokenizations of each text by galloping intersection of token ends.

Tokenization A is byte-level BPE of a space and the text; B is a sentencepiece
model, which adds the space itself. Strings of special tokens are plain text.
A token's bytes are, for A, its vocabulary entry mapped back through the
byte-level alphabet and, for B, its piece in UTF-8 with U+2581 read as a space
and ``<0xHH>`` as the byte HH. Where the joined bytes of either side differ from
the space and the text's UTF-8, the text has no tokens.

Tokens of either side are found part by part, each distinct part once per
worker process (see ``tokens``): A's parts end where its pattern must, B's
before a space that follows another character, which no piece of B runs over.

The byte offsets where tokens end on each side, over all texts of a chunk, are
increasing lists; the shorter drives an exponential-then-binary (galloping)
search into the longer, and the common offsets, by their indices on both sides,
cut the tokens into groups. Texts end at common offsets, so no group holds two
texts. An A token overlaps the B tokens from the number of B ends at or
before its start to the number of B starts before its end: a difference of
ranks. Corpus-wide, the number of documents that hold each linked pair of ids
comes from one partially aggregated count; each document then sums over its
distinct pairs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube.llm import tokens, words
from hirecube.session import checkpoint

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
B_BITS = 16  # a pair key is a << B_BITS | b
ROW_BITS = 40  # within a chunk, a pair key of a row is row << ROW_BITS | key
CHUNK_CHARS = words.CHUNK_BYTES  # about as many characters (bytes, in UTF-8) are aligned at once by a worker
BLOCK = 8  # values of a list that gallop from where the first of them was found

_TOKENS = pa.schema([
    ("_row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("keys", pa.list_(pa.int64())), ("mults", pa.list_(pa.int64())),
])

_SPARK = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<bigint>, mults array<bigint>"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_level_alphabet() -> dict[str, int]:
    """The byte-level BPE alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, extra = {}, 0
    for b in range(256):
        if b in shown:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum(lengths)].astype(np.int64)


@functools.lru_cache(maxsize=4)
def tokenizers(a_path: str, b_path: str):
    """Both tokenizers and each one's token bytes as one buffer with offsets, once per worker process."""
    import json

    import sentencepiece

    a = tokens.encoder(a_path).tokenizer
    alphabet = _byte_level_alphabet()
    vocab = json.load(open(a_path, encoding="utf-8"))["model"]["vocab"]
    a_pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        a_pieces[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    b_pieces = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            b_pieces.append(bytes([int(piece[3:5], 16)]))
        else:
            b_pieces.append(piece.replace("▁", " ").encode())
    return a, b, _table(a_pieces), _table(b_pieces)


class PieceEncoder(tokens.Encoder):
    """Ids of a sentencepiece model for texts that begin with the space the model adds."""

    def __init__(self, model):
        self.model = model
        pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)  # such a piece could run over a cut
        self.clear()

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows are cut before a space after another character, but not before a row's last one: alone it would be lost."""
        cut = np.zeros(len(data) + 1, bool)
        if not self.whole:
            space = data == 0x20
            cut[1:-1] = space[1:] & ~space[:-1]
            cut[offsets[1:] - 1] = False
        cut[offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        return starts, np.r_[starts[1:], len(data)] if len(data) else starts, np.searchsorted(starts, offsets)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


@functools.lru_cache(maxsize=4)
def _side_by_side(a_path: str, b_path: str):
    """Both encoders, each one's token bytes, and the text of each token in a group.

    That of A's id ``i`` is at ``2 * i``, with a comma after it, or at ``2 * i + 1``
    with ``|``; B's follow A's, with a comma or ``;``.
    """
    _, b, *tables = tokenizers(a_path, b_path)
    pieces = [pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)]) for flat, offsets in tables]
    shown = [f"{i}{end}" for table, ends in zip(pieces, (",|", ",;")) for i in range(len(table)) for end in ends]
    return tokens.encoder(a_path), PieceEncoder(b), *pieces, pa.array(shown, pa.large_string())


def _taken(table: pa.Array, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``table``'s values at ``index`` one after another, and where each begins (one entry more)."""
    got = table.take(pa.array(index))
    _, where, raw = got.buffers()
    offsets = np.frombuffer(where, np.int64)[got.offset:got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[offsets[0]:offsets[-1]], offsets - offsets[0]


def _ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For every value of ``short`` the number of values of ``long`` below it, by galloping.

    The first value of each block of ``BLOCK`` is placed first, in the same way;
    all others gallop from there at once: probes at 1, 3, 7, ... places, until
    one is not below the value, then a binary search between the last two probes.
    """
    n = len(long)
    # long[low - 1] < x is known
    low = np.repeat(_ranks(short[::BLOCK], long), BLOCK)[:len(short)] if len(short) > BLOCK else np.zeros(len(short), np.int64)
    high = np.full(len(short), n, np.int64)  # long[high] >= x, or high = n
    at = np.arange(len(short))
    step = 1
    while len(at):
        probe = np.minimum(low[at] + step - 1, n - 1)
        below = long[probe] < short[at]
        low[at[below]] = probe[below] + 1
        high[at[~below]] = probe[~below]
        at = at[below & (probe < n - 1)]
        step *= 2
    at = np.flatnonzero(low < high)
    while len(at):
        mid = (low[at] + high[at]) // 2
        below = long[mid] < short[at]
        low[at[below]] = mid[below] + 1
        high[at[~below]] = mid[~below]
        at = at[low[at] < high[at]]
    return low


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``short`` and ``long`` (both strictly increasing) of their common values."""
    n = len(long)
    if not len(short) or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _ranks(short, long)
    hit = (low < n) & (long[np.minimum(low, n - 1)] == short)
    return np.flatnonzero(hit), low[hit]


def _without(rows: np.ndarray, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``values`` and ``bounds`` with nothing in the marked rows."""
    size = np.diff(bounds)
    return values[np.repeat(~rows, size)], np.r_[0, np.cumsum(np.where(rows, 0, size))]


def align(data: np.ndarray, offsets: np.ndarray, a_path: str, b_path: str) -> dict[str, np.ndarray | list | pa.Array]:
    """The columns of ``_TOKENS`` from ``n_a`` on for rows of ``data``, a space and a text each."""
    a_encoder, b_encoder, a_pieces, b_pieces, shown = _side_by_side(a_path, b_path)
    sides = [(*a_encoder.chunk(data, offsets), a_pieces), (*b_encoder.chunk(data, offsets), b_pieces)]
    # rows without text, and rows whose bytes a side doesn't give back, in length and then in value
    size = np.diff(offsets)
    bad = size <= 1
    for ids, bounds, pieces in sides:
        ends = np.r_[0, np.cumsum(pc.binary_length(pieces).to_numpy()[ids])]
        bad |= np.diff(ends[bounds]) != size
    while True:
        if bad.any():
            sides = [(*_without(bad, ids, bounds), pieces) for ids, bounds, pieces in sides]
            data, offsets = _without(bad, data, offsets)
        joined = [_taken(pieces, ids) for ids, _, pieces in sides]
        wrong = np.flatnonzero((joined[0][0] != data) | (joined[1][0] != data))
        if not len(wrong):
            break
        bad = np.zeros(len(offsets) - 1, bool)
        bad[np.searchsorted(offsets, wrong, "right") - 1] = True
    (a, a_rows, _), (b, b_rows, _) = sides
    a, b = a.astype(np.int64), b.astype(np.int64)
    (a_starts, a_ends), (b_starts, b_ends) = ((at[:-1], at[1:]) for _, at in joined)
    if len(a) <= len(b):
        ia, ib = gallop(a_ends, b_ends)
    else:
        ib, ia = gallop(b_ends, a_ends)
    # every token once, A's of a group before B's; after each a comma, or the group's '|' or ';'
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[ia], last_b[ib] = 1, 1
    text = np.zeros(len(a) + len(b), np.int64)
    text[np.arange(len(a)) + np.r_[0, ib + 1][np.cumsum(last_a) - last_a]] = 2 * a + last_a
    text[np.arange(len(b)) + (ia + 1)[np.cumsum(last_b) - last_b]] = 2 * (len(a_pieces) + b) + last_b
    raw, at = _taken(shown, text)
    at = at[a_rows + b_rows]
    raw = memoryview(raw)
    digests = [hashlib.sha256(raw[i:j - 1]).hexdigest() if i < j else "" for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    first = np.searchsorted(b_ends, a_starts, "right")
    span = np.searchsorted(b_starts, a_ends, "left") - first
    which = np.repeat(np.arange(len(a)), span)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(span) - span, span)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(a_rows)) << ROW_BITS
    pairs = (row | (a << B_BITS))[which] | b[first[which] + inner]
    pairs.sort()
    new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][:len(pairs)])
    distinct, bounds = pairs[new], np.zeros(len(offsets), np.int32)
    np.cumsum(np.bincount(distinct >> ROW_BITS, minlength=len(offsets) - 1), out=bounds[1:])
    lists = pa.array(bounds)
    return {
        "n_a": np.diff(a_rows), "n_b": np.diff(b_rows), "n_groups": words.sums(last_a, a_rows), "n_links": words.sums(span, a_rows),
        "groups_sha256": digests, "keys": pa.ListArray.from_arrays(lists, pa.array(distinct & ((1 << ROW_BITS) - 1))),
        "mults": pa.ListArray.from_arrays(lists, pa.array(np.diff(np.r_[new, len(pairs)]))),
    }


def _tokens(a_path: str, b_path: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
            for first, data, offsets in words.chunks(spaced, chunk_chars):
                some = batch.slice(first, len(offsets) - 1)
                yield words.batch(_TOKENS, _row=some.column("_row"), doc_id=some.column("doc_id"), **align(data, offsets, a_path, b_path))
    return run


def alignment(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", a_path: str | None = None, b_path: str | None = None,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    Null and empty texts, and texts that a tokenizer does not give back byte for
    byte, have no tokens: zeros and ``groups_sha256`` ''. Each row is a
    document, repeated rows too, so a pair held by two equal rows counts twice.
    ``n_best`` counts links whose pair count is the highest of its A id
    corpus-wide, ties included; ``count_sum`` sums the pair counts over links.
    Only ``doc_id`` and ``text`` are read. An empty table gives an empty result.
    """
    a_path, b_path = a_path or tokenizer_path(A_FILE), b_path or tokenizer_path(B_FILE)
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    per = checkpoint(rows.mapInArrow(_tokens(a_path, b_path, chunk_chars), _SPARK))
    pairs = per.select("_row", F.explode(F.arrays_zip("keys", "mults")).alias("p")).select("_row", F.col("p.keys").alias("key"), F.col("p.mults").alias("mult"))
    held = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("docs"))
    top = held.groupBy(F.shiftright("key", B_BITS).alias("a")).agg(F.max("docs").alias("top"))
    stats = held.join(top, F.shiftright(held["key"], B_BITS) == top["a"]).select("key", "docs", (F.col("docs") == F.col("top")).alias("best"))
    sums = pairs.join(stats, "key").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("mult")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("mult") * F.col("docs")).cast("long").alias("count_sum"),
    )
    return per.join(sums, "_row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
