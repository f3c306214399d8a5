"""Token counts of a unigram tokenizer without the tokens.

An Aho-Corasick automaton over the vocabulary's bytes names, at each place of a
word, the pieces that end there, longest first. The dynamic programme keeps
the best score and its number of pieces for each place. A later candidate must
be strictly better, which is the tokenizer's rule: among equal scores the one
with the longest last piece stays. A character that is no piece itself costs
the least score less 10; it counts one for each of its bytes where unknown
characters fall back to bytes, else one for a run of them.

All distinct words of a chunk of texts go through the automaton side by side,
one byte at a time. The automaton's arrays lie in the shared folder and are
memory-mapped by the workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirecube.llm import shared, words

MARK = "▁"
UNKNOWN_PENALTY = 10.0
DEFAULT_MODEL = "piece_bpe_32k.model"


def vocabulary(model: str | None = None) -> list[tuple[str, float]]:
    """The pieces of a SentencePiece file, scored ``-ln(rank + 2)`` where the file has ranks and no probabilities."""
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=model or public_tokenizers.path(DEFAULT_MODEL))
    return [(own.id_to_piece(i), -float(np.log(i + 2))) for i in range(own.get_piece_size())]


class Automaton:
    """``goto`` by state and byte; for each state its longest piece as a state (``head``) and the next shorter one (``link``)."""

    NAMES = ("goto", "head", "link", "length", "score", "rules")

    @classmethod
    def build(cls, pieces: list[tuple[str, float]], byte_fallback: bool) -> Automaton:
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], {}
        for piece, score in pieces:
            state = 0
            for byte in piece.encode():
                if byte not in children[state]:
                    children[state][byte] = len(children)
                    children.append({})
                    depth.append(depth[state] + 1)
                state = children[state][byte]
            if state:
                ends.setdefault(state, score)
        n = len(children)
        self = cls()
        self.goto = np.zeros((n, 256), np.int32)
        fail, depth = np.zeros(n, np.int32), np.array(depth)
        for level in range(int(depth.max()) + 1):
            for s in np.flatnonzero(depth == level).tolist():
                row = self.goto[s]
                if s:
                    row[:] = self.goto[fail[s]]
                for byte, child in children[s].items():
                    fail[child] = row[byte] if s else 0
                    row[byte] = child
        self.length, self.score = np.zeros(n, np.int32), np.zeros(n)
        for state, score in ends.items():
            self.length[state], self.score[state] = depth[state], score
        self.head, self.link = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for s in np.argsort(depth, kind="stable").tolist()[1:]:
            self.link[s] = self.head[fail[s]]
            self.head[s] = s if self.length[s] else self.link[s]
        least = min((score for _, score in pieces), default=0.0)
        self.rules = np.array([least - UNKNOWN_PENALTY, float(byte_fallback)])
        return self

    def save(self, folder: str) -> None:
        for name in self.NAMES:
            shared.publish(f"{folder}/{name}.npy", lambda out, a=getattr(self, name): np.save(out, a))

    @classmethod
    def load(cls, folder: str) -> Automaton:
        self = cls()
        for name in cls.NAMES:
            setattr(self, name, np.load(f"{folder}/{name}.npy", mmap_mode="r"))
        return self

    def count(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score of each word ``data[bounds[i]:bounds[i + 1]]``."""
        unknown, by_bytes = float(self.rules[0]), bool(self.rules[1])
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        begin, size = bounds[:-1][order], size[order]
        # place p of word i is entry begin[i] + i' + p, with i' words before it
        entry = bounds[:-1][order] + order
        best = np.full(len(data) + len(size), -np.inf)
        pieces = np.zeros(len(best), np.int64)
        lost = np.zeros(len(best), bool)  # the best way ends in an unknown character
        best[entry] = 0.0
        lead = (data & 0xC0) != 0x80
        opens = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0)) if len(data) else np.zeros(0, np.int64)
        closes = np.r_[lead[1:], True] if len(data) else lead
        state = np.zeros(len(size), np.int32)
        alive = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for t, n in enumerate(alive.tolist(), 1):
            at = begin[:n] + t - 1
            state = self.goto[state[:n], data[at]]
            here = entry[:n] + t
            width = at - opens[at] + 1
            single = np.zeros(n, bool)
            who, match = np.arange(n), self.head[state]
            while True:
                live = match != 0
                if not live.any():
                    break
                who, match = who[live], match[live]
                size_ = self.length[match]
                source = here[who] - size_
                score = best[source] + self.score[match]
                single[who] |= size_ == width[who]
                better = score > best[here[who]]
                to, source = here[who[better]], source[better]
                best[to], pieces[to], lost[to] = score[better], pieces[source] + 1, False
                match = self.link[match]
            who = np.flatnonzero(closes[at] & ~single)
            if len(who):
                source = here[who] - width[who]
                score = best[source] + unknown
                better = score > best[here[who]]
                who, source = who[better], source[better]
                to = here[who]
                more = width[who] if by_bytes else ~lost[source]
                best[to], pieces[to], lost[to] = score[better], pieces[source] + more, True
        n_pieces, scores = np.zeros(len(order), np.int64), np.zeros(len(order))
        n_pieces[order], scores[order] = pieces[entry + size], best[entry + size]
        return n_pieces, scores


def marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the parts that spaces cut a text into; a space belongs to the part after it."""
    gap = np.flatnonzero(data == 0x20)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    fresh = filled[data[offsets[filled]] != 0x20] if len(filled) else filled
    starts = np.r_[offsets[fresh], gap + 1]
    rows = np.r_[fresh, np.searchsorted(offsets, gap, "right") - 1]
    stops = np.sort(np.r_[gap, offsets[1:]])
    # a row's first part isn't empty, so its end lies beyond the end of the row before; a part after a last space is empty
    ends = np.r_[np.searchsorted(stops, starts[:len(fresh)], "right"), np.searchsorted(stops, starts[len(fresh):], "left")]
    return starts, stops[ends], rows


def count_texts(texts: pa.Array, automaton: Automaton) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, tokens, score)`` per chunk of rows."""
    mark = np.frombuffer(MARK.encode(), np.uint8)
    texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
    for first, data, offsets in words.chunks(texts):
        starts, ends, rows = marked_words(data, offsets)
        _, where, which = np.unique(words.hash_spans(data, starts, ends), return_index=True, return_inverse=True)
        a, size = starts[where], ends[where] - starts[where]
        bounds = np.r_[0, np.cumsum(size + len(mark))]
        lanes = np.zeros(int(bounds[-1]), np.uint8)
        for j, byte in enumerate(mark):
            lanes[bounds[:-1] + j] = byte
        inner = np.repeat(bounds[:-1] + len(mark) - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        lanes[inner] = data[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        n, score = automaton.count(lanes, bounds)
        k = len(offsets) - 1
        yield first, np.bincount(rows, n[which], k).astype(np.int64), np.bincount(rows, score[which], k)


_loaded: dict[str, Automaton] = {}


def token_counts(
    docs: DataFrame, pieces: list[tuple[str, float]] | None = None, byte_fallback: bool = True, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """``doc_id, n_tokens, score`` for every row: tokens of the unigram tokenizer and the log score of that split.

    Texts are marked as SentencePiece does: spaces become marks, and one stands
    before the first word. Null and empty texts have 0 tokens; null and repeated
    ids pass through; an empty table gives an empty result. Other columns are
    not read.
    """
    folder = shared.folder(docs.sparkSession, "automaton")
    Automaton.build(pieces if pieces is not None else vocabulary(), byte_fallback).save(folder)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _loaded:
            _loaded.clear()
            _loaded[folder] = Automaton.load(folder)
        for many in batches:
            for first, n, score in count_texts(many.column("text"), _loaded[folder]):
                yield words.batch(schema, doc_id=many.column("doc_id").slice(first, len(n)), n_tokens=n, score=score)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")
