"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are turned into integers and dealt into blocks. The index of a block
holds, per dimension, postings sorted by value and cut into segments of equal
quantised impact (``value >> shift``). A query takes the segments of all
dimensions by descending impact, adds the quantised impact to its accumulators,
and stops when the bounds prove that all but a few vectors cannot be among its
best: postings not met have at most the next segment's impact, and exact scores
of likely vectors give the floor. Those few are scored exactly. Where no such
proof comes, all segments are processed, so the answer is exact either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirecube.session import checkpoint

K = 10
SHIFT = 3
BLOCK = 8192
QUERY_BLOCK = 1024
STEPS = 4
MAX_TASKS = 10_000  # pairs of blocks beyond share tasks
SCALE = 1024


def integers(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as double; null for a vector that is null, empty or not finite throughout."""
    usable = (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(usable, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


class Index:
    """One block: ids and rows, and per dimension the postings by ascending value with their segment bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, shift: int = SHIFT):
        self.ids, self.rows, self.shift = ids, rows, shift
        self.order = np.argsort(rows.T, axis=1, kind="stable")  # a row of row numbers per dimension
        self.quant = np.take_along_axis(rows.T, self.order, 1) >> shift
        self.segments = []  # (dimension, quantised value, first); a dimension's segments follow one another
        for d, values in enumerate(self.quant):
            starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            self.segments += [(d, int(values[a]), int(a)) for a in starts]
        self.dim, self.value, self.first = (np.array(c, np.int64) for c in zip(*self.segments))
        self.per_dim = np.bincount(self.dim, minlength=rows.shape[1])
        self.offset = np.r_[0, np.cumsum(self.per_dim)]  # of each dimension's segments
        self.ends = np.r_[self.first[1:], 0]
        self.ends[self.offset[1:] - 1] = len(rows)

    def search(self, query: np.ndarray, own: int | None, k: int, steps: int = STEPS):
        """The best ``k`` (score, id) of the block."""
        weight = query << self.shift
        impact = self.value * weight[self.dim]  # of a posting in the segment, but for what the quantising cut off
        slack = int(query[query > 0].sum()) * ((1 << self.shift) - 1)  # the most that it cut off in all
        turn = np.argsort(-impact, kind="stable")
        n, dims = self.rows.shape
        total, count = np.zeros(n, np.int64), np.zeros(n, np.int64)  # impact and number of the postings met
        mine = self.ids != own if own is not None else np.ones(n, bool)
        possible, done = np.flatnonzero(mine), np.zeros(dims, np.int64)
        probe = min(4 * k, len(possible))
        if len(possible) <= k:
            steps = 0
        for at in range(steps):
            last = len(turn) * (at + 1) // steps
            now = done + np.bincount(self.dim[turn[len(turn) * at // steps:last]], minlength=dims)
            for d in np.flatnonzero(now > done):
                # segments leave a dimension from one end, so those of a step are one run
                s, e = (self.per_dim[d] - now[d], self.per_dim[d] - done[d]) if weight[d] > 0 else (done[d], now[d])
                run = slice(self.first[self.offset[d] + s], self.ends[self.offset[d] + e - 1])
                met = self.order[d, run]
                total[met] += self.quant[d, run] * weight[d]
                count[met] += 1
            done = now
            # postings not met yet have at most the impact of the next segment
            bound = total + slack
            if last < len(turn):
                bound += (dims - count) * impact[turn[last]]
            bound = bound[mine]
            # the k-th exact score of some likely ones is a floor for the k best
            likely = np.flatnonzero(mine)[np.argpartition(-bound, probe - 1)[:probe]]
            floor = np.partition(self.rows[likely] @ query, probe - k)[probe - k]
            possible = np.flatnonzero(mine)[bound >= floor]
            if len(possible) <= max(4 * k, n // 32):
                break
        score = self.rows[possible] @ query
        best = np.lexsort((self.ids[possible], -score))[:k]
        return score[best], self.ids[possible][best]


def blocks(frame: DataFrame, size: int, into: str) -> tuple[DataFrame, int]:
    """Rows ``(row, id, x)`` gathered into blocks of about ``size`` rows by a hash of the row number, and how many blocks."""
    n = max(1, -(-frame.count() // size))
    return frame.groupBy(F.pmod(F.xxhash64("row"), F.lit(n)).alias(into)).agg(
        F.collect_list(F.struct("row", "id", "x")).alias(f"{into}_rows")), n


def top_k(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", is_query: Column | None = None, k: int = K,
    every: int = 100, block: int = BLOCK, query_block: int = QUERY_BLOCK, shift: int = SHIFT,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other vectors of each query row.

    ``is_query`` chooses the query rows (default: ids divisible by ``every``).
    Vectors that are null, empty or hold a null or non-finite component take
    no part, nor do rows without an id; a vector scores only against those of
    its own length. Rows with the query's own id are not its candidates. A
    repeated query row gets its own result. Ties go to the smaller id; an empty
    table gives an empty result. Other columns are not read.
    """
    chosen = is_query if is_query is not None else F.col(vec_id) % every == 0
    rows = checkpoint(
        vectors.select(F.col(vec_id).cast("long").alias("id"), integers(F.col(vector)).alias("x"), chosen.alias("asks"))
        .where("id is not null and x is not null").withColumn("row", F.monotonically_increasing_id()))
    sides, n_sides = blocks(rows, block, "side")
    asked, n_asked = blocks(rows.where("asks"), query_block, "q")
    pairs = sides.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1)))).join(asked, "q")
    pairs = pairs.repartition(min(n_sides * n_asked, MAX_TASKS), "q", "side")
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def packed(items) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        flat = items.flatten() if hasattr(items, "flatten") else items
        x = pa.array(flat.field("x"))
        lengths = np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset:x.offset + len(x) + 1])
        values = x.flatten().to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.cumsum(lengths)]
        ids, rows = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "row"))
        groups = {}
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            groups[int(n)] = (at, values[starts[at][:, None] + np.arange(n)])
        return ids, rows, groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in batches:
            for i in range(many.num_rows):
                one = many.slice(i, 1)
                ids, _, groups = packed(one.column("side_rows"))
                q_ids, q_rows, asks = packed(one.column("q_rows"))
                out: list[tuple] = []
                for n, (at, xs) in asks.items():
                    if n not in groups:
                        continue
                    index = Index(ids[groups[n][0]], groups[n][1], shift)
                    for j, x in zip(at, xs):
                        score, who = index.search(x, int(q_ids[j]), k)
                        out += [(int(q_rows[j]), int(q_ids[j]), int(w), int(s)) for s, w in zip(score, who)]
                cols = list(zip(*out)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=schema)

    found = pairs.select("side_rows", "q_rows").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
