"""Bounded samples by class, drawn by hash, for models that one task fits, and sums of arrays for models that many tasks fit."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 1 << 30


def by_class(rows: DataFrame, label: str, draw: Column, most: int) -> DataFrame:
    """At most ``most`` rows in all, as many of each value of ``label``, those with the smallest hashes.

    Class sizes are counted first and rows dropped on the way in by a hash
    threshold at four times the quota, so the ranking below sees a few thousand
    rows whatever the table holds. One number per class goes through the driver.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not sizes:
        return rows.withColumn("_draw", draw).where("false")
    quota = max(1, most // len(sizes))
    limit = F.lit(0)
    for value, n in sizes.items():
        limit = F.when(F.col(label).eqNullSafe(F.lit(value)), F.lit(min(UNIT, 4 * quota * UNIT // n + 1))).otherwise(limit)
    near = rows.withColumn("_draw", draw).where(F.pmod("_draw", F.lit(UNIT)) < limit)
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.pmod("_draw", F.lit(UNIT)), "_draw"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def fit_in_task(rows: DataFrame, fit: Callable[[list[dict]], object]):
    """What ``fit`` makes of all rows, in one task; only for samples of bounded size. The driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit([row for many in batches for row in many.to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(rows.repartition(1).mapInArrow(run, "model binary").collect()[0]["model"])


PIECES = "block int, shard int, data binary"
_PIECES = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("data", pa.binary())])


def pieces(shard: int, arrays: dict[int, np.ndarray], kind=np.float32) -> pa.RecordBatch:
    """Numbered arrays of one task as rows of ``PIECES``, for ``summed``."""
    data = [np.ascontiguousarray(x, kind).tobytes() for x in arrays.values()]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(arrays), pa.int32()), pa.array([shard] * len(data), pa.int32()), pa.array(data, pa.binary())], schema=_PIECES)


def summed(rows: DataFrame, kind=np.float32) -> dict[int, np.ndarray]:
    """The sum of each block's arrays over all tasks, added in the order of shards so that reruns agree.

    ``rows`` are ``PIECES``. A group holds one small block per shard; the driver gets one array per block.
    """

    def add(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("shard").to_numpy(), kind="stable")
        data = table.column("data")
        total = sum(np.frombuffer(data[int(i)].as_buffer(), kind).astype(np.float64) for i in order)
        return pa.table({"block": table.column("block").slice(0, 1), "data": pa.array([total.astype(kind).tobytes()], pa.binary())})

    got = rows.groupBy("block").applyInArrow(add, "block int, data binary").toArrow()
    return {b: np.frombuffer(x, kind) for b, x in zip(got.column("block").to_pylist(), got.column("data").to_pylist())}
