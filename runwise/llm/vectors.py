"""Integer vectors, and their rows packed into blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOCK = "block bigint, n bigint, top bigint, kind string, ids array<bigint>, rows array<bigint>, data binary"


def integer_vectors(df: DataFrame, factor: int, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, x): ``x = floor(factor * entry)`` of the rows whose vector has only finite entries."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    # a null vector makes the condition null
    return df.filter(finite).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(v, lambda e: F.floor(e * factor)).alias("x"))


def padded(rows: DataFrame, size: int) -> DataFrame:
    """``x`` with zeros behind it, up to ``size`` entries."""
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(size) - F.size("x"))))


def narrowest(x: np.ndarray) -> np.ndarray:
    """The values in the smallest integer type that holds them."""
    for kind in ("<i2", "<i4"):
        info = np.iinfo(kind)
        if not x.size or (x.min() >= info.min and x.max() <= info.max):
            return x.astype(kind)
    return x


def pack(df: DataFrame, rows_per_block: int, size: int) -> DataFrame:
    """The rows (x, and if there vec_id, row and length) of each partition, in order, as ``BLOCK`` rows of so many at most.

    ``block`` numbers a partition's blocks from 0, ``top`` is the greatest length, ``data`` the matrix
    of n times ``size`` integers of type ``kind``.
    """
    more = [c for c in ("vec_id", "row", "length") if c in df.columns]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = [], 0

        def done(part: pa.Table):
            x = narrowest(np.asarray(part["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(part), size))
            lists = [pa.array([part[c].to_pylist() if c in more else []], pa.list_(pa.int64())) for c in ("vec_id", "row")]
            top = max(part["length"].to_pylist()) if "length" in more else 0
            return pa.record_batch([pa.array([number]), pa.array([len(part)]), pa.array([top], pa.int64()), pa.array([x.dtype.str]), *lists,
                                    pa.array([x.tobytes()], pa.binary())], names=["block", "n", "top", "kind", "ids", "rows", "data"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows_per_block:
                whole = pa.Table.from_batches(held)
                yield done(whole.slice(0, rows_per_block))
                number += 1
                held = whole.slice(rows_per_block).to_batches()
        if sum(b.num_rows for b in held):
            yield done(pa.Table.from_batches(held))

    return df.select("x", *more).mapInArrow(blocks, BLOCK)


def matrix(data: bytes, kind: str, n: int, size: int) -> np.ndarray:
    """The integers of a block as n rows."""
    return np.frombuffer(data, kind).reshape(n, size)


def summed(partials: DataFrame, kind: str) -> np.ndarray:
    """The sum, place by place, of the arrays ``part`` that tasks return: one row per place to the driver."""
    rows = partials.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), kind)
    for r in rows:
        out[r["place"]] = r["value"]
    return out
