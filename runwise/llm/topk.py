"""Exact search for the largest inner products, over vectors sorted by their length and rotated to their main axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from runwise.session import scratch_path

from .vectors import integer_vectors, matrix, pack, padded, summed

FACTOR, K = 64, 20
#: Rows of a block of candidates and of queries, and of the parts in which a task compares them.
CANDIDATES, QUERIES = 4096, 1024
CANDIDATES_AT_ONCE, QUERIES_AT_ONCE = 1024, 256
#: Partitions of the candidates at most, and how many times as many blocks each wave has as all before it.
MOST_PARTITIONS, WAVE = 10_000, 8
#: Shares of the axes after which a partial sum is held against the bound.
STEPS = (0.25, 0.5)
#: Relative error that is allowed to rounding in a bound.
SLACK = 1e-9
FOUND = "q_row bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
_NONE = np.iinfo(np.int64).min


def main_axes(blocks: DataFrame, size: int) -> np.ndarray:
    """The right singular vectors of all rows, the largest first, as columns."""
    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for n, kind, data in zip(*(batch.column(c).to_pylist() for c in ("n", "kind", "data"))):
                x = matrix(data, kind, n, size).astype(float)
                total += x.T @ x
        yield pa.record_batch([pa.array([total.reshape(-1)])], names=["part"])

    total = summed(blocks.select("n", "kind", "data").mapInArrow(squares, "part array<double>"), "float64")
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(size, size))[1][:, ::-1])


class Side:
    """Vectors with their rotated form, their lengths, and the lengths of what each step leaves out."""

    def __init__(self, x: np.ndarray, axes: np.ndarray, steps: list[int]):
        self.x, self.turned = x, x.astype(float) @ axes
        self.length = np.sqrt((x.astype(float) ** 2).sum(1))
        self.rest = [np.sqrt((self.turned[:, s:] ** 2).sum(1)) for s in steps]

    def part(self, at) -> Side:
        out = object.__new__(Side)
        out.x, out.turned, out.length, out.rest = self.x[at], self.turned[at], self.length[at], [r[at] for r in self.rest]
        return out


def _products(q: np.ndarray, c: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products; through floating point where that is exact."""
    if most < 2**53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _ordered(scores: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One number per score that also orders equal scores: the smaller ``before``, a place among all candidates, is larger."""
    width = int(before.max(initial=0)) + 1
    real = scores != _NONE
    if np.abs(scores[real]).max(initial=0) > (1 << 62) // width:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape).astype(np.int64)
    return np.where(real, scores * width + (width - 1 - before), _NONE)


def best_of(queries: Side, own: np.ndarray, least: np.ndarray, cands: Side, rows: np.ndarray, places: np.ndarray, k: int, steps: list[int]):
    """For each query the positions and scores of its ``k`` best candidates, _NONE where there are fewer.

    Candidates come by falling length. ``least`` is a score that the query's k-th best is known to reach.
    A candidate is dropped when what Cauchy and Schwarz allow for the rest of its sum is not enough;
    then only exact integer products count. ``own`` and ``rows`` name rows, so that no query finds itself;
    ``places`` orders candidates of equal score.
    """
    n = len(queries.x)
    best = np.full((n, k), _NONE)
    at = np.zeros((n, k), np.int64)
    least = least.astype(float)
    most = queries.length.max(initial=0) * cands.length.max(initial=0)
    for a in range(0, n, QUERIES_AT_ONCE):
        mine = slice(a, a + QUERIES_AT_ONCE)
        q_all, floor = queries.part(mine), least[mine]
        for b in range(0, len(cands.x), CANDIDATES_AT_ONCE):
            c = cands.part(slice(b, b + CANDIDATES_AT_ONCE))
            slack = SLACK * most + 1e-6
            live = np.flatnonzero(q_all.length * c.length[0] + slack >= floor)
            if not len(live):
                break  # all later candidates are shorter
            q, need = q_all.part(live), floor[live] - slack
            sums, done, columns, lines = np.zeros((len(live), len(c.x))), 0, np.arange(len(c.x)), np.arange(len(live))
            for i, s in enumerate(steps):
                sums += q.turned[lines, done:s] @ c.turned[columns, done:s].T
                done = s
                open_ = sums + np.outer(q.rest[i][lines], c.rest[i][columns]) >= need[lines, None]
                some, seen = open_.any(0), open_.any(1)
                columns, lines, sums = columns[some], lines[seen], sums[np.ix_(seen, some)]
                if not len(columns):
                    break
            if not len(columns):
                continue
            scores = _products(q.x[lines], c.x[columns], most)
            scores[own[mine][live][lines][:, None] == rows[b + columns][None, :]] = _NONE
            who = a + live[lines]
            both = np.concatenate([best[who], scores], 1)
            pos = np.concatenate([at[who], np.broadcast_to(b + columns, scores.shape)], 1)
            order = _ordered(both, places[pos])
            top = np.argpartition(order, -k, axis=1)[:, -k:] if order.shape[1] > k else np.arange(order.shape[1])[None, :].repeat(len(who), 0)
            best[who], at[who] = np.take_along_axis(both, top, 1), np.take_along_axis(pos, top, 1)
            kth = best[who].min(1)
            floor[live[lines]] = np.where(kth == _NONE, floor[live[lines]], np.maximum(floor[live[lines]], kth.astype(float)))
    return at, best


def _search(cells: DataFrame, axes: np.ndarray, size: int, k: int) -> DataFrame:
    """``FOUND`` rows, k a query at most, of each pair of a block of queries and one of candidates.

    Only what comes before the query's k-th best so far, by score, then id, then row, is returned.
    """
    steps = sorted({max(1, round(size * s)) for s in STEPS})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                q = Side(matrix(cell["q_data"], cell["q_kind"], cell["q_n"], size), axes, steps)
                c = Side(matrix(cell["data"], cell["kind"], cell["n"], size), axes, steps)
                own, rows, ids, q_ids, kth = np.array(cell["q_rows"]), np.array(cell["rows"]), cell["ids"], cell["q_ids"], cell["kth"]
                # ties go to the smaller id, then to the earlier row; null ids are last
                places = np.empty(len(rows), np.int64)
                places[sorted(range(len(rows)), key=lambda i: (ids[i] is None, ids[i] or 0, rows[i]))] = np.arange(len(rows))
                least = np.array([_NONE if x is None else x["score"] for x in kth])
                at, best = best_of(q, own, least, c, rows, places, k, steps)
                line, column = np.nonzero((best != _NONE) & (best >= least[:, None]))
                out = []
                for i, j, score in zip(line.tolist(), at[line, column].tolist(), best[line, column].tolist()):
                    x, row = kth[i], int(rows[j])
                    if x is None or score > x["score"] or (ids[j] is None, ids[j] or 0, row) < (x["vec_id"] is None, x["vec_id"] or 0, x["row"]):
                        out.append((int(own[i]), q_ids[i], ids[j], row, score))
                columns = zip(*out) if out else [()] * 5
                yield pa.record_batch([pa.array(x, pa.int64()) for x in columns], names=["q_row", "query_id", "vec_id", "row", "score"])

    return cells.select("q_n", "q_kind", "q_ids", "q_rows", "q_data", "kth", "n", "kind", "ids", "rows", "data").mapInArrow(search, FOUND)


def top_products(df: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", factor: int = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product for each row where ``queries``, a condition on vec_id, holds.

    Entries become the integers ``floor(factor * entry)``; scores are exact inner products of these. All
    rows but the query's own are candidates, all of them where there are fewer than ``k``. Ties go
    to the smaller id.

    Candidates are range-sorted by falling length and packed into numbered blocks, queries into smaller ones. Blocks
    of queries meet the first block of candidates, then the next ones in waves that grow by WAVE. After each wave
    a query knows its k best so far; blocks too short for every query of a block are not met, and a cell
    returns only what beats the k-th. So a query brings some ``k * WAVE`` rows to a wave, not k to every block, and
    a task holds two blocks, whatever the table's size.

    Rows whose vector is null or holds a null or non-finite entry take no part. Shorter vectors count as if zeros
    followed, an empty one as zeros. A row without an id is a candidate, after all others of its score, and no query.
    Rows that repeat an id or a vector are rows of their own: each is a candidate to the others. An empty table, and one
    row, give no rows. Lengths are taken to fit 31 bits, so that a score is a long. Other columns play no part.
    """
    spark = df.sparkSession

    def kept(frame: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        frame.write.parquet(path)
        return spark.read.parquet(path)

    rows = kept(integer_vectors(df, factor, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    number, size = rows.agg(F.count("*"), F.max(F.size("x"))).first()
    if not number:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    size = max(size, 1)
    rows = padded(rows, size).withColumn("length", F.ceil(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e))))
    order = [F.desc("length"), F.col("row")]
    placed = rows.repartitionByRange(min(MOST_PARTITIONS, -(-number // CANDIDATES)), *order).sortWithinPartitions(*order)
    # ranges come out uneven, so that most are one block, but none is more than twice the usual size
    cands = kept(pack(placed, 2 * CANDIDATES, size).withColumn("part", F.spark_partition_id()), "candidates")
    # partitions are in the order of the lengths; there are MOST_PARTITIONS of them at most
    before, total = [], 0
    for part, blocks in sorted(tuple(r) for r in cands.groupBy("part").count().collect()):
        before.append((part, total))
        total += blocks
    first = F.broadcast(spark.createDataFrame(before, "b_part int, before bigint"))
    cands = cands.join(first, F.col("part") == F.col("b_part")).withColumn("block", F.col("before") + F.col("block")).drop("part", "b_part", "before")
    asked = pack(rows.filter(queries), QUERIES, size).withColumn("block", F.shiftleft(F.spark_partition_id().cast("bigint"), 32) + F.col("block"))
    asked = kept(asked.select(*(F.col(c).alias(f"q_{c}") for c in ("block", "n", "kind", "ids", "rows", "data"))), "queries")
    axes = main_axes(cands, size)
    best, low, high = spark.createDataFrame([], f"{FOUND}, rank int"), 0, 1
    while low < total:
        found = _search(_cells(_with_kth(asked, best, k), cands, low, min(high, total)), axes, size, k)
        by = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        merged = best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
        best, low, high = kept(merged, "best"), high, high * WAVE
    return best.select("query_id", "rank", "vec_id", "score")


def _with_kth(asked: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """``asked`` with the array ``kth``: the k-th best so far of each query of the block, null where there are fewer."""
    known = best.filter(F.col("rank") == k).select(F.col("q_row").alias("k_row"), F.struct("score", "vec_id", "row").alias("found"))
    places = asked.select("q_block", F.posexplode("q_rows").alias("place", "q_row"))
    # a block has QUERIES rows at most
    kth = places.join(known, F.col("q_row") == F.col("k_row"), "left").groupBy("q_block").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "found"))), lambda p: p["found"]).alias("kth"))
    return asked.join(kth.withColumnRenamed("q_block", "k_block"), F.col("q_block") == F.col("k_block")).drop("k_block")


def _cells(ready: DataFrame, cands: DataFrame, low: int, high: int) -> DataFrame:
    """Blocks of queries with those of the candidates ``low`` up to ``high`` in which a query may find one of its best."""
    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            needs = []
            for n, kind, data, kth in zip(*(batch.column(c).to_pylist() for c in ("q_n", "q_kind", "q_data", "kth"))):
                length = np.sqrt((np.frombuffer(data, kind).reshape(n, -1).astype(float) ** 2).sum(1))
                known = np.array([-np.inf if x is None else x["score"] for x in kth], float)
                need = np.divide(known, length, out=np.full(n, -np.inf), where=(known > 0) & (length > 0))
                needs.append(float(need.min()) * (1 - SLACK))
            yield pa.record_batch([batch.column("q_block"), pa.array(needs, pa.float64())], names=["n_block", "need"])

    needs = ready.select("q_block", "q_n", "q_kind", "q_data", "kth").mapInArrow(shortest, "n_block bigint, need double")
    wanted = needs.select("*", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high - 1).cast("bigint"))).alias("number"))
    tops = cands.select(F.col("block").alias("t_block"), F.col("top").cast("double").alias("t_top"))
    wanted = wanted.join(tops, F.col("number") == F.col("t_block")).filter("t_top >= need").select("n_block", "number")
    pairs = wanted.join(ready, F.col("n_block") == F.col("q_block"))
    return pairs.join(cands.filter(F.col("block").between(low, high - 1)), F.col("number") == F.col("block"))
