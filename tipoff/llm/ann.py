"""Approximate nearest neighbours by collision counting.

Largest inner products are nearest points once every vector gets one more component, sqrt(M^2 - |x|^2) with M the
largest norm, and queries get 0 there. ``PROJECTIONS`` random directions map each point to single numbers; each projection
is kept as one sorted array. A query looks at the window around its own number in every array; points
inside count a collision each. Virtual rehashing widens the windows step by step (only the new parts are looked at), and
points with at least ``THRESHOLD`` of the projections are verified by their true inner product. A query stops once ``ENOUGH`` of a block's points are verified.

Rows are dealt into blocks of bounded size and the stated queries too; every block of queries meets every
block of rows in a task of its own, which returns the k best found there, and the best of those are taken per query. A block
never grows with the data, only their number does. Vectors that are the same in a block are searched once and all count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.scratch import stage

PROJECTIONS = 48
THRESHOLD = 0.75
SEED = 7
ROW_BLOCK = 16_384
QUERY_BLOCK = 4_096
# share of a block's points to verify before a query may stop; the first window and its growth, in units of the distance
# that a query has to a point at a right angle. Vectors without close neighbours need a large share: of random ones in 64
# dimensions, 0.3 finds more than 19 of the 20 nearest. Small blocks are verified up to LEAST points.
ENOUGH = 0.3
LEAST = 800
FIRST_WINDOW = 0.5
GROWTH = 1.12


def directions(dimensions: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).standard_normal((dimensions, PROJECTIONS))


class Block:
    """The sorted projections of one block of points."""

    def __init__(self, points: np.ndarray, largest: float):
        self.points, self.largest = points, largest
        norms = np.einsum("ij,ij->i", points, points)
        extra = np.sqrt(np.maximum(largest**2 - norms, 0))
        self.lines = directions(points.shape[1] + 1)
        values = points @ self.lines[:-1] + extra[:, None] * self.lines[-1]
        self.order = np.argsort(values, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(values, self.order.T, axis=0).T.copy()

    def search(self, queries: np.ndarray, k: int):
        """For each query in turn, the places of the points verified for it."""
        n, need = len(self.points), int(np.ceil(THRESHOLD * PROJECTIONS))
        enough = min(n, max(4 * k, LEAST, int(np.ceil(ENOUGH * n))))
        spots = queries @ self.lines[:-1]
        unit = np.sqrt(np.maximum((queries * queries).sum(axis=1) + self.largest**2, 1e-300))
        windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def window(level: int) -> tuple[np.ndarray, np.ndarray]:
            # of all queries at once: where the level's window begins and ends in each projection
            if level not in windows:
                radius = FIRST_WINDOW * GROWTH**level * unit
                windows[level] = tuple(
                    np.array([np.searchsorted(line, spot + sign * radius, side) for line, spot in zip(self.sorted, spots.T)]).T
                    for sign, side in ((-1, "left"), (1, "right"))
                )
            return windows[level]

        start = 0
        for q in range(len(queries)):
            # what lies outside the windows is less than what lies inside: misses are counted, and taken back as windows widen
            level, (low, high) = start, (x[q].tolist() for x in window(start))
            misses = np.bincount(np.concatenate([p for o, a, b in zip(self.order, low, high) for p in (o[:a], o[b:])]), minlength=n)
            while True:
                found = np.flatnonzero(misses <= PROJECTIONS - need)
                if len(found) >= enough:
                    break
                level += 1
                wider_low, wider_high = (x[q].tolist() for x in window(level))
                parts = [p for o, a, b, c, d in zip(self.order, wider_low, low, high, wider_high) for p in (o[a:b], o[c:d])]
                misses -= np.bincount(np.concatenate(parts), minlength=n)
                low, high = wider_low, wider_high
            # the next query begins a little below where this one ended
            start = max(0, level - 1)
            yield found


def _search_block(k: int, largest: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            rows = np.array(right.column("vector").to_pylist(), np.float64)
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            # equal vectors are one point with all its ids, in order
            point, member = np.unique(rows, axis=0, return_inverse=True)
            member = member.ravel()
            by_point = np.argsort(member, kind="stable")
            ends = np.cumsum(np.bincount(member, minlength=len(point)))
            starts = np.r_[0, ends[:-1]]
            block = Block(point, largest)
            asked = np.array(left.column("vector").to_pylist(), np.float64)
            for q, vector, seen in zip(left.column("vec_id").to_numpy().tolist(), asked, block.search(asked, k + 1)):
                score = point[seen] @ vector
                # equal scores at the k + 1st place all stay in
                edge = -np.partition(-score, min(k, len(score) - 1))[min(k, len(score) - 1)]
                best = np.flatnonzero(score >= edge)
                taken_ids, taken_scores = [], []
                for j in best:
                    # ids of one vector come in order, so k + 1 of them are as far as any answer can reach
                    own = ids[by_point[starts[seen[j]] : ends[seen[j]]][: k + 1]]
                    taken_ids.append(own)
                    taken_scores.append(np.full(len(own), score[j]))
                own, value = np.concatenate(taken_ids), np.concatenate(taken_scores)
                other = own != q
                own, value = own[other], value[other]
                first = np.lexsort((own, -value))[:k]
                out_q.append(np.full(len(first), q))
                out_v.append(own[first])
                out_s.append(value[first])
        none_i, none_f = np.zeros(0, np.int64), np.zeros(0)
        return pa.table(
            {
                "query_id": pa.array(np.concatenate([none_i, *out_q]), pa.int64()),
                "vec_id": pa.array(np.concatenate([none_i, *out_v]), pa.int64()),
                "score": pa.array(np.concatenate([none_f, *out_s]), pa.float64()),
            }
        )

    return run


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of rows whose vector is neither null, empty nor zero and has finite components only."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("vector")).where(fine)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` nearest found for each query: query_id, rank (from 1), vec_id, score; ties to the smaller vec_id.

    Both sides are (vec_id, vector), see ``usable``; vectors of another length than the query's are not its candidates. A query
    is no candidate of its own. Rows repeated with one vec_id count once. With fewer candidates than ``k`` all are returned.
    """
    queries = queries.withColumn("dim", F.size("vector"))
    table = stage(vectors.dropDuplicates(["vec_id"]).withColumn("dim", F.size("vector")), "vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    n, largest = table.agg(F.count("*"), F.max(norm)).first()
    asked = queries.dropDuplicates(["vec_id"])
    row_blocks = max(1, -(-n // ROW_BLOCK))
    query_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    left = asked.withColumn("qb", spread("vec_id", query_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = table.withColumn("rb", spread("vec_id", row_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    found = left.groupBy("dim", "qb", "rb").cogroup(right.groupBy("dim", "qb", "rb")).applyInArrow(
        _search_block(k, float(largest or 0)), "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
