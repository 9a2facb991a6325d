"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.scratch import discard, stage

# rows of one Arrow batch; texts can be long, so a batch of the default 10,000 could outgrow a task
BATCH_ROWS = "1000"


def prepare(spark: SparkSession) -> None:
    """Settings the Python steps expect."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bucket_of(column: str, n: int):
    """crc32 of the value as text, modulo ``n``; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def hash_share(rows: DataFrame, group: str, counts: dict, wanted: int) -> DataFrame:
    """Rows whose hash of doc_id is among the lowest, so many that ``wanted`` of each group are left with room to spare.

    A ranking by that hash then gets a bounded number of rows, however many there are; a group whose rows share few
    doc_ids may be left with less than ``wanted``.
    """
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(1 << 30)
    for value, count in counts.items():
        share = F.when(F.col(group) == value, int(min(1.0, (2 * wanted + 200) / max(count, 1)) * (1 << 30))).otherwise(share)
    return rows.where(low < share)


def texts(array: pa.Array) -> list[str]:
    """The strings of an Arrow column, nulls as empty."""
    return ["" if x is None else x for x in array.to_pylist()]


def packed(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one array and the offsets of its rows, nulls as empty."""
    whole = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    whole = whole.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    last = offsets[-1] if len(offsets) else 0
    return flat[first:last], offsets - first


def row_batches(batches, max_bytes: int = 1 << 20, text: int = 1):
    """Cut Arrow batches so that column ``text`` holds about ``max_bytes`` in each; a longer row goes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(packed(batch.column(text))[1])
        piece = np.cumsum(sizes) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    have, step = 1, base % (1 << 64)
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(step)
        have, step = have + take, step * step % (1 << 64)
    return out


_POWERS: dict[int, np.ndarray] = {}


def _kept_powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = powers(base, 1 << max(n - 1, 1).bit_length())
    return _POWERS[base][:n]


class SpanHash:
    """Hashes of any spans of one array of small numbers from running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        self.sums, self.back = np.zeros(n, np.uint64), _kept_powers(BASE_INVERSE, n)
        weighed = data.astype(np.uint64)
        weighed += np.uint64(1)
        weighed *= _kept_powers(BASE, n)[:-1]
        np.cumsum(weighed, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of every span of one width."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.back[: len(out)]
        out += np.uint64(width)
        return mix(out)


def _fold(edges: DataFrame) -> DataFrame:
    """One round: hang larger neighbours on each node's smallest one, then smaller ones too."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    pairs = large.join(low, "u")
    return (
        pairs.select("u", F.col("m").alias("v"))
        .unionByName(pairs.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v): (node, root) for every node with an edge, root the smallest node.

    Large and small stars alternate until every node hangs on its root. Each round is a staged table, so
    a lost executor costs one round at most, and no set of links or nodes is ever held in one place.
    """
    edges = stage(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        found = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found[0] == 0 or tuple(found) == mark:
            roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
            roots._staged_path = edges._staged_path  # for discard()
            return roots
        done = edges
        mark, edges = tuple(found), stage(_fold(done), "edges")
        discard(done)
