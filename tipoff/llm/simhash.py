"""SimHash near-duplicates by deletion-variant signatures.

The 64 bits are cut into three segments. Of two fingerprints that differ in 4 (even 5) bits, one segment
differs in at most one bit; with that bit taken out the two segments are equal. So every distinct
fingerprint is indexed under each of its 64 one-wildcard segments, fingerprints with the same variant meet by
an equality join on it, and each meeting is verified on all bits.

The join is one shuffle on the variant and a scan over runs of equal variants. Copies were merged to one
fingerprint before. A run of up to ``RUN`` members is compared pair by pair, and a link is passed on from the first
variant that shows it. In a longer run (a large group of near copies) members are reached breadth first from
one another, and a member once reached is not compared again: no link between components is missed, and a group
of n gives n - 1 links, not n squared. A run is kept as 8 bytes a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tipoff.llm.common import components
from tipoff.scratch import stage

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = ((0, 21), (21, 21), (42, 22))
RUN = 32


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each shingle of the lower-cased words, repeats included; of the whole sequence if it is shorter."""
    words = b" ".join(text.lower().split())
    if not words:
        return []
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    if len(gaps) + 1 <= shingle:
        return [xxhash.xxh64_intdigest(words, SEED)]
    starts, ends, digest = [0, *(gaps + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(words)], xxhash.xxh64_intdigest
    return [digest(words[s:e], SEED) for s, e in zip(starts, ends)]


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint, as a signed number."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([0 if x is None else fingerprint_of(x) for x in text.cast(pa.large_binary()).to_pylist()], pa.int64())


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text column; null, empty and blank texts have 0."""
    return _fingerprints(text)


def variants(fp: Column) -> Column:
    """The 64 one-wildcard segments of a fingerprint, each as one number that also says which bit is out."""
    out = []
    for start, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1))
        for bit in range(width):
            low = part.bitwiseAND(F.lit((1 << bit) - 1))
            high = F.shiftleft(F.shiftrightunsigned(part, bit + 1), bit)
            out.append(low.bitwiseOR(high).bitwiseOR(F.lit((start + bit) << 24)))
    return F.array(*out)


def _first_variant(x: np.ndarray) -> np.ndarray:
    """Which bit is out in the first variant that two fingerprints share; x: their difference."""
    first = np.full(len(x), 64, np.int64)
    for start, width in reversed(SEGMENTS):
        part = (x >> np.uint64(start)) & np.uint64((1 << width) - 1)
        ones = np.bitwise_count(part)
        first = np.where(ones == 0, start, np.where(ones == 1, start + np.bitwise_count(part - np.uint64(1)).astype(np.int64), first))
    return first


def _reach(members: np.ndarray, max_bits: int) -> tuple[list, list]:
    """Links that hold each component of one run together."""
    left, right, rest = [], [], members
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            for x in front.pop():
                near = np.bitwise_count(rest ^ x) <= max_bits
                if near.any():
                    new = rest[near]
                    left.append(np.full(len(new), x))
                    right.append(new)
                    front.append(new)
                    rest = rest[~near]
    return left, right


def _run_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among members of equal key; key is sorted."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [], []
    room = np.where(np.repeat(sizes, sizes) <= RUN, np.repeat(starts + sizes, sizes) - np.arange(len(key)), 0)
    at = np.flatnonzero(room > 1)
    for step in range(1, RUN):
        at = at[room[at] > step]
        if not len(at):
            break
        x = fp[at] ^ fp[at + step]
        hit = np.flatnonzero(np.bitwise_count(x) <= max_bits)
        hit = hit[_first_variant(x[hit]) == (key[at[hit]] >> 24)]
        left.append(fp[at[hit]])
        right.append(fp[at[hit] + step])
    for k in np.flatnonzero(sizes > RUN):
        a, b = _reach(fp[starts[k] : starts[k] + sizes[k]], max_bits)
        left += a
        right += b
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _scan(batches, max_bits: int):
    """Links of one partition sorted by variant; only the run that may go on is held back."""
    keys, fps = [], []

    def made(key, fp):
        a, b = _run_links(key, fp, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if keys and keys[-1][-1] == key[-1]:
            keys.append(key)
            fps.append(fp)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if keys or cut:
            yield made(np.concatenate([*keys, key[:cut]]), np.concatenate([*fps, fp[:cut]]))
        keys, fps = [key[cut:]], [fp[cut:]]
    if keys:
        yield made(np.concatenate(keys), np.concatenate(fps))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints of column ``fp`` at most ``max_bits`` (up to 5) apart."""
    spread = fps.select(F.explode(variants(F.col("fp"))).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(lambda batches: _scan(batches, max_bits), "u long, v long").distinct()


def _grouped(documents: DataFrame, text: str, max_bits: int) -> DataFrame:
    """Per row: doc_id, two hashes that name the row, fp, component_id and the component's smallest fingerprint."""
    whole = F.coalesce(F.col(text), F.lit(""))
    fps = stage(
        documents.select("doc_id", F.xxhash64("doc_id", whole).alias("_a"), F.xxhash64(whole, "doc_id").alias("_b"), fingerprint(F.col(text)).alias("fp")),
        "fingerprints",
    )
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(first.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    linked = roots.join(first, "fp")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    by_fp = first.join(roots.join(least, "root").select("fp", "root", "least"), "fp", "left").select(
        "fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root")
    )
    return fps.join(by_fp, "fp")


def near_duplicates(documents: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``documents``: doc_id, fp and component_id, the smallest doc_id that links lead to.

    Null, empty and blank texts have fingerprint 0 and are linked like others. Rows with a null doc_id take part
    and get their component's id, null if it holds no other. Repeated rows stay rows.
    """
    return _grouped(documents, text, max_bits).select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame, text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest doc_id, null ids last.

    Only hashes take part in the choice, one row a component and task; texts cross one shuffle, on the rows' hashes, or
    none if the planner can broadcast what is kept.
    """
    names = documents.columns
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b")
    kept = _grouped(documents, text, max_bits).groupBy("root").agg(F.min(order).alias("kept")).select("kept._a", "kept._b")
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = documents.withColumns({"_a": F.xxhash64("doc_id", whole), "_b": F.xxhash64(whole, "doc_id")})
    return keyed.join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select(*names)
