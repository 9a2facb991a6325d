"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a seed and its code point. The vector of the trigram abc is
the elementwise product of a's vector rolled by two places, b's rolled by one and c's (binding with order);
a text's profile is the sum of the vectors of its trigrams (bundling). A language's prototype is the sum of
its training texts' profiles, each scaled to length 1. A text gets the language whose prototype has the largest cosine
with its profile.

In a task, texts go in groups of some 256 KB: trigrams of a group are numbered, counted into a texts x trigrams
table and multiplied with the trigrams' vectors, so memory is bounded by the group or one long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import bucket_of, hash_share, texts

DIMENSIONS = 1024
SEED = 20240
# rows a language that prototypes are made from
ROWS_PER_LANGUAGE = 500
# ids of chosen rows are broadcast up to here
BROADCAST_ROWS = 1_000_000
GROUP_CHARS = 1 << 18
UNKNOWN = "und"


class _Letters:
    """Which code points are letters, and their vectors as they come up."""

    def __init__(self):
        self.known = np.full(0x110000, -1, np.int8)
        self.vectors: dict[int, np.ndarray] = {}

    def letters(self, codes: np.ndarray) -> np.ndarray:
        flags = self.known[codes]
        if (flags < 0).any():
            for c in np.unique(codes[flags < 0]).tolist():
                self.known[c] = chr(c).isalpha()
            flags = self.known[codes]
        return flags > 0

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        rows = []
        for c in codes.tolist():
            if c not in self.vectors:
                if len(self.vectors) > 20_000:
                    self.vectors.clear()
                self.vectors[c] = np.random.Generator(np.random.PCG64([SEED, c])).integers(0, 2, DIMENSIONS).astype(np.int8) * 2 - 1
            rows.append(self.vectors[c])
        return np.array(rows, np.int8).reshape(-1, DIMENSIONS)


def _profiles(group: list[str], tools: _Letters) -> tuple[np.ndarray, np.ndarray]:
    """Profile of each text scaled to length 1, and whether it has a letter. Runs of other characters are one blank."""
    codes = np.frombuffer((" " + "  ".join(t.lower() for t in group) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 for t in group])
    owner = np.repeat(np.arange(len(group)), sizes)
    letter = tools.letters(codes)
    has = np.bincount(owner[letter], minlength=len(group)) > 0
    codes = np.where(letter, codes, 32)
    keep = letter | np.r_[True, letter[:-1]] | np.r_[True, owner[1:] != owner[:-1]]
    codes, owner = codes[keep], owner[keep]
    seen = np.zeros(0x110000, np.int32)
    seen[codes] = 1
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = np.arange(len(alphabet))
    at, k = seen[codes].astype(np.int64), len(alphabet)
    tri = (at[:-2] * k + at[1:-1]) * k + at[2:]
    inside = owner[:-2] == owner[2:]
    tri, owner = tri[inside], owner[:-2][inside]
    if k**3 <= 1 << 22:
        used = np.flatnonzero(np.bincount(tri, minlength=k**3))
        place = np.zeros(k**3, np.int64)
        place[used] = np.arange(len(used))
        tri = place[tri]
    else:
        used, tri = np.unique(tri, return_inverse=True)
    third = tools.matrix(alphabet)
    first, second = np.roll(third, 2, axis=1), np.roll(third, 1, axis=1)
    sums = np.zeros((len(group), DIMENSIONS), np.float32)
    for a in range(0, len(used), 4096):
        block = used[a : a + 4096]
        vectors = (first[block // (k * k)] * second[block // k % k] * third[block % k]).astype(np.float32)
        mine = (tri >= a) & (tri < a + len(block))
        counts = np.bincount(owner[mine] * len(block) + (tri[mine] - a), minlength=len(group) * len(block))
        sums += counts.reshape(len(group), len(block)).astype(np.float32) @ vectors
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(length == 0, 1, length), has


def _in_groups(column: list[str]):
    start, total = 0, 0
    for i, t in enumerate(column):
        if i > start and total + len(t) > GROUP_CHARS:
            yield start, column[start:i]
            start, total = i, 0
        total += len(t)
    if start < len(column):
        yield start, column[start:]


def _sum_profiles(batches):
    tools, sums, rows = _Letters(), {}, {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for start, group in _in_groups(texts(batch.column(0))):
            made, has = _profiles(group, tools)
            for i in np.flatnonzero(has).tolist():
                lang = langs[start + i]
                sums[lang] = sums.get(lang, 0) + made[i].astype(np.float64)
                rows[lang] = rows.get(lang, 0) + 1
    names = sorted(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "profile"]
    )


def fit(documents: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> dict[str, list[float]]:
    """Prototypes by language, from at most ``rows_per_language`` whole texts each, in the order of a hash of doc_id.

    Only rows with a text and a language whose crc32(doc_id) mod 4 is not 2 are used. Partial sums come from the
    executors: one row a language and task.
    """
    known = documents.where("text is not null and lang is not null and doc_id is not null").where(bucket_of("doc_id", 4) != 2)
    order = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    counts = dict(known.groupBy("lang").count().collect())
    chosen = hash_share(known.select("doc_id", "lang"), "lang", counts, rows_per_language).withColumn("rn", F.row_number().over(order))
    chosen = chosen.where(F.col("rn") <= rows_per_language).select("doc_id", "lang").distinct()
    if len(counts) * rows_per_language <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    rows = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).select("text", "lang")
    parts = rows.mapInArrow(_sum_profiles, "lang string, profile array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for part in sorted(parts, key=lambda r: (r.lang, r.profile)):
        sums[part.lang] = sums.get(part.lang, 0) + np.array(part.profile)
    return {lang: (v / max(np.linalg.norm(v), 1e-12)).tolist() for lang, v in sorted(sums.items())}


def predict(text: Column, model: dict[str, list[float]]) -> Column:
    """Struct of lang and score for a text: the best language, ties to the first by name, and its share (0 to 1).

    Null texts, texts without a letter, and any text if the model is empty, get ``und`` and 0. The score is the share
    of the best language when cosines are sharpened by exp(20 * cosine).
    """
    names = sorted(model)
    prototypes = np.array([model[n] for n in names], np.float32).reshape(len(names), DIMENSIONS)
    made: list[_Letters] = []

    @F.arrow_udf("struct<lang string, score double>")
    def run(column: pa.Array) -> pa.Array:
        if not made:
            made.append(_Letters())
        langs, scores = [], []
        for _, group in _in_groups(texts(column)):
            rows, has = _profiles(group, made[0])
            if not names:
                has = np.zeros_like(has)
            best = np.zeros(len(group), np.int64)
            share = np.zeros(len(group))
            if names:
                cosine = rows @ prototypes.T
                best = cosine.argmax(axis=1)
                weight = np.exp(20.0 * (cosine - cosine.max(axis=1, keepdims=True)).astype(np.float64))
                share = 1 / weight.sum(axis=1)
            langs += [names[b] if h else UNKNOWN for b, h in zip(best.tolist(), has.tolist())]
            scores += np.where(has, share, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return run(text)
