"""Benchmark decontamination by spaced seeds.

A seed mask selects some of a few neighbouring tokens and ignores the others. Benchmark items and documents are
hashed under every mask at every token; equal hashes are joined, and around each hit document and item are compared
token by token without shifts. A document is contaminated if, along such an alignment, one of the item's windows of
``WINDOW`` tokens agrees in all but ``SUBSTITUTIONS``; an item of ``SHORTEST`` to ``WINDOW`` - 1 tokens must agree
in all but one. The masks are chosen so that every placement of that many substitutions leaves one of them a hit
inside the window, so the answer is the same as comparing everything with everything (a test tries all placements).

Documents are hashed in numpy from running sums over bytes. Only hashes that pass a Bloom filter of the benchmark's
leave a task, each with the tokens around it, so what is shuffled follows the overlap and not the corpus. The filter
has 16 bits a hash and 2**27 bits at most (16 MB); a larger benchmark makes it weaker, not wrong.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import SpanHash, mix, packed, row_batches
from tipoff.scratch import stage

# positions each mask selects
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 2, 3, 4, 6), (0, 3, 4, 5, 6, 7))
WINDOW = 13
SUBSTITUTIONS = 2
SHORTEST = 8
SPAN = 8
AROUND = WINDOW - 1
CONTEXT = SPAN + 2 * AROUND
BLOOM_BITS = 1 << 27
HITS = 4_000


def _token_bytes() -> np.ndarray:
    table = np.zeros(256, bool)
    for first, last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (128, 255)):
        table[first : last + 1] = True
    return table


TOKEN_BYTES = _token_bytes()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: runs of digits, letters and characters beyond ASCII, in lower case."""
    data, offsets = packed(pc.utf8_lower(texts.cast(pa.large_string())))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = TOKEN_BYTES[data]
    edge = np.diff(inside)
    # a text's end cuts a token
    starts, ends = edge[:-1] == 1, edge[1:] == -1
    if len(data):
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[firsts] |= TOKEN_BYTES[data[firsts]]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[lasts] |= TOKEN_BYTES[data[lasts]]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return SpanHash(data)(s, e), np.searchsorted(offsets, s, side="right") - 1


def seeds(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token position and hash of every place of every mask within one row."""
    at, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, mask in enumerate(MASKS):
        n = len(hashes) - mask[-1]
        if n <= 0:
            continue
        place = np.flatnonzero(rows[:n] == rows[mask[-1] :])
        total = np.full(len(place), k + 1, np.uint64)
        for i in mask:
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[place + i])
        at.append(place)
        keys.append(total)
    return np.concatenate(at), np.concatenate(keys)


def _contexts(hashes: np.ndarray, rows: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """Tokens around each place as 31-bit numbers, ``outside`` beyond the row."""
    index = at[:, None] + np.arange(-AROUND, SPAN + AROUND)[None, :]
    clipped = index.clip(0, max(len(hashes) - 1, 0))
    short = (hashes >> np.uint64(33)).astype(np.int32)
    return np.where((index == clipped) & (rows[clipped] == rows[at][:, None]), short[clipped], outside).astype(np.int32)


def _emit(ids: np.ndarray | pa.Array, keys: np.ndarray, contexts: np.ndarray, extra: dict | None = None) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * CONTEXT, pa.int32()), pa.array(contexts.ravel(), pa.int32()))
    columns = {"id": ids, "key": pa.array(keys.view(np.int64)), "context": lists, **(extra or {})}
    return pa.RecordBatch.from_pydict(columns)


def _item_seeds(batches):
    for batch in row_batches(batches):
        hashes, rows = tokens(batch.column(1))
        length = np.bincount(rows, minlength=batch.num_rows)
        at, keys = seeds(hashes, rows)
        long_enough = length[rows[at]] >= SHORTEST
        at, keys = at[long_enough], keys[long_enough]
        window = np.minimum(length[rows[at]], WINDOW).astype(np.int32)
        yield _emit(batch.column(0).take(pa.array(rows[at])), keys, _contexts(hashes, rows, at, -2), {"window": pa.array(window)})


def _bit(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (keys & np.uint64(bits - 1)).astype(np.int64), ((keys >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _document_hits(batches, bloom: np.ndarray):
    bits = len(bloom) * 8
    for batch in row_batches(batches):
        hashes, rows = tokens(batch.column(1))
        at, keys = seeds(hashes, rows)
        for k in (0, 1):
            place = _bit(keys, bits)[k]
            keep = (bloom[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            at, keys = at[keep], keys[keep]
        # a hit has a context of 32 numbers, a megabyte of text many hits; they go out in pieces
        for a in range(0, len(at), HITS):
            part, key = at[a : a + HITS], keys[a : a + HITS]
            yield _emit(batch.column(0).take(pa.array(rows[part])), key, _contexts(hashes, rows, part, -1))


def _bloom(seed_table: DataFrame) -> np.ndarray:
    """Bitmap with both bits of every benchmark hash set; made by the executors, 16 MB at most."""
    n = seed_table.count()
    bits = 1 << 16
    while bits < min(16 * n, BLOOM_BITS):
        bits <<= 1
    word = F.explode(F.array(F.col("key").bitwiseAND(bits - 1), F.shiftrightunsigned("key", 32).bitwiseAND(bits - 1)))
    words = (
        seed_table.select(word.alias("bit"))
        .select(F.shiftright("bit", 5).alias("word"), F.expr("shiftleft(1L, cast(bit & 31 as int))").alias("mask"))
        .groupBy("word").agg(F.bit_or("mask").alias("mask")).collect()
    )
    out = np.zeros(bits // 32, np.uint32)
    out[[r.word for r in words]] = [r["mask"] for r in words]
    return out.view(np.uint8)


def overlaps(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, items): the benchmark items found in each contaminated document, smallest item_id for equal items.

    Null and empty texts have no tokens and overlap with nothing; items of fewer than ``SHORTEST`` tokens are
    not looked for. Rows of one doc_id (null is one too) are answered together.
    """
    spark = documents.sparkSession
    items = benchmark.where(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.min("item_id").alias("id"))
    table = stage(items.select("id", "text").mapInArrow(_item_seeds, "id long, key long, context array<int>, window int"), "seeds")
    bloom = spark.sparkContext.broadcast(_bloom(table))
    hits = documents.select(F.col("doc_id").cast("long").alias("id"), F.col(text)).mapInArrow(
        lambda batches: _document_hits(batches, bloom.value), "id long, key long, context array<int>"
    )
    # equal tokens as the bits of one number; a window's count is that of a run of bits, whichever end they are read from
    same = F.expr("aggregate(zip_with(d.context, b.context, (x, y) -> if(x = y, 1L, 0L)), 0L, (bits, x) -> 2 * bits + x)")
    allowed = F.when(F.col("b.window") == WINDOW, SUBSTITUTIONS).otherwise(1)
    verified = (
        hits.alias("d").join(table.alias("b"), F.col("d.key") == F.col("b.key"))
        .select(F.col("d.id").alias("doc_id"), F.col("b.id").alias("item_id"), F.col("b.window").alias("w"), allowed.alias("allowed"), same.alias("same"))
        .where(F.expr(f"exists(sequence(0, {CONTEXT} - w), i -> bit_count(shiftright(same, i) & (shiftleft(1L, w) - 1)) >= w - allowed)"))
    )
    return verified.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))


def mark(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with contaminated (boolean) and items (array, empty if none); columns of those names are replaced."""
    found = overlaps(documents, benchmark, text).select(F.col("doc_id").alias("_id"), F.col("items").alias("_items"))
    kept = documents.drop("contaminated", "items")
    return kept.join(found, kept["doc_id"].cast("long").eqNullSafe(found["_id"]), "left").select(
        *[kept[c] for c in kept.columns],
        F.col("_items").isNotNull().alias("contaminated"),
        F.coalesce("_items", F.expr("cast(array() as array<bigint>)")).alias("items"),
    )
