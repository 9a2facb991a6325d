"""Removal of repeated byte strings with suffix arrays built by induced sorting.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes. Strings are compared
within shards, each with a suffix array of its own:

* *Sharding.* A string's anchor is the least hash among its ``GRAM``-byte grams, so equal strings have equal anchors at equal
  offsets. Consecutive starts with one anchor (and one half of its offsets) form a stretch: a piece of text whose strings
  share a core of bytes. The core's hash is the stretch's key; equal strings always meet under one key. Stretches with a key
  of their own cannot hold a repeat and are never shipped. Stretches of equal content count as one, with a weight, so a
  group of copies costs as much as one of them.
* *Arrays.* A shard is the text of many keys' stretches. Suffixes are classified, leftmost-smaller (LMS) ones
  induced into order and named, the names sorted by recursion, and from their order the whole array is induced, bucket by
  bucket in numpy, in linear work. Common prefixes are computed in text order: only where the preceding bytes differ
  are they measured, elsewhere they follow from the place before. Neighbours that share ``LENGTH`` bytes are one string; it is
  repeated if the weights of its places add up to two.
* *Wide keys.* A key with more than ``WIDE`` different stretches is too much for one array. Its strings are
  counted one by one by their hash instead, in an ordinary aggregate.

Ranges come back to all documents by the stretch's key and content. Document texts cross one shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import SpanHash, mix, packed, row_batches
from tipoff.scratch import stage

LENGTH = 400
GRAM = 32
PLACES = LENGTH - GRAM + 1
# offsets of an anchor that one stretch may span; its core has LENGTH - HALF + 1 bytes
HALF = 185
SHARD_BYTES = 1 << 19
WIDE = 20_000
# larger alphabets of a reduced text are ranked by doubling
LARGEST_ALPHABET = 4096


# -- suffix arrays


def _classify(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one that starts right after; the last place is a unique smallest symbol."""
    sign = np.sign(np.diff(text.astype(np.int64)))
    n = len(text)
    at = np.where(sign != 0, np.arange(n - 1), n - 1)
    following = np.minimum.accumulate(at[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = np.where(following < n - 1, np.append(sign, 1)[following] > 0, True)
    return smaller


def _place(array, pointers, symbols, places, backwards: bool) -> None:
    """Append places to their symbols' buckets, in order, from the front or from the back."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    symbols, places = symbols[order], places[order]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    count = np.diff(np.r_[first, len(symbols)])
    rank = np.arange(len(symbols)) - np.repeat(first, count)
    if backwards:
        array[pointers[symbols] - 1 - rank] = places
        pointers[symbols[first]] -= count
    else:
        array[pointers[symbols] + rank] = places
        pointers[symbols[first]] += count


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that follows from ``lms``, the LMS places in order."""
    n = len(text)
    counts = np.bincount(text, minlength=size)
    ends = np.cumsum(counts)
    heads = ends - counts
    array = np.full(n, -1, np.int32)
    symbols = text[lms]
    by_symbol = np.argsort(symbols.astype(np.uint16), kind="stable")
    lms_of = np.searchsorted(symbols[by_symbol], np.arange(size + 1))
    lms_sorted = lms[by_symbol]
    present = np.flatnonzero(counts)
    before = np.r_[text[-1:], text[:-1]]  # symbol before each place
    larger_before = np.r_[False, ~smaller[:-1]]
    pointers = heads.copy()

    for c in present.tolist():
        done = heads[c]
        while done < pointers[c]:
            wave = array[done : pointers[c]]
            done = pointers[c]
            wave = wave[larger_before[wave]]
            if len(wave):
                _place(array, pointers, before[wave], wave - 1, False)
        wave = lms_sorted[lms_of[c] : lms_of[c + 1]]
        wave = wave[larger_before[wave]]
        if len(wave):
            _place(array, pointers, before[wave], wave - 1, False)
    filled = pointers.copy()

    smaller_before = np.r_[False, smaller[:-1]]
    pointers = ends.copy()
    for c in present[::-1].tolist():
        done = ends[c]
        while done > pointers[c]:
            wave = array[pointers[c] : done][::-1]
            done = pointers[c]
            wave = wave[smaller_before[wave]]
            if len(wave):
                _place(array, pointers, before[wave], wave - 1, True)
        wave = array[heads[c] : filled[c]][::-1]
        wave = wave[smaller_before[wave]]
        if len(wave):
            _place(array, pointers, before[wave], wave - 1, True)
    # what is left is the last place, which nothing follows
    array[0] = n - 1
    return array


def _by_doubling(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text over a large alphabet."""
    n, rank, step = len(text), text.astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        new = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(text: np.ndarray, spans: SpanHash | None = None) -> np.ndarray:
    """Suffix array by induced sorting; ``text`` holds small non-negative numbers and ends in its unique smallest."""
    n = len(text)
    if n <= 2:
        return np.argsort(text, kind="stable")
    size = int(text.max()) + 1
    smaller = _classify(text)
    lms = np.flatnonzero(smaller & ~np.r_[True, smaller[:-1]])
    if len(lms) < 2:
        return _induce(text, smaller, lms, size)
    array = _induce(text, smaller, lms, size)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    in_order = array[is_lms[array]]
    # an LMS substring reaches to the next LMS place; equal ones get one name
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:] + 1
    code = (spans or SpanHash(text))(in_order, stop[in_order])
    name = np.empty(n, np.int64)
    name[in_order] = np.cumsum(np.r_[0, code[1:] != code[:-1]])
    reduced = name[lms]
    largest = int(reduced.max()) + 1
    if largest < len(lms):
        inner = suffix_array(reduced) if largest <= LARGEST_ALPHABET else _by_doubling(reduced)
        in_order = lms[inner]
    return _induce(text, smaller, in_order, size)


def common_prefixes(text: np.ndarray, array: np.ndarray, spans: SpanHash, least: int = 1) -> np.ndarray:
    """For each place, how much its suffix shares with the one before it in the array, in text order.

    Where both suffixes follow the same symbol, the prefix is that of the place before less the symbol. Elsewhere it
    is measured, and once in 256 places besides. Prefixes under ``least`` may come out shorter (0 at worst) and those beyond
    may be cut, to ``least`` at the lowest: what reaches ``least`` and what does not is exact.
    """
    n = len(text)
    previous = np.full(n, -1, np.int32)
    previous[array[1:]] = array[:-1]
    place = np.arange(n, dtype=np.int32)
    with_one = previous >= 0
    follows = with_one & (place % 256 != 0) & (previous > 0) & (text[place - 1] == text[previous - 1])
    measured = np.flatnonzero(with_one & ~follows & (np.maximum(place, previous) + least <= n))
    other = previous[measured]
    same = spans(measured, measured + least) == spans(other, other + least)
    measured, other = measured[same], other[same]
    length = np.full(len(measured), least)
    room = n - np.maximum(measured, other)
    step = 128
    while step:
        at = np.flatnonzero(length + step <= room)
        a, b = measured[at] + length[at], other[at] + length[at]
        length[at[spans(a, a + step) == spans(b, b + step)]] += step
        step //= 2
    reach = np.zeros(n, np.int32)
    reach[measured] = length + measured
    return np.where(with_one, np.maximum(np.maximum.accumulate(reach) - place, 0), 0)


def repeated_starts(pieces: list[bytes], weights: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each piece, the places in it where a string of ``length`` bytes starts that starts elsewhere, too.

    A piece of weight w stands for w equal pieces.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    # bytes move up by two: 1 ends a piece, 0 the text
    text = np.zeros(int(sizes.sum()) + len(pieces) + 1, np.int32)
    firsts = np.cumsum(np.r_[0, sizes[:-1] + 1]) if len(pieces) else np.zeros(0, np.int64)
    body = np.ones(len(text), bool)
    body[firsts + sizes] = False
    body[-1] = False
    text[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int32) + 2
    text[firsts + sizes] = 1
    spans = SpanHash(text)
    array = suffix_array(text, spans)
    shared = common_prefixes(text, array, spans, length)[array]
    group = np.cumsum(shared < length)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    owner = np.append(owner, 0)
    place = np.arange(len(text)) - np.append(np.repeat(firsts, sizes + 1), len(text))
    whole = np.append(np.repeat(sizes, sizes + 1), 0) - place >= length
    whole[-1] = False
    counted = np.where(whole[array], np.asarray(weights, np.float64)[owner[array]], 0)
    total = np.bincount(group, weights=counted)
    marked = np.zeros(len(text), bool)
    marked[array] = (total[group] >= 2) & whole[array]
    return [np.flatnonzero(marked[f : f + s]) for f, s in zip(firsts.tolist(), sizes.tolist())]


# -- stretches


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every ``width`` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], front[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, first start, number of starts, key and content hash of every stretch of the packed texts."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    spans = SpanHash(data)
    n = len(data) - GRAM + 1
    grams = spans.windows(GRAM)
    bits = np.uint64(max(n - 1, 1).bit_length())
    ranked = ((grams >> bits) << bits) | np.arange(n, dtype=np.uint64)
    anchor = (_least(ranked, PLACES) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(anchor))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = start + LENGTH <= offsets[row + 1]
    start, anchor, row = start[inside], anchor[inside], row[inside]
    if not len(start):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    half = (anchor - start) // HALF
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (half[1:] != half[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    begin, anchor, half, row = start[first], anchor[first], half[first], row[first]
    core = anchor - half * HALF
    key = mix(spans(core, core + LENGTH - HALF + 1) + half.astype(np.uint64))
    content = mix(spans(begin, begin + count - 1 + LENGTH) * np.uint64(3) + (anchor - begin).astype(np.uint64))
    return row, begin - offsets[row], count, key, content


def _emit_stretches(batches):
    for batch in row_batches(batches, text=2):
        row, at, count, key, content = stretches(*packed(batch.column(2)))
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(take), batch.column(1).take(take), pa.array(at, pa.int32()), pa.array(count, pa.int32()),
             pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
            names=["doc_id", "uid", "at", "starts", "key", "content"],
        )


def _runs(places: np.ndarray) -> list[dict]:
    """Sorted places as runs: first one, and how many."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1) + 1
    return [{"first": int(p[0]), "n": len(p)} for p in np.split(places, cut)]


RUNS = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))


def _shard_runs(batches):
    """Rows (key, content, n, piece) sorted by key and content: repeated starts of each, by shards cut at keys."""
    keys, contents, weights, pieces, held = [], [], [], [], 0

    def made():
        starts = repeated_starts(pieces, np.array(weights))
        return pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.array([_runs(s) for s in starts], RUNS)], names=["key", "content", "runs"]
        )

    for batch in batches:
        for key, content, n, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if keys and key == keys[-1] and content == contents[-1]:
                continue
            if held >= SHARD_BYTES and key != keys[-1]:
                yield made()
                keys, contents, weights, pieces, held = [], [], [], [], 0
            keys.append(key)
            contents.append(content)
            weights.append(min(n, 2))
            pieces.append(piece)
            held += len(piece)
    if keys:
        yield made()


def _string_hashes(batches):
    """The hash of every string of wide stretches: (key, content, n, place, code)."""
    for batch in batches:
        for key, content, n, piece in zip(*(c.to_pylist() for c in batch.columns)):
            place = np.arange(len(piece) - LENGTH + 1)
            code = SpanHash(np.frombuffer(piece, np.uint8))(place, place + LENGTH)
            yield pa.RecordBatch.from_pydict(
                {"key": pa.array(np.full(len(place), key)), "content": pa.array(np.full(len(place), content)), "n": pa.array(np.full(len(place), n)),
                 "place": pa.array(place, pa.int32()), "code": pa.array(code.view(np.int64))}
            )


CUT = "struct<n_removed: bigint, n_spans: bigint, kept: binary, spans: array<struct<first: bigint, stop: bigint>>>"


def _cut_one(data: bytes, runs: list) -> dict:
    spans: list[dict] = []
    for first, n in sorted((r["first"], r["n"]) for r in runs):
        stop = first + n - 1 + LENGTH
        if spans and first <= spans[-1]["stop"]:
            spans[-1]["stop"] = max(spans[-1]["stop"], stop)
        else:
            spans.append({"first": first, "stop": stop})
    edges = [0, *(e for s in spans for e in s.values()), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return {"n_removed": len(data) - len(kept), "n_spans": len(spans), "kept": kept, "spans": spans}


def cut(text: Column, runs: Column) -> Column:
    """Struct of what is left of a text without the strings that start in ``runs``, and of the spans that go."""

    @F.arrow_udf(CUT)
    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        kind = pa.struct([("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()),
                          ("spans", pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())])))])
        rows = zip(texts.cast(pa.large_binary()).to_pylist(), found.to_pylist())
        return pa.array([_cut_one(data or b"", runs or []) for data, runs in rows], kind)

    return run(text, runs)


def remove_repeats(documents: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, spans (first and stop byte of each removed run) and kept (binary, what
    is left of the text in UTF-8).

    A null text counts as empty; texts under ``LENGTH`` bytes lose nothing. Rows repeated with one doc_id and text are each
    other's repeats; a null doc_id is an id like others. What is left of a text may cut a character.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    docs = documents.select(F.col("doc_id"), F.xxhash64(raw).alias("uid"), raw.alias("text"))
    found = stage(docs.mapInArrow(_emit_stretches, "doc_id long, uid long, at int, starts int, key long, content long"), "stretches")
    kinds = found.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "uid", "at")).alias("first"))
    keys = kinds.groupBy("key").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).where(F.col("all") > 1).drop("all")
    shared = stage(kinds.join(keys, "key"), "shared")
    here = F.struct("doc_id", "uid", "at")
    by_doc = (
        found.join(shared, ["key", "content"])
        .groupBy("doc_id", "uid")
        .agg(F.collect_set(F.struct("at", "starts", "key", "content", "n", "kinds", (here.eqNullSafe(F.col("first"))).alias("shown"))).alias("found"))
    )
    joined = docs.alias("d").join(by_doc.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.uid") == F.col("f.uid")), "left").select(
        "d.doc_id", "d.uid", "d.text", "f.found"
    )
    whole = stage(joined, "with_stretches")
    touched = whole.where("found is not null")
    piece = F.expr(f"""transform(filter(found, x -> x.shown), x -> named_struct('key', x.key, 'content', x.content, 'n', x.n,
        'piece', substring(raw, x.at + 1, x.starts - 1 + {LENGTH}), 'kinds', x.kinds))""")
    shown = touched.select(F.col("text").cast("binary").alias("raw"), "found").select(F.inline(piece))
    arrays = (
        shown.where(F.col("kinds") <= WIDE).drop("kinds").repartition("key").sortWithinPartitions("key", "content")
        .mapInArrow(_shard_runs, "key long, content long, runs array<struct<first int, n int>>")
        .where("size(runs) > 0")
    )
    strings = shown.where(F.col("kinds") > WIDE).drop("kinds").dropDuplicates(["key", "content"]).mapInArrow(
        _string_hashes, "key long, content long, n long, place int, code long"
    )
    counted = strings.groupBy("key", "code").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
    wide = (
        strings.join(counted, ["key", "code"]).groupBy("key", "content")
        .agg(F.collect_list(F.struct(F.col("place").alias("first"), F.lit(1).alias("n"))).alias("runs"))
    )
    ranges = arrays.unionByName(wide)
    places = touched.select("doc_id", "uid", F.explode("found").alias("x")).select(
        "doc_id", "uid", F.col("x.key").alias("key"), F.col("x.content").alias("content"), F.col("x.at").alias("at")
    ).distinct()
    removed = (
        places.join(ranges, ["key", "content"])
        .groupBy("doc_id", "uid")
        .agg(F.flatten(F.collect_list(F.expr("transform(runs, r -> named_struct('first', r.first + at, 'n', r.n))"))).alias("runs"))
    )
    out = whole.select("doc_id", "uid", "text").alias("w").join(
        removed.alias("r"), F.col("w.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("w.uid") == F.col("r.uid")), "left"
    )
    left = cut(F.col("w.text"), F.col("r.runs"))
    return out.select("w.doc_id", "w.text", left.alias("cut")).select(
        "doc_id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        "cut.n_removed",
        "cut.n_spans",
        "cut.spans",
        "cut.kept",
    )
