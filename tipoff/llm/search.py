"""Ranked lexical search: posting lists cut into blocks of like documents, each with its largest value at every coordinate.

Documents are vectors of integer impacts, one coordinate a term; an item's score of a document is the sum over its terms.
The index is built for the terms of a set of items (no other term can score) in shards of ``SHARD_DOCS`` documents:

* every posting list is cut by document similarity: documents are projected on ``AXES`` random axes, members of the list in
  equal steps serve as centres, and each document joins its nearest centre's block;
* a block of ``LEAST_BLOCK`` documents or more stores, for every coordinate that an item with that term can ask for, the largest
  impact among its documents. The sum over an item's terms bounds all scores of the block from above, exactly;
* a block is skipped only if that bound is under a score that ten documents are known to reach.

Three things keep work low without changing results. A first pass scores the documents of each item's rarest terms, which
gives a score that ten documents reach. Terms whose largest impacts together stay under that score need no list: a
document with those alone cannot be among the ten. And shards need nothing of each other, so no list, however common its term, is in one place.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import row_batches, texts
from tipoff.scratch import fresh_path, stage

SHARD_DOCS, SHARD_POSTINGS = 8192, 2_000_000
BLOCK_DOCS, LEAST_BLOCK = 32, 8
AXES = 32
SEED_POSTINGS = 1000  # postings of an item's rarest terms that the first pass scores, the last list whole
ITEM_BYTES = 1 << 20  # text of the items answered in one pass over the index
EXPANDED = 4_000_000  # numbers held at once while summaries are made
SLICE = 1 << 20

# letters, digits and all bytes of characters beyond ASCII make terms; only A-Z are lowered
_TERM = [48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)]
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if _TERM[b] else 32 for b in range(256))


def term_counts(text: str) -> Counter:
    """Terms of a text (UTF-8 bytes) with their numbers; a long text is read in slices."""
    data, counts, at = text.encode("utf-8", "surrogatepass").translate(_TABLE), Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        counts.update(data[at:end].split())
        at = end
    return counts


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats) and, ascending, the vocabulary's terms in each text with their numbers."""

    def run(batches):
        for batch in row_batches(batches):
            n, terms, counts = [], [], []
            for text in texts(batch.column(1)):
                found = term_counts(text)
                n.append(found.total())
                mine = sorted((vocabulary[t], k) for t, k in found.items() if t in vocabulary)
                terms.append([t for t, _ in mine])
                counts.append([k for _, k in mine])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "n", "terms", "tfs"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


def impact(tf, m):
    """The part of a term's impact that the document decides."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Vectors:
    """Impacts of some documents, looked up by (document, term)."""

    def __init__(self, owner: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        self.keys, self.values, self.size = owner.astype(np.int64) * size + terms, values, size  # ascending

    def at(self, owner: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The impacts of every owner at every term, as a matrix; 0 where there is none."""
        keys = owner[:, None].astype(np.int64) * self.size + terms[None, :]
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[place] == keys, self.values[place], 0) if len(self.keys) else np.zeros(keys.shape, np.int64)


def _flat(batch: pa.RecordBatch, weights: np.ndarray):
    """(doc_id column, owner, terms, impacts) of forward rows."""
    lists, counts = batch.column("terms"), batch.column("tfs")
    owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    terms, tfs = lists.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy()
    m = batch.column("m").to_numpy()[owner]
    return batch.column("doc_id"), owner, terms, weights[terms] * impact(tfs, m)


def _best(doc_ids: pa.Array, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores above 0, equal ones by doc_id, null last."""
    ids = doc_ids.take(pa.array(rows)).fill_null(np.iinfo(np.int64).max).to_numpy()
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return rows[order], scores[order]


_HITS = "item int, doc_id bigint, score bigint"


def _hits(found: list[tuple[int, pa.Array, np.ndarray]]) -> pa.RecordBatch:
    ids = pa.chunked_array([f[1] for f in found], pa.int64()).combine_chunks()
    items = np.repeat([f[0] for f in found], [len(f[2]) for f in found]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(items), ids, pa.array(np.concatenate([f[2] for f in found]))], ["item", "doc_id", "score"])


def _seed_scores(rows: DataFrame, items: list[np.ndarray], seeds: list[np.ndarray], weights: np.ndarray, k: int) -> DataFrame:
    """The k best of each batch's documents that hold a seed term of an item."""
    of_term: dict[int, list[int]] = {}
    for i, terms in enumerate(seeds):
        for t in terms.tolist():
            of_term.setdefault(t, []).append(i)
    seeded = np.zeros(len(weights), bool)
    seeded[list(of_term)] = True

    def run(batches):
        for batch in batches:
            ids, owner, terms, values = _flat(batch, weights)
            vectors, of_item = Vectors(owner, terms, values, len(weights)), {}
            at = np.flatnonzero(seeded[terms])
            for d, t in zip(owner[at].tolist(), terms[at].tolist()):
                for i in of_term[t]:
                    of_item.setdefault(i, set()).add(d)
            found = []
            for i, docs in of_item.items():
                docs = np.array(sorted(docs))
                best, scores = _best(ids, docs, vectors.at(docs, items[i]).sum(1), k)
                found.append((i, ids.take(pa.array(best)), scores))
            if found:
                yield _hits(found)

    return rows.mapInArrow(run, _HITS)


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cut_list(points: np.ndarray) -> np.ndarray:
    """Block numbers of a list's documents: the nearest of centres taken from the list in equal steps."""
    k = -(-len(points) // BLOCK_DOCS)
    if k == 1:
        return np.zeros(len(points), np.int64)
    centres = points[np.arange(k) * len(points) // k]
    out = np.empty(len(points), np.int64)
    step = max(1, EXPANDED // k)
    for a in range(0, len(points), step):
        out[a : a + step] = (points[a : a + step] @ centres.T).argmax(1)
    return out


_ARRAYS = {
    "doc_ids": pa.int64(), "ptr": pa.int64(), "terms": pa.int32(), "values": pa.int64(),
    "block_term": pa.int32(), "block_ptr": pa.int64(), "members": pa.int32(), "sum_key": pa.int64(), "sum_value": pa.int64(),
}
_INDEX = ", ".join(f"{name} array<{'int' if kind == pa.int32() else 'bigint'}>" for name, kind in _ARRAYS.items())


def build_index(rows: DataFrame, weights: np.ndarray, asked: dict[int, np.ndarray]) -> DataFrame:
    """One row a shard: its documents' vectors, the blocks of the lists in ``asked`` and the summaries of the blocks.

    ``asked`` names for each term with a list the coordinates its summaries need. A summary's key is block * terms + coordinate.
    """
    size = len(weights)
    axes = np.random.default_rng(7).choice(np.float32([-1, 1]), (size, AXES))
    listed = np.zeros(size, bool)
    listed[list(asked)] = True

    def shard(parts):
        ids = pa.chunked_array([p[0] for p in parts], pa.int64()).combine_chunks()
        shift = np.cumsum([0, *(len(p[0]) for p in parts)])
        owner = np.concatenate([p[1] + s for p, s in zip(parts, shift)])
        terms, values = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        ptr = np.searchsorted(owner, np.arange(len(ids) + 1))
        vectors = Vectors(owner, terms, values, size)
        points = np.zeros((len(ids), AXES), np.float32)
        for a in range(0, len(ids), 512):
            lo, hi = ptr[a], ptr[min(a + 512, len(ids))]
            if hi > lo:
                starts = ptr[a : a + 512] - lo
                full = np.flatnonzero(np.diff(np.r_[starts, hi - lo]))
                points[a + full] = np.add.reduceat(axes[terms[lo:hi]] * values[lo:hi, None].astype(np.float32), starts[full], axis=0)
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        mine = np.flatnonzero(listed[terms])
        mine = mine[np.argsort(terms[mine], kind="stable")]
        list_term, cuts = np.unique(terms[mine], return_index=True)
        block_term, block_sizes, members, keys, tops = [], [], [], [], []
        block = 0
        for t, docs in zip(list_term.tolist(), np.split(owner[mine], cuts[1:])):
            of = cut_list(points[docs])
            order = np.argsort(of, kind="stable")
            docs, sizes = docs[order], np.bincount(of)
            sizes = sizes[sizes > 0]
            coordinates, large = asked[t], np.flatnonzero(sizes >= LEAST_BLOCK)
            begin = np.cumsum(sizes) - sizes
            for a in _runs(large, sizes[large] * len(coordinates)):
                theirs = np.repeat(begin[a] - np.cumsum(sizes[a]) + sizes[a], sizes[a]) + np.arange(sizes[a].sum())
                tall = np.maximum.reduceat(vectors.at(docs[theirs], coordinates), np.cumsum(sizes[a]) - sizes[a], axis=0)
                b, c = np.nonzero(tall)
                keys.append((block + a[b]) * size + coordinates[c])
                tops.append(tall[b, c])
            block_term += [t] * len(sizes)
            block_sizes.append(sizes)
            members.append(docs)
            block += len(sizes)
        empty = [np.zeros(0, np.int64)]
        columns = {
            "doc_ids": ids, "ptr": ptr, "terms": terms, "values": values, "block_term": block_term,
            "block_ptr": np.cumsum(np.concatenate([[0], *block_sizes])), "members": np.concatenate(members or empty),
            "sum_key": np.concatenate(keys or empty), "sum_value": np.concatenate(tops or empty),
        }
        arrays = []
        for name, kind in _ARRAYS.items():
            flat = pa.array(columns[name]).cast(kind)
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(arrays, list(_ARRAYS))

    def run(batches):
        parts, docs, postings = [], 0, 0
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                parts.append(_flat(batch.slice(a, 1024), weights))
                docs, postings = docs + len(parts[-1][0]), postings + len(parts[-1][1])
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    yield shard(parts)
                    parts, docs, postings = [], 0, 0
        if parts:
            yield shard(parts)

    return rows.mapInArrow(run, _INDEX)


def _runs(blocks: np.ndarray, sizes: np.ndarray):
    """Blocks in order, in runs of about ``EXPANDED`` numbers."""
    for part in np.split(blocks, np.flatnonzero(np.diff(np.cumsum(sizes) // EXPANDED)) + 1):
        if len(part):
            yield part


def search_index(index: DataFrame, items: list[np.ndarray], listed: list[np.ndarray], reached: list[int], size: int, k: int) -> DataFrame:
    """(item, doc_id, score) of the documents of each shard that can be among an item's k best.

    ``listed`` are the terms whose lists an item reads, ``reached`` a score that k documents reach (1 if none is known).
    """

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r].values for i, name in enumerate(_ARRAYS)}
                ids = row.pop("doc_ids")
                found = list(_shard_hits(ids, {n: a.to_numpy() for n, a in row.items()}))
                if found:
                    yield _hits(found)

    def _shard_hits(ids, s):
        owner = np.repeat(np.arange(len(ids)), np.diff(s["ptr"]))
        vectors = Vectors(owner, s["terms"], s["values"], size)
        sizes = np.diff(s["block_ptr"])
        blocks = Vectors.__new__(Vectors)
        blocks.keys, blocks.values, blocks.size = s["sum_key"], s["sum_value"], size
        for i, terms in enumerate(items):
            lo, hi = np.searchsorted(s["block_term"], listed[i]), np.searchsorted(s["block_term"], listed[i], side="right")
            mine = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi)] or [np.zeros(0, np.int64)]).astype(np.int64)
            if not len(mine):
                continue
            bound = np.where(sizes[mine] < LEAST_BLOCK, np.iinfo(np.int64).max, blocks.at(mine, terms).sum(1))
            order = np.argsort(-bound, kind="stable")
            mine, bound, need = mine[order], bound[order], reached[i]
            seen = np.zeros(len(ids), bool)
            rows, scores, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            while at < len(mine) and bound[at] >= need:
                upto = min(at + 64, at + int((bound[at:] >= need).sum()))
                docs = np.unique(np.concatenate([s["members"][s["block_ptr"][b] : s["block_ptr"][b + 1]] for b in mine[at:upto].tolist()])).astype(np.int64)
                docs = docs[~seen[docs]]
                seen[docs] = True
                got = np.concatenate([vectors.at(d, terms).sum(1) for d in np.array_split(docs, 1 + len(docs) * len(terms) // EXPANDED)])
                good = got >= need
                rows, scores = _best(ids, np.r_[rows, docs[good]], np.r_[scores, got[good]], k)
                if len(rows) == k:
                    need = max(need, int(scores[-1]))
                at = upto
            if len(rows):
                yield i, ids.take(pa.array(rows)), scores

    return index.mapInArrow(run, _HITS)


def _item_blocks(items: DataFrame):
    """(item_id, distinct terms) of the items with terms, in blocks of about ``ITEM_BYTES`` of text."""
    block, held = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        terms = sorted(term_counts(text or ""))
        if terms:
            block.append((item_id, terms))
            held += len(text)
        if held >= ITEM_BYTES:
            yield block
            block, held = [], 0
    if block:
        yield block


def _answers(docs: DataFrame, block: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    items = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in block]
    size = len(vocabulary)
    rows = stage(forward(docs, vocabulary), "forward")
    n_docs, n_terms = rows.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.where(F.size("terms") > 0).select("doc_id", F.expr(f"10 + (90 * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m"), "terms", "tfs")

    # per term: in how many documents, and the largest impact
    each = rows.select("m", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    part = F.expr("(1000000000L * p.tfs) div (1000L * p.tfs + 8L * m)")
    df, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for t, n, largest in each.groupBy(F.col("p.terms")).agg(F.count("*"), F.max(part)).collect():  # no more rows than the items have terms
        df[t], top[t] = n, largest
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    top *= weights

    seeds = []
    for terms in items:
        held = terms[(df[terms] > 0) & (weights[terms] > 0)]
        held = held[np.argsort(df[held], kind="stable")]
        seeds.append(held[np.cumsum(df[held]) - df[held] < SEED_POSTINGS])
    sown = _top(_seed_scores(rows, items, seeds, weights, k), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    reached = [1] * len(items)
    for item, n, least in sown.collect():  # one row an item of the block
        if n == k:
            reached[item] = least

    listed, asked = [], {}
    for terms, need in zip(items, reached):
        order = terms[np.argsort(top[terms], kind="stable")]
        mine = np.sort(order[np.cumsum(top[order]) >= need])
        listed.append(mine[top[mine] > 0])
        for t in listed[-1].tolist():
            asked.setdefault(t, []).append(terms)
    asked = {t: np.unique(np.concatenate(all_terms)) for t, all_terms in asked.items()}
    built, path = build_index(rows, weights, asked), fresh_path(spark, "postings")
    built.write.option("parquet.block.size", 8 << 20).parquet(path)  # a shard or two at once in memory
    hits = search_index(spark.read.schema(built.schema).parquet(path), items, listed, reached, size, k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id bigint")
    return stage(_top(hits, k).join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def rank(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k documents (doc_id, text) that score highest for each row of ``items`` (item_id, text): item_id, rank, doc_id, score.

    Each row is a document or an item of its own, equal rows too. Null and empty texts have no terms: such a document is in no
    result, such an item has none. Equal scores go by ascending doc_id, null last. Only scores above 0 count. Other columns are left out.
    """
    out = None
    for block in _item_blocks(items):
        part = _answers(docs, block, k)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
