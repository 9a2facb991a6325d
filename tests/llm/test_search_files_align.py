"""Token files, ranked search and alignment of tokenizers: round trips and brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tipoff.llm import align, chunks, search, token_files
from tipoff.llm.common import prepare
from tipoff.scratch import fresh_path

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
BYTE_FILE, PIECE_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [*"  \n\t ab'sZé.1２İΣß́　\x1c\x1f▁​漢字🙂\x00<|>", "<|endoftext|>", "<s>", "<0x0A>", "  ", "   ", " the", " of"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(40))) for _ in range(n)]
    return [*out, "", " ", "  ", "\n", " a ", "a  ", None]


# -- tokenizer libraries by the chunk

@pytest.mark.parametrize("kind, path", [(chunks.Words, WORD_FILE), (chunks.Bytes, BYTE_FILE), (chunks.Pieces, PIECE_FILE)])
def test_chunks_give_the_ids_of_whole_texts(kind, path, monkeypatch):
    monkeypatch.setattr(chunks, "KEPT", 500)  # both generations turn over
    ours = kind(path)
    for part in range(6):
        texts = [t or "" for t in odd_texts(400, seed=part)] + ["the river " * 300, "x" * 5000]
        got = [np.frombuffer(b, "<u4").tolist() for b in ours.encode(texts)]
        if kind is chunks.Pieces:
            want = ours.library.encode(texts)
        else:
            want = [ours.library.encode(t, add_special_tokens=False).ids for t in texts]
        assert got == want


def test_new_words_of_a_column_go_to_the_model_together():
    ours, calls = chunks.Words(WORD_FILE), []
    joined = ours.joined

    class Counted:
        def encode_batch_fast(self, forms, add_special_tokens):
            calls.append(forms)
            return joined.encode_batch_fast(forms, add_special_tokens=add_special_tokens)

    ours.joined = Counted()
    texts = [None, "Zorn, plimquax2 isn't\x1chere", "", "Été\xa0öde İx ²3½\x85end", "a\x7f\x00b " * 40, "漢字 “quoted” e\u0301 <|endoftext|>x", "long" * 300, *odd_texts(300)]
    column = pa.array(["cut off", *texts], pa.string()).slice(1)
    for _ in range(2):  # the second time all is known
        ids, ends = ours.encode_column(column)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ours.library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert 1 <= len(calls) <= 4  # plain words and others, and those of the chunks that are not kept
    assert [len(x) for x in ours.encode_column(column.slice(0, 0))] == [0, 1]


# -- 11

def test_blocks_decode_from_any_place():
    rng = np.random.default_rng(5)
    for size in (1, 2, 300, 50_000):
        counts = np.bincount(rng.zipf(1.3, 40_000) % size, minlength=size)
        table = token_files.Table.scaled(counts)
        assert table.freq.min() >= 1 and int(table.freq.sum()) == 1 << table.bits
        for n in (0, 1, 255, 256, 257, 70_001):
            ids = (rng.zipf(1.3, n) % size).astype(np.uint32)
            data = token_files.block_bytes(3, 17, [(None, True, n)], ids, table)
            block = token_files.Block(data, table)
            assert (block.ids() == ids).all() and block.file == 3 and block.first == 17
            for first in {0, n // 3, max(n - 2, 0)}:
                assert (block.ids(first, first + 40_000) == ids[first : first + 40_000]).all()
    assert len(data) < 4 * n * 0.6
    damaged = bytearray(data)
    damaged[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        token_files.Block(bytes(damaged), table)
    with pytest.raises(ValueError):
        token_files.Block(data, token_files.Table.scaled(np.ones(50_000, np.int64)))


def test_token_files(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(token_files, "LEAST_FILE", 2000)
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 700)
    texts = odd_texts(150)
    rows = [(None if k % 40 == 9 else 1000 - k, t) for k, t in enumerate(texts)]
    rows += [(5, "same row")] * 70 + [(7, "long one " * 3000), (7, "other of this id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("ids2", F.lit(1))
    folder = fresh_path(spark, "t")
    ids = docs.select("doc_id", token_files.encoded(F.col("text"), WORD_FILE, end_id=2).alias("ids"), "start")
    size = chunks.chunked(chunks.Words, WORD_FILE).size
    token_files.write(ids, folder, size)
    got = token_files.documents(spark, folder, with_ids=True).orderBy("start").collect()
    library = chunks.chunked(chunks.Words, WORD_FILE).library
    want = Counter((d, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    flat, stream = 0, []
    for r in got:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == flat and r.n_tokens == len(own) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        want[r.doc_id, tuple(own)] -= 1
        flat += len(own)
        stream += own
    assert not any(want.values()) and len(got) == len(rows)
    order = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert order == sorted(order)
    index = spark.read.parquet(f"{folder}/index")
    assert index.select("file").distinct().count() > 3 and index.agg(F.sum("n_docs")).first()[0] == len(rows)
    for first, last in ((0, 5), (1234, 4321), (flat - 3, flat + 9), (flat + 1, flat + 2)):
        parts = sorted((r.first, bytes(r.ids)) for r in token_files.tokens_between(spark, folder, first, last).collect())
        assert np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist() == stream[first:last]


def test_token_files_of_nothing(spark):
    folder = fresh_path(spark, "t")
    token_files.write(spark.createDataFrame([], "doc_id long, ids binary"), folder, 70_000)
    assert token_files.documents(spark, folder).count() == 0
    assert token_files.tokens_between(spark, folder, 0, 10).count() == 0


# -- 12

def ranked_by_hand(docs, items, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    bags = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 10 + 90 * b.total() * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "naïve", "第一", "THE", "the", "of"]
    weights = [1 / (1 + i) for i in range(400)] + [0.1, 0.1, 0.1, 9, 9, 9]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(1200)]
    docs += [(2000 + i, "the same passage of w17 w350 in a large group") for i in range(600)]
    docs += [(None, "w17 alone"), (3000, None), (3001, ""), (3002, "...;-"), (3003, "w350 " * 3000), (7, "w350 w351"), (7, "w350 w351")]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=12))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "the of"), (103, "the of"), (104, "w17"), (105, "w350; w351 in a large Group")]
    return docs, items


def test_search(spark, searched, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(search, "SHARD_DOCS", 500)
    monkeypatch.setattr(search, "SEED_POSTINGS", 20)
    docs, items = searched
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("terms", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1))
    got = search.rank(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked_by_hand(docs, items, 10), key=key)
    # items in several passes, few documents, no documents, no items
    monkeypatch.setattr(search, "ITEM_BYTES", 200)
    few = [d for d in docs if (d[0] or 0) % 97 == 0]
    got = search.rank(spark.createDataFrame(few, "doc_id long, text string"), asked, k=3)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(ranked_by_hand(few, items, 3), key=key)
    assert search.rank(frame.limit(0), asked).count() == search.rank(frame, asked.limit(0)).count() == 0


def test_summaries_bound_and_skip(searched):
    """Every block's summary is the largest impact of its documents; like documents share blocks."""
    rng = np.random.default_rng(2)
    points = np.repeat(rng.normal(size=(4, search.AXES)), 64, axis=0).astype(np.float32)
    points += rng.normal(size=points.shape).astype(np.float32) * 0.01
    blocks = search.cut_list(points)
    for b in np.unique(blocks):
        assert len({int(i) // 64 for i in np.flatnonzero(blocks == b)}) == 1


def test_index_summaries(spark, searched):
    prepare(spark)
    docs, _ = searched
    vocabulary = {t: i for i, t in enumerate(sorted(b"the of w17 w350 w1 w2 w3 large group".split()))}
    weights = np.arange(1, len(vocabulary) + 1)
    rows = search.forward(spark.createDataFrame(docs, "doc_id long, text string"), vocabulary).withColumn("m", F.lit(50).cast("long"))
    every = np.arange(len(vocabulary))
    seen = 0
    for row in search.build_index(rows, weights, {t: every for t in every.tolist()}).collect():
        dense = np.zeros((len(row.doc_ids), len(vocabulary)), np.int64)
        owner = np.repeat(np.arange(len(row.doc_ids)), np.diff(row.ptr))
        dense[owner, row.terms] = row["values"]
        summary = dict(zip(row.sum_key, row.sum_value))
        for b, t in enumerate(row.block_term):
            members = row.members[row.block_ptr[b] : row.block_ptr[b + 1]]
            assert (dense[members, t] > 0).all()
            if len(members) >= search.LEAST_BLOCK:
                seen += 1
                assert [summary.get(b * len(vocabulary) + c, 0) for c in every.tolist()] == dense[members].max(0).tolist()
        for t in every.tolist():
            members = [m for b, u in enumerate(row.block_term) if u == t for m in row.members[row.block_ptr[b] : row.block_ptr[b + 1]]]
            assert sorted(members) == np.flatnonzero(dense[:, t]).tolist()
    assert seen > 20


# -- 13

def aligned_by_hand(rows):
    names = align.names_of(BYTE_FILE, PIECE_FILE)
    counts, found = Counter(), []
    for d, t in rows:
        links, groups, a, b = [], [], [], []
        if t:
            a, b = names.a.library.encode(" " + t, add_special_tokens=False).ids, names.b.library.encode(t)
            parts_a, parts_b = [names.bytes_a[i] for i in a], [names.bytes_b[i] for i in b]
            if not b"".join(parts_a) == b"".join(parts_b) == (" " + t).encode():
                a, b, parts_a, parts_b = [], [], [], []
            ends_a, ends_b = np.cumsum([len(x) for x in parts_a]).tolist(), np.cumsum([len(x) for x in parts_b]).tolist()
            before = 0
            for end in sorted(set(ends_a) & set(ends_b)):
                mine = [k for k, e in enumerate(ends_a) if before < e <= end]
                theirs = [k for k, e in enumerate(ends_b) if before < e <= end]
                groups.append(",".join(str(a[k]) for k in mine) + "|" + ",".join(str(b[k]) for k in theirs))
                for k in mine:
                    for j in theirs:
                        if max(ends_a[k] - len(parts_a[k]), ends_b[j] - len(parts_b[j])) < min(ends_a[k], ends_b[j]):
                            links.append((a[k], b[j]))
                before = end
        counts.update(links)
        found.append((d, len(a), len(b), ";".join(groups), len(groups), links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (d, n_a, n_b, n, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for d, n_a, n_b, g, n, links in found
    ]


def test_alignment(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(align, "BATCH_BYTES", 3000)
    rows = list(enumerate(odd_texts(300, seed=8)))
    rows += [(500 + i, "Misaligned unbelievable tokenization 漢字漢字 of straightforwardness 🙂🙂") for i in range(40)]
    rows += [(600, "漢" * 400), (601, "the straightforward river " * 400), (None, "no id"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("x")).withColumn("batch", F.lit(1)).repartition(5)
    got = align.align(docs, BYTE_FILE, PIECE_FILE, with_groups=True).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=repr) == sorted(aligned_by_hand(rows), key=repr)
    assert any(r.n_links > r.n_best for r in got) and any(r.n_groups < min(r.n_a, r.n_b) for r in got)
    assert align.align(docs.limit(0), BYTE_FILE, PIECE_FILE).count() == 0
    plain = align.align(docs, BYTE_FILE, PIECE_FILE)
    assert plain.where("groups IS NOT NULL").count() == 0 and sorted(map(key, plain.drop("groups").collect())) == sorted(key(tuple(r)[:8]) for r in got)


def test_cuts_of_long_stretches():
    """Shared ends only far from the middle, none at all, and very many tokens."""
    rng = np.random.default_rng(4)
    for trial in range(200):
        n = int(rng.integers(1, 400))
        a = np.flatnonzero(rng.random(n) < rng.choice([0.1, 0.5, 0.9]))
        b = np.flatnonzero(rng.random(n) < rng.choice([0.1, 0.5, 0.9]))
        if trial % 3 == 0:  # few shared
            b = np.setdiff1d(b, a[2:-2])
        docs = sorted({int(x) for x in rng.integers(0, n, 2)} | {n})
        a, b = (np.unique(np.r_[x, docs]) for x in (a, b))
        a, b = a[a > 0], b[b > 0]
        docs = [d for d in docs if d > 0]
        ptr = lambda e: np.r_[0, np.searchsorted(e, docs, side="right")]
        stop_a, stop_b = align.shared_cuts(a, b, ptr(a), ptr(b))
        both = np.intersect1d(a, b)
        assert (a[stop_a - 1] == both).all() and (b[stop_b - 1] == both).all()
    n = 200_000
    a, b = np.arange(1, n + 1) * 3, np.arange(1, n + 1) * 3 + 1
    b[-1] = a[-1] = 3 * n + 2
    stop_a, _ = align.shared_cuts(a, b, np.array([0, n]), np.array([0, n]))
    assert stop_a.tolist() == [n]
