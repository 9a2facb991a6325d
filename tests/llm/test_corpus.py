"""Operators that compare documents or vectors, and the pipeline, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tipoff.llm import ann, decontaminate, line_dedup, simhash, suffix_array
from tipoff.llm.common import SpanHash, components, prepare

WORDS = "water light stone river house green morning paper table window bread winter summer letter garden music".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


# -- 1

def test_lines(spark):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        host = ["a", "a", "b", None, ""][i % 5]
        lines = [f"line {rng.randrange(400)}" for _ in range(rng.randrange(6))]
        if rng.random() < 0.4:
            lines.insert(rng.randrange(len(lines) + 1), "  share this page ")
        rows.append((i, "\n".join(lines) if i % 17 else None, host, "keep"))
    rows += [rows[7], rows[7], (500, "", "a", "x"), (501, "only\n" * 20_000, "b", "x")]
    got = {}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines string")
    out = line_dedup.drop_boilerplate(df).collect()
    pages, counts = Counter(), Counter()
    for _, text, host, _ in rows:
        pages[host or ""] += 1
        counts.update({(host or "", x.strip(" ")) for x in (text or "").split("\n")})
    assert len(out) == len(rows) and any(r.n_dropped for r in out)
    for r in out:
        got[r.doc_id] = r
    for i, text, host, _ in rows:
        bad = lambda x: x.strip(" ") and counts[host or "", x.strip(" ")] >= 5 and counts[host or "", x.strip(" ")] > 0.1 * pages[host or ""]
        if text is None:
            assert got[i].text is None and got[i].n_lines == got[i].n_dropped == 0
            continue
        lines = text.split("\n")
        assert got[i].text == "\n".join(x for x in lines if not bad(x))
        assert (got[i].n_lines, got[i].n_dropped) == (sum(bool(x.strip(" ")) for x in lines), sum(bool(bad(x)) for x in lines))
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


# -- 4

def test_masks_miss_no_placement():
    for length, allowed in [(decontaminate.WINDOW, decontaminate.SUBSTITUTIONS), *((n, 1) for n in range(decontaminate.SHORTEST, decontaminate.WINDOW))]:
        for wrong in itertools.combinations(range(length), allowed):
            assert any(
                not {o + i for i in m} & set(wrong) for m in decontaminate.MASKS for o in range(length - m[-1])
            ), (length, wrong)


def overlaps_by_hand(docs, items):
    token = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    found = defaultdict(set)
    for (i, text), (k, item) in itertools.product(docs, items):
        d, b = token(text), token(item)
        if len(b) < 8:
            continue
        w = min(len(b), 13)
        need = w - (2 if w == 13 else 1)
        for p, q in itertools.product(range(len(b) - w + 1), range(-2, len(d))):
            if sum(0 <= q + j < len(d) and d[q + j] == b[p + j] for j in range(w)) >= need:
                found[i].add(k)
    return found


def test_hits_of_a_batch_go_out_in_small_pieces():
    words = " ".join(f"w{i}" for i in range(9_000))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([7, 8], pa.int64()), "text": pa.array([words, words])})
    everything = np.full(1 << 13, 255, np.uint8)
    sizes = [b.num_rows for b in decontaminate._document_hits([batch], everything)]
    assert sum(sizes) == 2 * sum(9_000 - mask[-1] for mask in decontaminate.MASKS) and max(sizes) <= 5_000


def test_decontamination(spark):
    prepare(spark)
    rng = random.Random(3)
    items = [(k, prose(rng, rng.choice([5, 8, 10, 13, 20, 30]))) for k in range(12)]
    docs = []
    for i in range(60):
        words = prose(rng, 40).split()
        if i % 2:
            passage = rng.choice(items)[1].split()
            for _ in range(rng.randrange(4)):
                passage[rng.randrange(len(passage))] = "other"
            at = rng.randrange(40)
            cut = rng.randrange(len(passage))
            words[at:at] = passage[cut:] if i % 3 == 0 else passage
        docs.append((i, ", ".join(words).upper() if i % 4 == 1 else "\n".join(words)))
    docs += [(100, None), (101, ""), (102, items[8][1]), (102, items[8][1]), (None, items[9][1]), (103, " ".join([items[10][1]] * 300))]
    bench = spark.createDataFrame([*items, (50, items[7][1]), (51, None), (52, "")], "item_id long, text string")
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    out = decontaminate.mark(df, bench).collect()
    want = overlaps_by_hand(docs, items)
    assert len(out) == len(docs)
    for r in out:
        assert (set(r["items"]), r.contaminated) == (want[r.doc_id], bool(want[r.doc_id])), r.doc_id
    assert decontaminate.mark(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.mark(df.limit(0), bench).count() == 0


# -- 5

def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[20:40] = x[19]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [None] * 16), (2080, []), (2100, [1.0, 2.0]), rows[5]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    vectors = ann.usable(df)
    out = defaultdict(list)
    for r in ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, 20).collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert sorted(out) == list(range(0, 1500, 20))
    for q, found in out.items():
        found.sort()
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert np.allclose([f[2] for f in found], [score[f[1]] for f in found])
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(order))
    assert hits >= 0.9 * 20 * len(out)
    few = vectors.where("vec_id < 5")
    assert ann.nearest(few.where("vec_id = 0"), few, 20).count() == 4
    assert ann.nearest(few.limit(0), few, 20).count() == 0 and ann.nearest(few, few.limit(0), 20).count() == 0


# -- 7

def fingerprint_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints, bits=4):
    keys = sorted(set(prints))
    up = {k: k for k in keys}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if (a ^ b).bit_count() <= bits:
            up[top(a)] = top(b)
    return {k: top(k) for k in keys}


def test_simhash(spark):
    prepare(spark)
    rng = random.Random(6)
    texts = [None, "", " \t\n ", "One", "one", "ÉTÉ a b", "x " * 30_000]
    for _ in range(40):
        words = prose(rng, rng.choice([6, 30, 150])).split()
        for _ in range(rng.randrange(5)):
            texts.append(" ".join(words))
            words[rng.randrange(len(words))] = rng.choice(WORDS)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    rows += [rows[10], rows[11], (None, texts[12]), (None, "alone here")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df).collect()
    prints = [fingerprint_by_hand(t) for _, t in rows]
    top = components_by_hand(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        least[top[p]] = min((x for x in (least.get(top[p]), i) if x is not None), default=None)
    want = Counter((i, p, least[top[p]]) for (i, _), p in zip(rows, prints))
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in out) == want
    kept = simhash.one_of_each(df).collect()
    assert len(kept) == len(set(top.values())) and kept[0].__fields__ == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_links_join_all_that_is_near_in_small_and_large_runs(spark):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = set(rng.getrandbits(64) for _ in range(300))
    for c, size in zip(centres, (5, 40, 300, 900)):
        for _ in range(size):
            p = c
            for b in rng.sample(range(64), rng.randrange(4)):
                p ^= 1 << b
            prints.add(p)
    chain = rng.getrandbits(64)
    for k in range(0, 60, 4):
        chain ^= 0b1111 << k
        prints.add(chain)
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), 4)
    edges = [(r.u % 2**64, r.v % 2**64) for r in found.collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges) and len(edges) < 60 * len(prints)
    roots = {r.node % 2**64: r.root for r in components(found).collect()}
    top = components_by_hand(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[top[p]].add(p)
    for group in groups.values():
        if len(group) > 1:
            assert len({roots[p] for p in group}) == 1 and min(map(signed, group)) == roots[next(iter(group))]
        else:
            assert next(iter(group)) not in roots


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 9

def test_suffix_arrays():
    rng = random.Random(3)
    for _ in range(150):
        n, k = rng.randrange(1, 60), rng.choice([1, 2, 3, 20])
        text = np.array([rng.randrange(1, k + 1) for _ in range(n)] + [0])
        order = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        array = suffix_array.suffix_array(text)
        assert array.tolist() == order
        shared = suffix_array.common_prefixes(text, array, SpanHash(text), 1)
        for a, b in zip(order, order[1:]):
            same = next(i for i in itertools.count() if text[a + i] != text[b + i])
            assert shared[b] == same


def removed_by_hand(docs, length):
    seen = Counter(d[i : i + length] for d in docs for i in range(len(d) - length + 1))
    out = []
    for d in docs:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("wide", [suffix_array.WIDE, 1])
def test_repeats(spark, monkeypatch, wide):
    prepare(spark)
    monkeypatch.setattr(suffix_array, "WIDE", wide)
    rng = random.Random(11)
    shared = [prose(rng, 120) for _ in range(5)]
    texts = [None, "", "short", "aé" * 1500, prose(rng, 60) * 9]
    for _ in range(60):
        parts = [prose(rng, rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            parts += [p[a : a + rng.randrange(350, 900)], prose(rng, rng.randrange(30))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-2][1:], shared[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts) - 3, texts[-3]), (None, prose(rng, 200)), (None, shared[1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    out = suffix_array.remove_repeats(df).collect()
    want = Counter(zip([i for i, _ in rows], removed_by_hand([(t or "").encode() for _, t in rows], 400)))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())) for r in out)
    assert got == want
    assert suffix_array.remove_repeats(df.limit(0)).count() == 0


# -- the pipeline

def test_pipeline(spark, tmp_path):
    rng = random.Random(21)
    item = prose(rng, 25)
    rows, labels = [], []
    for i in range(300):
        text = "\n".join([prose(rng, 60), prose(rng, 50)])
        if i % 2:
            text += "\nfollow us on the net"
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        rows.append((i, text, "en", f"s{i % 2}", len(text)))
        labels.append((i, int(i % 5 != 0), 0))
    rows += [(900, rows[1][1] + " end", "en", "s1", 1), (901, rows[1][1], "en", "s1", 1), (902, prose(rng, 60) + " " + item, "en", "s0", 1),
             (903, None, None, None, None), (904, "", "en", "s0", 0), rows[2]]
    d = str(tmp_path)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "tokens"]
    df = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        out = fn(spark, df, d)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{k}")
        df = spark.read.parquet(f"{d}/{k}")
        kept.append({r.doc_id: r for r in df.collect()})
    good = {i for i in range(300) if i % 5}
    assert len(good - set(kept[0])) <= 3 and len(set(kept[0]) & set(range(0, 300, 5))) <= 3
    assert not any("follow us" in (r.text or "") for i, r in kept[1].items() if i != 900) and len(kept[1]) == len(kept[0])
    assert 901 not in kept[2] and 1 in kept[2] and df.where("doc_id = 2").count() == 1
    assert 902 in kept[2] and 902 not in kept[3] and len(kept[3]) == len(kept[2]) - 1
    assert set(kept[4]) == set(kept[3]) and all(r.n_tokens * 4 == len(r.ids) for r in kept[4].values())
    assert sorted(r.ids_sha256 for r in corpus_pipeline.run(spark, d).collect()) == sorted(r.ids_sha256 for r in df.collect())
    assert df.where(F.col("doc_id").isNull()).count() == 0
