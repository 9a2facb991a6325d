"""Near copies by shingles, against brute force."""

from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline
from tipoff.llm import near_copies, simhash
from tipoff.llm.common import prepare


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def grams(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def kept_by_hand(rows):
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4:
            up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted(least.values())


@pytest.mark.parametrize("run", [near_copies.RUN, 2])
def test_near_copies(spark, monkeypatch, run):
    prepare(spark)
    monkeypatch.setattr(near_copies, "RUN", run)
    rng = random.Random(31)
    texts = [None, "", " \n", "one two", "One  two", "a b c d e f"]
    for size in (1, 2, 3, 4, 5, 25):
        base = prose(rng, 120)
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(120)] = "other" + str(rng.randrange(99))
            texts.append(" ".join(words))
    words = prose(rng, 100)
    for k in range(12):
        texts.append(" ".join(words))
        words[k * 8] = "new"
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_copies.one_of_each(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == kept_by_hand(rows)
    assert near_copies.one_of_each(df.limit(0)).count() == 0


def test_large_groups(spark):
    """Many near the base but not each other, many just too far from all, a chain that leaves the base, and clashing column names."""
    prepare(spark)
    rng = random.Random(33)
    base = prose(rng, 150)
    texts = [" ".join(base)]
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(150), 1 + k % 6):
            words[at] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    words = list(base)
    for at in range(0, 150, 6):  # each is near the one before only
        words[at] = f"chain{at}"
        words[at + 3] = f"chain{at + 3}"
        texts.append(" ".join(words))
    rows = [(i * 7 % 1009, t, "a", "b", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _a string, _b string, code long")
    out = near_copies.one_of_each(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(r.doc_id for r in got) == kept_by_hand([r[:2] for r in rows])
    assert {(r._a, r._b, r.code) for r in got} == {("a", "b", 1)}


def test_pipeline_takes_out_a_copy_with_words_replaced(spark):
    rng = random.Random(32)
    words = prose(rng, 200)
    changed = list(words)
    for at in (50, 100, 150):
        changed[at] = "other"
    df = spark.createDataFrame([(1, " ".join(words)), (900, " ".join(changed)), (2, " ".join(prose(rng, 200)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()) == [1, 2]


def test_pipeline_links_by_fingerprint_too(spark):
    """texts a few bits apart are one group though they share few distinct shingles, and such a link joins others' groups."""
    rng = random.Random(34)
    often = " ".join(prose(rng, 31) * 50)
    one, other = (f"{often} {' '.join(prose(rng, 100))}" for _ in range(2))
    assert (simhash.fingerprint_of(one.encode()) ^ simhash.fingerprint_of(other.encode())).bit_count() <= simhash.MAX_BITS
    assert len(grams(one) & grams(other)) * 5 < len(grams(one) | grams(other)) * 4
    words = prose(rng, 200)
    changed = [*words[:100], "other", *words[101:]]
    rows = [(5, one), (3, other), (7, f"{one} more"), (1, " ".join(words)), (2, " ".join(changed)), (9, " ".join(prose(rng, 200)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, df, "").collect()) == [1, 3, 9]
    assert corpus_pipeline.one_of_each_group(spark, df.limit(0), "").count() == 0
