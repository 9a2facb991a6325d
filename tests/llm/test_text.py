"""BPE, quality, language, HTML and licence operators on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tipoff.llm import bpe, html_extract, langid, license_scan, quality
from tipoff.llm.common import prepare

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz' ,.!éß0123"
    out = ["", " ", "a" * 3000, "don't WE'LL i've", "x<|endoftext|> y<|startoftext|>", "<|endoftext|>", "İΣΣ ẞ", "é Å",
           "漢字かな \U0001f389\U0001f389", "1234567890" * 20, "\x1c\x85​　z", "THE!! END$$$ of%%%"]
    return out + ["".join(rng.choice(letters) for _ in range(200)) for _ in range(150)]


def test_bpe_equals_the_library(library):
    codec = bpe.Codec(PATH)
    texts = odd_texts()
    for ids, text, want in zip(codec.encode(texts), texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_speculation_is_used_and_checked():
    codec = bpe.Codec(PATH)
    words = sorted({w for t in odd_texts() for w in re.findall("[a-z]+", t)})
    forms = [codec.symbols(w) for w in words]
    guesses = [codec.speculate(f) for f in forms]
    exact = [codec.merge(f) for f in forms]
    wrong = sum(g != e for g, e in zip(guesses, exact))
    assert 0 < wrong < len(words)
    codec.encode_words(words)
    assert [np.frombuffer(codec.cache[w], "<u4").tolist() for w in words] == exact


def test_bpe_columns(spark, library):
    prepare(spark)
    rows = [(1, "Hello there", "x"), (2, None, "y"), (3, "", None), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    done = df.select("doc_id", bpe.round_trip(F.col("text"), PATH).alias("d")).select("doc_id", "d.*").orderBy("doc_id").collect()
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert done[0].n_tokens == len(ids)
    assert done[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert done[0].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert [r.n_tokens for r in done[1:]] == [0, 0, 0] and len({r.ids_sha256 for r in done[1:]}) == 1
    back = df.select(bpe.decode(bpe.encode(F.col("text"), PATH), PATH).alias("t")).collect()
    assert back[0].t == library.decode(ids, skip_special_tokens=False) and back[1].t == ""
    assert df.limit(0).select(bpe.encode(F.col("text"), PATH)).count() == 0


def labelled(spark, n=160):
    rng = random.Random(2)
    words = "water light stone river house green morning paper table window bread winter".split()
    rows, labels = [], []
    for i in range(n):
        sentence = [rng.choice(words) for _ in range(60)]
        good = i % 2
        rows.append((i, " ".join(sentence) + "." if good else " ".join(w.upper() + "!!" for w in sentence)))
        labels.append((i, good, 0))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_tells_classes_apart(spark):
    prepare(spark)
    docs, labels = labelled(spark)
    model = quality.fit(docs, labels)
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "a"), (1003, "GREEN!! " * 30_000)], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.classify(docs.unionByName(odd), model).collect()}
    assert np.mean([out[i].predicted == i % 2 for i in range(160)]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[1000].score == out[1001].score and out[1003].predicted == 0
    assert quality.classify(docs.limit(0), model).count() == 0


def test_quality_with_one_class_or_none(spark):
    prepare(spark)
    docs, labels = labelled(spark, 20)
    for some in (labels.where("quality = 1"), labels.limit(0), labels.withColumn("quality", F.lit(None).cast("int"))):
        assert all(0 <= r.score <= 1 for r in quality.classify(docs, quality.fit(docs, some)).collect())


def test_quality_ignores_held_out_labels(spark):
    docs, labels = labelled(spark)
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(docs, labels) == quality.fit(docs, turned)


def spoken(spark):
    rng = random.Random(4)
    made = {"aa": "the and ing tion of with that", "bb": "der und sch ein ich nicht das", "cc": "le la des une pour dans que"}
    rows = []
    for i in range(240):
        lang = sorted(made)[i % 3]
        rows.append((i, " ".join(rng.choice(made[lang].split()) for _ in range(30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    prepare(spark)
    docs = spoken(spark)
    model = langid.fit(docs)
    assert sorted(model) == ["aa", "bb", "cc"]
    out = docs.withColumn("p", langid.predict(F.col("text"), model)).select("lang", "p.lang", "p.score").collect()
    assert np.mean([r[0] == r[1] for r in out]) > 0.98 and all(0 <= r[2] <= 1 for r in out)
    odd = spark.createDataFrame([(None,), ("",), ("123 !!",), ("漢字" * 50_000,), ("the",)], "text string")
    got = [r.p.lang for r in odd.select(langid.predict(F.col("text"), model).alias("p")).collect()]
    assert got[:3] == ["und"] * 3 and got[3] in model and got[4] == "aa"
    assert [r.p.lang for r in odd.select(langid.predict(F.col("text"), {}).alias("p")).collect()] == ["und"] * 5
    assert langid.fit(docs.limit(0)) == {}


def test_language_profile_is_the_bundle_of_bound_letters():
    tools = langid._Letters()
    made, has = langid._profiles(["ab", "7"], tools)
    codes = np.array([32, ord("a"), ord("b"), 32])
    v = tools.matrix(codes).astype(float)
    want = sum(np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2] for i in range(2))
    assert np.allclose(made[0], want / np.linalg.norm(want), atol=1e-5) and has.tolist() == [True, False]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><p>no";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site, accept?</div>
<main><article><h1>Fish &amp; chips</h1><p>First   paragraph of&nbsp;some<br>length &eacute; here.</p><p>Of.</p>
<div class="ad">Buy now, this long advert says so many words in a row.</div><aside>Related things to read</aside><p>Last.</article>
<section id="comments"><p>A reader says a long thing about all of this article today.</p></section></main>
<form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    prepare(spark)
    bare = "<p>" + "word " * 40 + "</p><p>" + "more " * 30 + "<p><a href='x'>next page</a>"
    rows = [(1, "u", PAGE, "old"), (2, "u", None, None), (3, "u", "", None), (4, "u", bare, None), (5, "u", "<p>cut &am", None), (5, "u", "<p>cut &am", None)]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert out[1].text == "Fish & chips\n\nFirst paragraph of some length é here.\n\nOf.\n\nLast."
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == "" and out[2].n_chars == 0
    assert out[4].text == " ".join(["word"] * 40) + "\n\n" + " ".join(["more"] * 30)
    assert html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def test_html_wrappers_and_missing_ends():
    page = """<html><head><meta charset=x><body class="has-sidebar"><div class="page-menu wrapper"><main><p>Crumbs here</p><article class=post>
<p>One two.<p>Three <i>four</i>.</article><section class=comments><article><p>I say so too.</article></section></main></div><!-- open"""
    assert [(b[0], b[-2], b[-1]) for b in html_extract.blocks(page)] == [
        ("Crumbs here", -1, 0), ("One two.", 1, 0), ("Three four.", 1, 0), ("I say so too.", 1, 1),
    ]
    assert [b[-2] for b in html_extract.blocks("<div><main><p>a<p>b</main><p>c")] == [1, 1, -1]


def test_html_tree_is_what_spark_predicts(spark):
    tree = html_extract.fit(spark)
    rows = [tuple(map(float, line.split())) for line in html_extract.LABELLED.strip().splitlines()]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in html_extract.FEATURES) + ", label double")
    hit = df.select((html_extract.wanted(F.struct(*html_extract.FEATURES), tree) == (F.col("label") > 0.5)).alias("ok")).where("ok").count()
    assert hit >= 0.95 * len(rows)


def test_html_tree_uses_words_and_links_of_both_neighbours(spark):
    used = {html_extract.FEATURES[int(k)] for k in re.findall(r"feature (\d+)", html_extract.fit(spark))}
    assert {"words_before", "links_before", "words_after", "links_after"} <= used


def test_html_text_outside_a_teaser_or_comment_is_kept(spark):
    prepare(spark)
    story = ["<p>" + " ".join(f"{w}{i}" for i in range(50)) + "</p>" for w in ("red", "blue", "green")]
    menu = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    teaser = menu + "".join(story) + "<article><p>Read this other thing.</article>" + menu
    comment = "".join(story) + "<div class='comments-wrapper'><article><p>I say so too, and at length.</article></div>"
    inside = "<article>" + "".join(story) + "<p>Share</p>" + menu + "<p>More here</p>" + menu + "</article>"
    rows = [(1, teaser), (2, comment), (3, inside)]
    out = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert all(f"{w}49" in out[k] for k in out for w in ("red", "blue", "green"))
    assert "Home" not in out[1]
    assert "I say so" not in out[2]
    assert "Home" not in out[3]
    assert "More here" not in out[3]


def by_hand(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = {}
    for phrase, label in license_scan.BASE:
        p = phrase.split()
        places[label] = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return words, places


def test_licence_base_places(spark):
    rng = random.Random(1)
    bits = ["MIT", "License", "apache", "general", "Public", "license.", "éMIT", "mit-license", "GPL", "x", "1", "\n"]
    texts = [None, "", "!!", "mit license " * 5000] + [" ".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in license_scan.scan(df).collect():
        words, places = by_hand(texts[r.doc_id])
        every = [p for v in places.values() for p in v]
        assert r.n_words == len(words) and r.n_base == len(every)
        assert (r.first_word, r.last_word) == ((min(every), max(every)) if every else (None, None))
        assert r.base_labels == sorted(k for k, v in places.items() if v)
        assert set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert license_scan.scan(df.limit(0)).count() == 0


def suppressed(norm):
    """Detections by plain Python: all matches, then those in a longer or earlier one of as good a rank fall out."""
    found = []
    for k, (label, rx, _, _, rank, sure) in enumerate(license_scan.rules()):
        found += [(m.start(), -m.end(), rank, k, label, sure) for m in re.finditer(rf"\b(?:{rx})\b", norm)]
    found.sort()
    return [
        (label, rank, s, -e)
        for i, (s, e, rank, _, label, _) in enumerate(found)
        if not any(f[2] <= rank and f[0] <= s and -f[1] >= -e for f in found[:i])
    ]


def test_licence_rules_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["licensed under", "released under the terms of", "the", "mit", "apache", "license", "version 2.0", "gnu general public", "cc by-nc", "4.0", "mozilla public",
            "spdx-license-identifier:", "gpl", "3", "bsd 3 clause", "all rights reserved", "public domain", "and", "licence"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(license_scan.rules()) > 300
    for r in license_scan.scan(df).collect():
        words, _ = by_hand(texts[r.doc_id])
        assert sorted((d.label, d["rank"], d.start, d.stop) for d in r.detections) == sorted(suppressed(" ".join(words))), texts[r.doc_id]


def test_licence_keywords_are_in_every_match():
    for label, rx, key, word, _, _ in license_scan.rules():
        rx = rx.replace("licen[sc]", "licens")
        plain = re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", rx)
        assert re.search(license_scan.GATE, rx), (label, rx)
        assert any(key.strip().split()[0] in x for x in (rx, plain)), (label, rx, key)
