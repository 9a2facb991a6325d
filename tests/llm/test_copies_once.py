"""Line dedup in the pipeline: a group of copies counts once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tipoff.llm import line_dedup


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_pipeline_keeps_the_text_of_a_large_group_of_copies(spark):
    rng = random.Random(33)
    copy = " ".join(prose(rng, 30)) + "\n" + " ".join(prose(rng, 30))
    rows = [(i, (copy if i % 3 == 0 else " ".join(prose(rng, 40))) + ("" if i % 3 == 0 else "\nshare this"), "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.without_boilerplate(spark, df, "").collect()}
    assert all(out[i] == copy for i in range(0, 60, 3)) and not any("share this" in t for t in out.values())
    # op1 counts rows, as its SQL does
    assert line_dedup.drop_boilerplate(df).where(F.col("doc_id") % 3 == 0).where("text <> ''").count() == 0
