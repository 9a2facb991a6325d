"""The queries over the given tables, one an operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.llm import (
    align, ann, bpe, decontaminate, html_extract, langid, license_scan, line_dedup, quality, search, simhash, suffix_array,
    token_files,
)
from tipoff.llm.chunks import Words, chunked
from tipoff.llm.common import bucket_of, prepare, read
from tipoff.scratch import fresh_path

TOKENIZER = "word_bpe_49k.json"
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_dropped")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_extract.extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars", "n_blocks")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    done = bpe.round_trip(F.col("text"), public_tokenizers.path(TOKENIZER))
    return read(spark, sf_dir, "documents").select("doc_id", done.alias("done")).select(
        "doc_id", "done.n_tokens", "done.ids_sha256", "done.decoded_sha256"
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document whether it holds a passage of the benchmark, and the items."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "contaminated", F.size("items").cast("bigint").alias("n_items"), F.array_join("items", ",").alias("items"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    held_out = F.coalesce(bucket_of("doc_id", 3) == 1, F.lit(False))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    done = langid.predict(F.col("text"), langid.fit(docs))
    held_out = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), done.alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score"
    )


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    done = suffix_array.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the written token files hold them."""
    prepare(spark)
    path, folder = public_tokenizers.path(TOKENIZER), fresh_path(spark, "token-files")
    docs = read(spark, sf_dir, "documents").select("doc_id", token_files.encoded(F.col("text"), path, end_id=2).alias("ids"))
    token_files.write(docs, folder, chunked(Words, path).size)
    return token_files.documents(spark, folder)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    prepare(spark)
    return search.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    return align.align(docs, public_tokenizers.path(TOKENIZER_A), public_tokenizers.path(TOKENIZER_B)).drop("groups")


REGISTRY = {
    fn.__name__: fn
    for fn in (
        op1_line_dedup, op2_html_extract, op3_bpe, op4_decontaminate, op5_ann,
        op6_quality, op7_simhash, op8_langid, op9_suffix_array, op10_license_scan, op11_token_files, op12_ranked_search, op13_alignment,
    )
}

SQL = {
    "op1_line_dedup": """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text FROM documents),
cut AS (SELECT r, doc_id, host, text, string_split(text, chr(10)) AS lines FROM docs),
each AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM cut),
totals AS (SELECT host, count(*) AS pages FROM docs GROUP BY host),
counts AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT r) AS n FROM each WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
bad AS (SELECT c.host, c.line FROM counts c JOIN totals t ON t.host = c.host WHERE c.n >= 5 AND c.n > 0.1 * t.pages),
kept AS (
  SELECT e.r, count(*) FILTER (trim(e.line, ' ') <> '') AS n_lines, count(b.line) AS n_dropped,
         string_agg(e.line, chr(10) ORDER BY e.i) FILTER (b.line IS NULL) AS text
  FROM each e LEFT JOIN bad b ON b.host = e.host AND b.line = trim(e.line, ' ') GROUP BY e.r)
SELECT c.doc_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM cut c LEFT JOIN kept k ON k.r = c.r
""",
    "op12_ranked_search": r"""
WITH items AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
docs AS (SELECT row_number() OVER () AS d, doc_id, text FROM documents),
item_terms AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
doc_terms AS (
  SELECT d, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
postings AS (SELECT d, doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM doc_terms GROUP BY 1, 2, 3),
lengths AS (SELECT d, CAST(sum(tf) AS BIGINT) AS n FROM postings GROUP BY 1),
total AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
measured AS (SELECT l.d, 10 + (90 * l.n * t.docs) // t.terms AS m FROM lengths l, total t),
frequency AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
weights AS (SELECT f.term, CAST(floor(1000 * ln((2 * t.docs + 2)::DOUBLE / (2 * f.df + 1))) AS BIGINT) AS w FROM frequency f, total t),
scores AS (
  SELECT q.i, q.item_id, p.d, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * x.m))) AS BIGINT) AS score
  FROM item_terms q JOIN postings p ON p.term = q.term JOIN weights w ON w.term = q.term JOIN measured x ON x.d = p.d
  GROUP BY 1, 2, 3, 4),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
""",
}
