"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A text is compressed
under both; (size with the bad one - size with the good one) / (bytes of the text) says which kind it is
like, and a logistic curve fitted on other labelled rows turns that into a score.

The dictionaries know 64 KB each, so a text is compressed in pieces of ``PIECE`` bytes, all of them: in one
stream a long text would soon refer to itself rather than to the dictionary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff.llm.common import bucket_of, hash_share, texts

PIECE = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# bytes of text at which its own evidence weighs as much as the share of good labels
SHORT = 64
# labelled rows a class that the model is fitted on, half of them for the dictionary and half for the curve
ROWS_PER_CLASS = 1000


def _pieces(text: str) -> list[bytes]:
    data = text.encode()
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def _dictionary(samples: list[str]) -> bytes:
    pieces = [p for s in samples for p in _pieces(s) if len(p) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: the samples are the dictionary
        return b"\n".join(pieces)[-DICTIONARY_BYTES:]


def _compressors(model: dict) -> list:
    out = []
    for data in (model["bad"], model["good"]):
        dictionary = zstandard.ZstdCompressionDict(data) if data else None
        if dictionary is not None:
            dictionary.precompute_compress(level=LEVEL)
        out.append(
            zstandard.ZstdCompressor(
                level=LEVEL, dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False
            )
        )
    return out


def _difference(text: str, compressors: list) -> float:
    pieces = _pieces(text)
    sizes = [sum(len(c.compress(p)) for p in pieces) for c in compressors]
    return (sizes[0] - sizes[1]) / max(sum(map(len, pieces)), 1)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a weak pull towards 0."""
    rows, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        pull = np.array([1e-4, 1e-4])
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + np.diag(pull), rows.T @ (y - p) - pull * w)
        w = w + step
        if abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(documents: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> dict:
    """The model: both dictionaries and the curve, from at most ``rows_per_class`` whole labelled texts a class.

    Rows come in the order of a hash of doc_id; rows whose crc32(doc_id) mod 3 is 1 are never used. A doc_id
    labelled both ways, null labels and null texts take no part. With a class missing the score is its share.
    """
    known = (
        labels.where("quality in (0, 1) and doc_id is not null").where(bucket_of("doc_id", 3) != 1)
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    order = Window.partitionBy("quality").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    counts = dict(known.groupBy("quality").count().collect())
    chosen = hash_share(known, "quality", counts, rows_per_class).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= rows_per_class)
    rows = (
        # at most two classes of rows_per_class ids: small enough to broadcast at any size of the corpus
        documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen.select("doc_id", "quality", "rn")), "doc_id")
        .groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("rn").alias("rn"), F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda r: (r.quality, r.rn))
    part = {(q, h): [r.text for r in rows if r.quality == q and r.rn % 2 == h] for q in (0, 1) for h in (0, 1)}
    model = {"bad": _dictionary(part[0, 1]), "good": _dictionary(part[1, 1])}
    total = sum(counts.values())
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    prior = float(np.log(share / (1 - share)))
    if not part[0, 0] or not part[1, 0]:
        return {**model, "slope": 0.0, "offset": prior, "prior": prior}
    tools = _compressors(model)
    x = np.array([_difference(t, tools) for q in (0, 1) for t in part[q, 0]])
    y = np.repeat([0.0, 1.0], [len(part[0, 0]), len(part[1, 0])])
    slope, offset = _curve(x, y)
    # the curve saw equal caps of both classes; move it to the shares among all labels
    seen = len(part[1, 0]) / len(y)
    return {**model, "slope": slope, "offset": offset + prior - float(np.log(seen / (1 - seen))), "prior": prior}


def probability(text: str, tools: list, model: dict) -> float:
    """The curve at the text's difference; the shorter a text, the nearer to the share of good labels."""
    size = len(text.encode())
    z = _difference(text, tools) * model["slope"] + model["offset"]
    z = (size * z + SHORT * model["prior"]) / (size + SHORT)
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def score(text: Column, model: dict) -> Column:
    """0 to 1 for a text, higher for good ones; null and empty texts get the share of good labels."""
    made: list = []

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        if not made:
            made.extend(_compressors(model))
        return pa.array([probability(t, made, model) for t in texts(column)], pa.float64())

    return run(text)


def classify(documents: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``documents`` with score and predicted (1 from a score of 0.5); columns of those names are replaced."""
    return documents.withColumn("score", score(F.col(text), model)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
