"""Near copies by Jaccard similarity of word shingles.

Texts of one set of shingles (five words) are one node. Each node has ``BANDS`` keys, each of ``ROWS`` least hashes of
its set; nodes that share a key are candidates, and every link is verified on the whole sets. Two sets of similarity 0.8
share no key with probability (1 - 0.8**4)**20, under 3 in 100,000.

Up to ``RUN`` nodes of one key are compared pair by pair. In larger ones (a large group of near copies) each round

* leaves out nodes that cannot be similar to any other of the key: with ``own`` shingles that no other open node has, a set of
  n shares at most n - own with another, and that is too few for each size of set in the key (an exact bound);
* compares all nodes of a key with one of them, which then leaves the key: the one with the smallest part of own shingles, as
  the text that a group was copied from has. Nodes already in one component are not compared again.

When a round settles little, what is left outside a key's largest component is compared with all other components, but for pairs
that the same bound rules out, so no pair that shares a key goes unseen. No group is ever held in one place, and a round's tables are removed after the next.

Asked to, it also links texts by the fingerprints of ``simhash``. Those links are there before large keys are looked at, so that
what they hold together is not compared again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tipoff.llm.common import components, mix
from tipoff.llm import simhash
from tipoff.llm.simhash import shingle_hashes
from tipoff.scratch import discard, stage

SHINGLE = 5
BANDS, ROWS = 20, 4
RUN = 16
# similarity as a fraction, so that the comparison is exact
SHARE = (4, 5)
STEPS = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)

PRINT = StructType([StructField("code", LongType()), StructField("keys", ArrayType(LongType()))])


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; none for null, empty and blank texts."""
    return np.unique(np.array(shingle_hashes(text or b"", SHINGLE), np.uint64))


def print_of(text: bytes | None) -> tuple[int, np.ndarray]:
    """The code of a text's set and its keys."""
    found = shingles(text)
    if not len(found):
        return 0, np.zeros(0, np.int64)
    least = np.array([mix(found ^ step).min() for step in STEPS]).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    code = mix(np.bitwise_xor.reduce(mix(found))[None] + mix(found + np.uint64(1)).sum()[None])
    return int(code.view(np.int64)[0]), keys.view(np.int64)


@F.arrow_udf(PRINT)
def _prints(text: pa.Array) -> pa.Array:
    made = [print_of(x) for x in text.cast(pa.large_binary()).to_pylist()]
    sizes = np.cumsum([0, *(len(k) for _, k in made)])
    flat = np.concatenate([np.zeros(0, np.int64), *(k for _, k in made)])
    keys = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))
    return pa.StructArray.from_arrays([pa.array([c for c, _ in made], pa.int64()), keys], names=["code", "keys"])


@F.arrow_udf(ArrayType(LongType()))
def _sets(text: pa.Array) -> pa.Array:
    made = [shingles(x).view(np.int64) for x in text.cast(pa.large_binary()).to_pylist()]
    sizes = np.cumsum([0, *map(len, made)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *made]), pa.int64()))


def _keyed(documents: DataFrame, text: str) -> DataFrame:
    """doc_id, text, two hashes that name the row, and the whole row in one column, where no name can clash."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.select(
        "doc_id", F.col(text).alias("text"), F.xxhash64("doc_id", whole).alias("_a"), F.xxhash64(whole, "doc_id").alias("_b"),
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
    )


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets are similar."""
    left = sets.select(F.col("code").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("code").alias("v"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("bigint")
    either = F.size("x") + F.size("y") - shared
    return pairs.distinct().join(left, "u").join(right, "v").where(shared * SHARE[1] >= either * SHARE[0]).select("u", "v")


def _reach(shared: Column, size: Column, other: Column) -> Column:
    """Whether sets of these sizes that share at most ``shared`` shingles can be similar."""
    return SHARE[1] * shared >= SHARE[0] * (size + other - shared)


def _possible(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (key, code, root) whose node can be similar to another of its key, with size and number of own shingles.

    Sizes of a key's sets are kept in classes of one part in a hundred, each by its least size, which errs on the safe side.
    """
    each = rows.select("code").distinct().join(sets, "code").select("code", F.explode("shingles").alias("s"))
    own = each.groupBy("s").agg(F.count("*").alias("n"), F.min("code").alias("code")).where("n = 1").groupBy("code").agg(F.count("*").alias("own"))
    sizes = sets.select("code", F.size("shingles").cast("bigint").alias("size"))
    known = rows.join(sizes, "code").join(own, "code", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    classes = known.groupBy("key", F.floor(F.log("size") * 100).alias("class")).agg(F.min("size").alias("least"))
    there = classes.groupBy("key").agg(F.collect_list("least").alias("there"))
    size, shared = F.col("size"), F.col("size") - F.col("own")
    close = F.exists("there", lambda least: _reach(shared, size, least) & (least * 102 * SHARE[1] >= size * 100 * SHARE[0]))
    return known.join(there, "key").where(close).select("key", "code", "root", "size", "own")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of keys whose nodes are not all in one component."""
    keys = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(keys, "key")


def _hot_links(hot: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """``links`` and those among nodes of keys that many nodes have (key, code)."""
    last, before = None, []
    while True:
        roots = components(links)
        named = hot.join(roots.withColumnRenamed("node", "code"), "code", "left").select("key", "code", F.coalesce("root", "code").alias("root"))
        rows = stage(_open(named), "open")
        possible = stage(_possible(rows, sets), "possible")
        rows_left = stage(_open(possible), "left")
        discard(roots, rows, possible, *before)
        count = rows_left.count()
        if not count:
            discard(rows_left)
            return links
        rounds = last is None or count < 0.75 * last
        if rounds:
            pick = F.struct((F.col("own") / F.col("size")).alias("part"), F.xxhash64("code", "key").alias("order"), F.col("code").alias("hub"), F.col("root").alias("hub_root"))
            hubs = stage(rows_left.groupBy("key").agg(F.min(pick).alias("h")).select("key", "h.hub", "h.hub_root"), "hubs")
            both = rows_left.join(hubs, "key")
            pairs = both.where("root <> hub_root").select(*_pair(F.col("code"), F.col("hub")))
        else:
            sizes = rows_left.groupBy("key", "root").agg(F.count("*").alias("n"))
            main = sizes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m")).select("key", F.col("m.root").alias("main"))
            rest = rows_left.join(main, "key").where("root <> main").select("key", *[F.col(c).alias(f"other_{c}") for c in ("code", "root", "size", "own")])
            shared = F.least(F.col("size") - F.col("own"), F.col("other_size") - F.col("other_own"))
            near = (F.col("root") != F.col("other_root")) & _reach(shared, F.col("size"), F.col("other_size"))
            pairs = rows_left.join(rest, "key").where(near).select(*_pair(F.col("code"), F.col("other_code")))
        found = stage(_verified(pairs, sets), "links")
        links = links.unionByName(found)
        if not rounds:
            discard(rows_left)
            return links
        # a hub has met all others of its key
        hot, last, before = both.where("code <> hub").select("key", "code"), count, [rows_left, hubs]


def _fingerprint_links(prints: DataFrame, max_bits: int) -> DataFrame:
    """Links (u, v) between codes of texts whose fingerprints differ in at most ``max_bits``; ``prints``: code, fp.

    The least code of a fingerprint stands for it.
    """
    pairs = stage(prints.select("code", "fp").distinct(), "code-fingerprints")
    least = stage(pairs.groupBy("fp").agg(F.min("code").alias("least")), "fingerprints")
    equal = pairs.join(least, "fp").where("code <> least").select(*_pair(F.col("code"), F.col("least")))
    near = simhash.links(least.select("fp"), max_bits)
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in ("u", "v")]
    close = near.join(ends[0], "u").join(ends[1], "v").where("least_u <> least_v").select(*_pair(F.col("least_u"), F.col("least_v")))
    found = stage(equal.unionByName(close), "links")
    discard(pairs, least)
    return found


def links(prints: DataFrame, documents: DataFrame, text: str, known: DataFrame | None = None) -> DataFrame:
    """Links (u, v) between codes that join all candidates of similar sets; ``prints``: _a, _b, code, keys.

    ``known`` links are among the result.
    """
    nodes = prints.groupBy("code").agg(F.first("keys").alias("keys"), F.min(F.struct("_a", "_b")).alias("row"))
    spread = stage(nodes.select("code", F.explode("keys").alias("key")), "bands")
    counts = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(spread.join(counts, "key"), "shared")
    wanted = nodes.join(shared.select("code").distinct(), "code").select("code", "row._a", "row._b")
    # a row may be repeated
    sets = stage(
        _keyed(documents, text).select("_a", "_b", "text").join(wanted, ["_a", "_b"]).dropDuplicates(["code"]).select("code", _sets(F.col("text")).alias("shingles")),
        "sets",
    )
    discard(spread)
    few = shared.where(F.col("n") <= RUN).select("key", "code")
    pairs = few.select("key", F.col("code").alias("u")).join(few.select("key", F.col("code").alias("v")), "key").where("u < v").select("u", "v")
    verified = stage(_verified(pairs, sets), "links")
    found = _hot_links(shared.where(F.col("n") > RUN).select("key", "code"), verified if known is None else known.unionByName(verified), sets)
    discard(shared, sets)
    return found


def one_of_each(documents: DataFrame, text: str = "text", max_bits: int | None = None) -> DataFrame:
    """``documents`` with one row of each component: the one with the smallest doc_id, null ids last.

    Null, empty and blank texts have the empty set and are one node. With ``max_bits`` (up to 5), texts whose SimHash fingerprints differ
    in at most so many bits are linked too.
    """
    keyed = _keyed(documents, text)
    fp = [] if max_bits is None else [simhash.fingerprint(F.col("text")).alias("fp")]
    made = keyed.select("doc_id", "_a", "_b", _prints(F.col("text")).alias("p"), *fp)
    prints = stage(made.select("doc_id", "_a", "_b", "p.code", "p.keys", *["fp" for _ in fp]), "prints")
    known = None if max_bits is None else _fingerprint_links(prints, max_bits)
    roots = components(links(prints, documents, text, known))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_a", "_b")
    # one row a code first, so that copies do not cross the join
    firsts = prints.groupBy("code").agg(F.min(order).alias("first"))
    kept = stage(
        firsts.join(roots.withColumnRenamed("node", "code"), "code", "left").groupBy(F.coalesce("root", "code").alias("root"))
        .agg(F.min("first").alias("kept")).select("kept._a", "kept._b"),
        "kept",
    )
    discard(roots, prints)
    return keyed.join(kept, ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]).select("_row.*")
