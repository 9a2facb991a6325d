"""Line dedup by site-relative frequency.

Pages are grouped by host. For every line of a host, the pages that hold it are counted and divided by
the host's pages; a line above the boilerplate ratio is dropped from all pages of that host.

Counting: each page gives its distinct lines once, as two hashes (96 bits), and counts are combined
before the shuffle, so a line on a third of all pages is one row per map task. A host has at most
(mean distinct lines a page) / ``ratio`` lines above the ratio, so the lines to drop are one short array
a host; pages are joined to it by (host, slice), each host's array being repeated over ``SLICES`` slices so
that the pages of a hot host are spread. Page texts cross one shuffle, or none when the arrays are small enough for
the planner to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATIO = 0.1
MIN_PAGES = 5
SLICES = 32


def _code(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def drop_boilerplate(
    pages: DataFrame, host: Column | str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``pages`` with ``text`` rid of boilerplate lines, plus n_lines and n_dropped (bigint).

    Lines are cut at ``\\n`` and compared trimmed of blanks; empty lines are never counted or dropped. A line
    goes if it is on at least ``min_pages`` pages of its host and on more than ``ratio`` of them. Every row is a
    page, repeated rows too; with ``copies_once`` all rows of one host and text are one page. A null host is a host of its own, the same as the empty one; a null text stays
    null, counts as a page and has 0 lines. A page that loses every line keeps an empty text.
    Columns of the input are kept; ``n_lines`` and ``n_dropped`` replace columns of that name.
    """
    key = F.coalesce(F.expr(host) if isinstance(host, str) else host, F.lit(""))
    work = pages.drop("n_lines", "n_dropped").select(
        F.struct("*").alias("_page"), key.alias("_host"), F.split(F.col(text), "\n", -1).alias("_lines")
    )
    copy = _code(F.col(f"_page.{text}")).alias("copy")
    voters = work.select("_host", copy).distinct() if copies_once else work
    totals = voters.groupBy("_host").agg(F.count("*").alias("pages"))
    codes = F.transform(F.filter(F.transform("_lines", lambda x: F.trim(x)), lambda x: x != ""), _code)
    held = F.explode(F.array_distinct(codes)).alias("code")
    votes = work.select("_host", copy, held).distinct() if copies_once else work.select("_host", held)
    counts = (
        votes
        .groupBy("_host", "code").agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    bad = (
        counts.join(totals, "_host").where(F.col("n") > ratio * F.col("pages"))
        .groupBy("_host").agg(F.collect_list("code").alias("_bad"))
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    )
    sliced = work.withColumn("_slice", F.pmod(F.xxhash64("_page"), F.lit(SLICES)).cast("int"))
    joined = sliced.join(bad, ["_host", "_slice"], "left")
    dropped = F.filter("_lines", lambda x: (F.trim(x) != "") & F.array_contains(F.col("_bad"), _code(F.trim(x))))
    kept = F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("_bad"), _code(F.trim(x))))
    whole = F.col(f"_page.{text}")
    return joined.select(
        *[
            F.when(F.col("_bad").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias(c) if c == text
            else F.col("_page")[c].alias(c)
            for c in pages.drop("n_lines", "n_dropped").columns
        ],
        F.coalesce(F.array_size(F.filter("_lines", lambda x: F.trim(x) != "")), F.lit(0)).cast("bigint").alias("n_lines"),
        F.when(F.col("_bad").isNull() | F.col("_lines").isNull(), F.lit(0)).otherwise(F.array_size(dropped)).cast("bigint").alias("n_dropped"),
    )
