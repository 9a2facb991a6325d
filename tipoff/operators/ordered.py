"""Ordered features within a group: trailing means, running totals, gaps and ordinals.

Every feature looks only at rows *before* the current one. Two physical plans give the same rows:

* ``window``: one ``Window`` over the group. One shuffle, one sort, all features in one pass. Right as
  long as the largest group fits a task.
* ``chunked``: for a group of any size, also one that holds a third of all rows. Rows are range-partitioned
  by (group, order), which splits a hot group at evenly sampled points, and staged with their chunk
  number. The window then runs per (group, chunk). What a chunk must know about the rows before it
  travels as extra rows put in front of it: the last N rows (for trailing frames) and one carry row
  with the totals so far. Only those few rows per chunk are ever gathered by group.

``auto`` stages the rows once and finds the large groups with a heavy-hitter sketch in that same pass. Only
the groups that the sketch names are chunked; all others go through the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tipoff.scratch import stage

MAX_GROUP_ROWS = 2_000_000
CHUNK_ROWS = 1_000_000
# of the sketch: groups it keeps count of, and the most it names; a group it may overlook has under one row in 49,000
SKETCH_GROUPS = 1 << 16
NAMED_GROUPS = 5_000


@dataclass(frozen=True)
class TrailingMean:
    """Mean of ``column`` over the ``rows`` rows before this one; NULLs keep their slot but are skipped."""

    name: str
    column: str
    rows: int


@dataclass(frozen=True)
class Before:
    """``sum``, ``count``, ``max`` or ``mean`` of ``column`` over all rows before this one."""

    name: str
    column: str
    how: str


@dataclass(frozen=True)
class GapDays:
    """Days between this row's date and the previous row's, minus one; NULL on the first row."""

    name: str
    column: str


Spec = TrailingMean | Before | GapDays


@dataclass(frozen=True)
class Hot:
    """Groups too large for one task, by the hash of their keys, with (about) the rows they have."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...]
    rows: int

    def split(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of other groups, rows of these groups)."""
        named = F.xxhash64(*self.keys).isin(list(self.hashes))
        return df.where(~named), df.where(named)


def measured(df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> tuple[DataFrame, Hot]:
    """``df`` staged, and its groups of more than ``max_group_rows`` rows, from a sketch of frequent key hashes taken while
    the rows are written. A hash shared by two groups only sends a smaller one the longer way."""
    if not keys:
        seen = Observation("rows")
        staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), "ordered")
        n = seen.get["n"]
        return staged, Hot((), (), n if n > max_group_rows else 0)
    seen = Observation("groups")
    staged = stage(df.observe(seen, _sketch(keys)), "ordered")
    return staged, _named(keys, seen.get["top"], max_group_rows)


def frequent(df: DataFrame, keys: Sequence[str], max_group_rows: int = MAX_GROUP_ROWS) -> Hot:
    """The large groups of a ``df`` that is cheap to read again: a pass over its key columns, and nothing is staged."""
    return _named(keys, df.agg(_sketch(keys)).first()["top"], max_group_rows)


def _sketch(keys: Sequence[str]) -> Column:
    return F.expr(f"approx_top_k(xxhash64({', '.join(f'`{k}`' for k in keys)}), {NAMED_GROUPS}, {SKETCH_GROUPS})").alias("top")


def _named(keys: Sequence[str], top, max_group_rows: int) -> Hot:
    large = [(row["item"], row["count"]) for row in top or [] if row["count"] > max_group_rows]
    return Hot(tuple(keys), tuple(h for h, _ in large), sum(n for _, n in large))


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Spec],
    strategy: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    chunk_rows: int = CHUNK_ROWS,
    hot: Hot | None = None,
) -> DataFrame:
    """``df`` plus one column per spec. ``order`` must be a total order within ``keys``.

    ``hot`` is what ``measured`` found for some of the keys, if the caller has it already: groups by more keys are no larger.
    """
    keys, order = list(keys), list(order)
    if strategy not in ("auto", "window", "chunked"):
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "chunked":
        return _chunked(df, keys, order, specs, max(2, -(-df.count() // chunk_rows)))
    if strategy == "auto" and hot is None:
        df, hot = measured(df, keys, max_group_rows)
    window = Window.partitionBy(*keys).orderBy(*order)
    plain = lambda rows: rows.select("*", *[_plain(spec, window) for spec in specs])
    if strategy == "window" or not hot.rows:
        return plain(df)
    chunks = max(2, -(-hot.rows // chunk_rows))
    if not hot.keys:
        return _chunked(df, keys, order, specs, chunks)
    others, large = hot.split(df)
    return plain(others).unionByName(_chunked(large, keys, order, specs, chunks))


def ordinal(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, **options) -> DataFrame:
    """1-based position of each row in its group, as ``row_number`` but safe for hot groups."""
    counted = with_history(df.withColumn("_one", F.lit(1)), keys, order, [Before("_n", "_one", "count")], **options)
    return counted.withColumn(name, F.col("_n") + 1).drop("_one", "_n")


def _before(window, how: str, column: Column) -> Column:
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return {"sum": F.sum, "count": F.count, "max": F.max, "mean": F.avg}[how](column).over(frame)


def _plain(spec: Spec, window) -> Column:
    if isinstance(spec, TrailingMean):
        return F.avg(spec.column).over(window.rowsBetween(-spec.rows, -1)).alias(spec.name)
    if isinstance(spec, GapDays):
        return (F.datediff(spec.column, F.lag(spec.column).over(window)) - 1).alias(spec.name)
    return _before(window, spec.how, F.col(spec.column)).alias(spec.name)


def _parts(spec: Before) -> list[str]:
    return ["sum", "count"] if spec.how == "mean" else [spec.how]


_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max}
_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max}


def _chunked(
    df: DataFrame, keys: list[str], order: list[str], specs: Sequence[Spec], chunks: int
) -> DataFrame:
    rows = stage(
        df.repartitionByRange(chunks, *keys, *order).withColumn("_chunk", F.spark_partition_id()), "chunks"
    )
    running = [spec for spec in specs if isinstance(spec, Before)]
    looking_back = {s.column for s in specs if not isinstance(s, Before)}
    depth = max([s.rows if isinstance(s, TrailingMean) else 1 for s in specs if not isinstance(s, Before)], default=0)
    group = [*keys, "_chunk"]

    # totals of all earlier chunks of the group: one small row per (group, chunk)
    totals = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[_AGGREGATE[part](s.column).alias(f"_{part}_{s.name}") for s in running for part in _parts(s)],
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_{part}_{s.name}": part for s in running for part in _parts(s)}
    lead_in = totals.select(
        *group,
        F.lit(0).alias("_kind"),
        *[_COMBINE[part](name).over(earlier).alias(name) for name, part in carried.items()],
    )

    # the last ``depth`` rows before the chunk. The rows before a chunk's first tail row, among the
    # tails of the group, are exactly the last rows of the earlier chunks.
    if depth:
        back = [c for c in df.columns if c in looking_back and c not in order and c not in keys]
        last_first = Window.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
        tails = (
            rows.select(*group, *order, *back)
            .withColumn("_back", F.row_number().over(last_first))
            .where(F.col("_back") <= depth)
        )
        by_key = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-depth, -1)
        first_tail = Window.partitionBy(*group)
        halo = (
            tails.withColumn("_halo", F.collect_list(F.struct(*order, *back)).over(by_key))
            .withColumn("_deepest", F.max("_back").over(first_tail))
            .where(F.col("_back") == F.col("_deepest"))
            .select(*group, F.lit(1).alias("_kind"), F.explode("_halo").alias("_row"))
            .select(*group, "_kind", "_row.*")
        )
        lead_in = lead_in.unionByName(halo, allowMissingColumns=True)

    combined = rows.withColumn("_kind", F.lit(2)).unionByName(lead_in, allowMissingColumns=True)
    window = Window.partitionBy(*group).orderBy("_kind", *order)

    def value(spec: Spec) -> Column:
        if not isinstance(spec, Before):
            return _plain(spec, window)

        def so_far(part: str) -> Column:
            # the carry row holds what came before the chunk; halo rows were counted there already
            own = F.col(spec.column) if part != "count" else F.when(F.col(spec.column).isNotNull(), 1)
            seen = F.when(F.col("_kind") == 2, own).otherwise(F.col(f"_{part}_{spec.name}"))
            return _before(window, "max" if part == "max" else "sum", seen)

        if spec.how == "mean":
            return F.try_divide(so_far("sum"), so_far("count")).alias(spec.name)
        if spec.how == "count":
            return F.coalesce(so_far("count"), F.lit(0)).cast("long").alias(spec.name)
        return so_far(spec.how).alias(spec.name)

    return combined.select("*", *[value(s) for s in specs]).where(F.col("_kind") == 2).select(
        *df.columns, *[s.name for s in specs]
    )
