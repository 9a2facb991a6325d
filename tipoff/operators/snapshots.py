"""In-game snapshots: about one per minute from play-by-play."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff import schema
from tipoff.functions.exprs import clock_seconds

SNAPSHOT_FIELDS = "ACTION_NUMBER bigint, PERIOD int, TIME_REMAINING int, scoreHome bigint, scoreAway bigint"


def timed_columns(iso: bool = False) -> list[Column]:
    """Typed scores and the seconds left in the game, from raw play-by-play columns."""
    period = F.col("period").try_cast("int")
    return [
        F.col("GAME_ID"),
        F.col("actionNumber").try_cast("long").alias("ACTION_NUMBER"),
        period.alias("PERIOD"),
        clock_seconds(F.col("clock"), period, iso=iso).alias("TIME_REMAINING"),
        F.coalesce(F.col("scoreHome").try_cast("long"), F.lit(0)).cast("long").alias("scoreHome"),
        F.coalesce(F.col("scoreAway").try_cast("long"), F.lit(0)).cast("long").alias("scoreAway"),
    ]


def _greedy(events: Column, interval: int) -> Column:
    """Fold over events in order: keep one when at least ``interval`` seconds passed since the last kept."""

    def step(kept, event):
        due = (F.size(kept) == 0) | (F.element_at(kept, -1).TIME_REMAINING - event.TIME_REMAINING >= interval)
        return F.when(due, F.concat(kept, F.array(event))).otherwise(kept)

    return F.aggregate(events, F.expr(f"CAST(array() AS ARRAY<STRUCT<{_struct_ddl()}>>)"), step)


def _struct_ddl() -> str:
    return ", ".join(f"{f.split()[0]}: {f.split()[1]}" for f in SNAPSHOT_FIELDS.split(", "))


def game_snapshots(pbp: DataFrame, interval: int = 60, iso: bool = False) -> DataFrame:
    """First event, last event, and every event at least ``interval`` seconds after the last snapshot.

    The rule is sequential, but after an event at t seconds the last snapshot is always below
    t + interval, so a later event at t or more is never due. Only the first event at each second of
    the clock can be kept. Those are a partial aggregate, at most one row per clock second and game,
    so the fold runs over a bounded array however many events a game has.
    """
    events = pbp.select(*timed_columns(iso))
    event = F.struct("ACTION_NUMBER", "PERIOD", "TIME_REMAINING", "scoreHome", "scoreAway")
    order = F.struct("ACTION_NUMBER", "PERIOD", "scoreHome", "scoreAway")
    per_second = events.groupBy("GAME_ID", "TIME_REMAINING").agg(
        F.min_by(event, order).alias("first"), F.max_by(event, order).alias("last")
    )
    in_order = lambda e: F.struct(e.ACTION_NUMBER, e.PERIOD, e.scoreHome, e.scoreAway)
    games = per_second.groupBy("GAME_ID").agg(
        F.array_sort(F.collect_list("first")).alias("candidates"),
        F.max_by("last", in_order(F.col("last"))).alias("final"),
    )
    kept = _greedy(F.col("candidates"), interval)
    snapshots = F.when(
        F.element_at(kept, -1).ACTION_NUMBER == F.col("final").ACTION_NUMBER, kept
    ).otherwise(F.concat(kept, F.array(F.col("final"))))
    return games.select("GAME_ID", "final", F.explode(snapshots).alias("s")).select(
        *snapshot_columns("s", F.col("final.scoreHome") > F.col("final.scoreAway"))
    )


def snapshot_columns(event: str, home_won: Column) -> list[Column]:
    return [
        F.col("GAME_ID"),
        F.col(f"{event}.ACTION_NUMBER"),
        F.col(f"{event}.PERIOD"),
        F.col(f"{event}.TIME_REMAINING"),
        (F.col(f"{event}.scoreHome") - F.col(f"{event}.scoreAway")).alias("CURRENT_SCORE_DIFF"),
        F.lit(0).alias("CURRENT_FG_DIFF"),
        F.lit(1).alias("HOME"),
        F.when(home_won, 1).otherwise(0).alias("FINAL_WIN_HOME"),
    ]


PREGAME = ["ROLL_WIN_PCT_10", "ROLL_FG_PCT_10", "ROLL_EFG_PCT_10", "OPP_ROLL_WIN_PCT_10", *schema.REST_COLUMNS]


def attach_pregame(snapshots: DataFrame, history: DataFrame) -> DataFrame:
    """The home team's pre-game features on each snapshot; NULL where the game is not in the history."""
    pregame = history.where(F.col("HOME") == 1).select("GAME_ID", *PREGAME)
    return snapshots.join(pregame, "GAME_ID", "left")
