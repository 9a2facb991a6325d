"""Player and team season tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff import schema
from tipoff.operators.quality import cast_by_map


def flag_multi_team(df: DataFrame) -> DataFrame:
    """``changed_team`` = 1 on rows of players who also have a multi-team row in the season.

    The ids stay in Spark as a distinct join side; they are not pulled to the driver.
    """
    moved = (
        df.where(F.col("team").isin(schema.MULTI_TEAM_CODES))
        .select("season", "player_id")
        .distinct()
        .withColumn("_moved", F.lit(1))
    )
    return (
        df.join(moved, ["season", "player_id"], "left")
        .withColumn("changed_team", F.coalesce("_moved", F.lit(0)))
        .drop("_moved")
    )


def team_count(df: DataFrame) -> DataFrame:
    """Number of teams: the digit of a multi-team code, else 1."""
    digits = F.regexp_extract("team", r"(\d)", 1).try_cast("int")
    return df.withColumn(
        "team_count", F.when(F.col("team").isin(schema.MULTI_TEAM_CODES), digits).otherwise(1)
    )


def player_season_gold(
    df: DataFrame, season: int | None = None, teams: Sequence[str] = tuple(schema.TEAM_CODES)
) -> DataFrame:
    """One row per player and real team; the multi-team sum rows only leave their flag behind."""
    rows = df if season is None else df.where(F.col("season") == season)
    flagged = team_count(flag_multi_team(rows))
    return flagged.where(
        ~F.col("team").isin(schema.MULTI_TEAM_CODES) & F.col("team").isin([*teams, "MULTI"])
    )


def team_season_gold(df: DataFrame, season: int | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Typed team season rows, one season or all."""
    typed = cast_by_map(df, types or schema.TEAM_SEASON_TYPES)
    return typed if season is None else typed.where(F.col("season") == season)
