"""Leakage-free team features: rolling form, rest days, opponent form and head-to-head record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff import schema
from tipoff.operators.ordered import Before, GapDays, TrailingMean, with_history

# what a game row shows its opponent: ids, result and rolling form
OPPONENT_COLUMNS = ["TEAM_ID", "TEAM_ABBREVIATION", "TEAM_NAME", "TEAM_WIN", *schema.OPPONENT_ROLLING]


def rolling_specs(names: Sequence[str] | None = None) -> list:
    return [
        Before(name, column, "mean") if rows is None else TrailingMean(name, column, rows)
        for name, (column, rows) in schema.ROLLING.items()
        if names is None or name in names
    ]


def add_team_history(df: DataFrame, names: Sequence[str] | None = None, rest: bool = True, **options) -> DataFrame:
    """Rolling and season-to-date means, plus REST_DAYS and BACK_TO_BACK, in one pass over the team's games."""
    specs = rolling_specs(names)
    if rest:
        specs.append(GapDays("REST_DAYS", "GAME_DATE"))
    out = with_history(df, schema.TEAM_KEY, schema.GAME_ORDER, specs, **options)
    if rest:
        out = out.withColumn("BACK_TO_BACK", F.when(F.col("REST_DAYS") == 0, 1).otherwise(0))
    return out


def attach_opponent(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each home row with the away row of its game and the reverse.

    The rows of a game, one a team and so few, meet in one shuffle, of ``tasks`` partitions if given; ``df`` is computed once.
    Rows are moved before they are grouped, as lists of one row are twice as large. Games without both sides drop out;
    ``unpaired_games`` counts them.
    """
    row = F.struct(*df.columns)
    together = df.where("GAME_ID IS NOT NULL AND SEASON IS NOT NULL").repartition(*([tasks] if tasks else []), "GAME_ID", "SEASON")
    games = together.groupBy("GAME_ID", "SEASON").agg(
        F.collect_list(F.when(F.col("HOME") == 1, row)).alias("home"), F.collect_list(F.when(F.col("HOME") == 0, row)).alias("away")
    )
    pairs = games.select(F.explode("home").alias("home"), "away").select("home", F.explode("away").alias("away"))
    view = lambda mine, other: F.struct(F.col(mine).alias("mine"), F.col(other).alias("other"))
    both = pairs.select(F.explode(F.array(view("home", "away"), view("away", "home"))).alias("v")).select("v.*")
    return both.select(
        "mine.*",
        *[F.col(f"other.{name}").alias(f"OPP_{name}") for name in OPPONENT_COLUMNS if name in df.columns],
        F.col("mine.TEAM_WIN").alias("WIN"),
    )


def unpaired_games(df: DataFrame) -> DataFrame:
    """Number of games lost by the pairing, by reason."""
    sides = df.groupBy("GAME_ID", "SEASON").agg(
        F.count_if(F.col("HOME") == 1).alias("home"), F.count_if(F.col("HOME") == 0).alias("away")
    )
    reason = F.when(F.col("home") == 0, "no_home_row").when(F.col("away") == 0, "no_away_row")
    return sides.withColumn("reason", reason).where("reason IS NOT NULL").groupBy("reason").agg(
        F.count(F.lit(1)).alias("games")
    )


def add_pair_history(df: DataFrame, venue_aware: bool = True, **options) -> DataFrame:
    """Season win share against this opponent before the game; per venue unless told otherwise."""
    keys = [*schema.TEAM_KEY, "OPP_TEAM_ID"] + (["HOME"] if venue_aware else [])
    return with_history(df, keys, schema.GAME_ORDER, [Before(schema.PAIR_WIN_PCT, "TEAM_WIN", "mean")], **options)


def attach_home_away_ids(df: DataFrame) -> DataFrame:
    """HOME_ID and AWAY_ID of the game on each of its rows, which meet in one shuffle; a row without a game has neither."""
    game = Window.partitionBy("GAME_ID")
    side = lambda home: F.min(F.when((F.col("HOME") == home) & F.col("GAME_ID").isNotNull(), F.col("TEAM_ID"))).over(game)
    named = df.select("*", side(1).alias("HOME_ID"), side(0).alias("AWAY_ID"))
    return named.select("GAME_ID", *[c for c in named.columns if c != "GAME_ID"])
