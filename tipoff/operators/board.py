"""Board of the day's games: teams, time, score and predicted winner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff.functions import exprs as X

TEAM_FIELDS = ["teamId", "teamTricode", "teamCity", "teamName", "score"]


def games_board(games: DataFrame, teams: DataFrame, predictions: DataFrame, zone: str = "Asia/Hong_Kong") -> DataFrame:
    """One row per game.

    ``games``: gameId, gameCode, gameTimeUTC, gameStatusText. ``teams``: gameId, position, and the team
    fields. ``predictions``: gameId, predicted_winner. Teams are found by the codes in the game code; when
    either is not found, the first two team rows stand in as away and home.
    """
    code = X.parse_matchup(F.col("gameCode"))
    coded = games.select("gameId", "gameCode", "gameTimeUTC", "gameStatusText",
                         code["away"].alias("away_code"), code["home"].alias("home_code"))
    team = F.struct(*TEAM_FIELDS)
    # the first team row per code, and the first two rows per game: both cut before the shuffle
    by_code = teams.groupBy("gameId", "teamTricode").agg(F.min_by(team, "position").alias("team"))
    window = Window.partitionBy("gameId").orderBy("position")
    by_position = (
        teams.withColumn("_n", F.row_number().over(window))
        .where("_n <= 2")
        .groupBy("gameId")
        .agg(
            F.max(F.when(F.col("_n") == 1, team)).alias("first_team"),
            F.max(F.when(F.col("_n") == 2, team)).alias("second_team"),
        )
    )
    side = lambda name: by_code.select(
        "gameId", F.col("teamTricode").alias(f"{name}_code"), F.col("team").alias(f"{name}_team")
    )
    rows = (
        coded.join(side("away"), ["gameId", "away_code"], "left")
        .join(side("home"), ["gameId", "home_code"], "left")
        .join(by_position, "gameId", "left")
        .join(predictions.select("gameId", "predicted_winner"), "gameId", "left")
    )
    found = F.col("away_team").isNotNull() & F.col("home_team").isNotNull()
    rows = rows.withColumns(
        {
            "away": F.when(found, F.col("away_team")).otherwise(F.col("first_team")),
            "home": F.when(found, F.col("home_team")).otherwise(F.col("second_team")),
        }
    )
    full_name = lambda s: F.trim(
        F.concat(F.coalesce(f"{s}.teamCity", F.lit("")), F.lit(" "), F.coalesce(f"{s}.teamName", F.lit("")))
    )
    tricode = lambda s: F.coalesce(f"{s}.teamTricode", f"{s}_code")
    return rows.select(
        "gameId",
        F.concat(tricode("away"), F.lit(" @ "), tricode("home")).alias("matchup"),
        X.format_time(F.col("gameTimeUTC"), zone).alias("game_time"),
        F.coalesce("gameStatusText", F.lit("-")).alias("status"),
        F.concat(X.format_score(F.col("away.score")), F.lit(" - "), X.format_score(F.col("home.score"))).alias("score"),
        full_name("away").alias("away_team"),
        full_name("home").alias("home_team"),
        F.coalesce("predicted_winner", F.lit("Unknown")).alias("predicted_winner"),
    )
