"""Gold tables built from silver games."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipoff import schema
from tipoff.operators.games import canonicalize_games
from tipoff.operators.ordered import MAX_GROUP_ROWS, frequent, measured
from tipoff.operators.team_features import OPPONENT_COLUMNS, add_pair_history, add_team_history, attach_opponent


# rows of a task of the three ordered steps, which sorts them in its memory
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame) -> int | None:
    """The tasks that the rows of ``df`` need, where the session would take fewer."""
    tasks = df.count() // TASK_ROWS + 1
    return tasks if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def build_history(
    silver: DataFrame,
    season: str | None = None,
    unique: bool = False,
    rest: bool = True,
    venue_aware: bool = True,
    strategy: str = "auto",
    max_group_rows: int = MAX_GROUP_ROWS,
    columns: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Team game history: rolling form, opponent form and head-to-head record.

    ``season`` filters at the scan. SEASON is in every window and join key, so the rows of that
    season are the same as in a full build, and only its partition is read.

    A sketch names the team seasons that are too large for one task: from the key columns alone where ``silver`` is a table of
    unique keys, else in the pass that stages the deduplicated rows. A team's games against one opponent are no more, so the same names serve both ordered passes. The pairing brings the
    rows of a game together in one shuffle, so silver is scanned and rolled once.

    ``columns`` names the columns of the history that are wanted; the shuffles then move what these need, for the same rows.
    """
    wanted = [*schema.HISTORY_COLUMNS, *(schema.REST_COLUMNS if rest else [])] if columns is None else list(columns)
    names = [n for n in schema.ROLLING if n in wanted or f"OPP_{n}" in wanted]
    shown = [c for c in OPPONENT_COLUMNS if f"OPP_{c}" in wanted]
    kept = {*wanted, *shown, *names, *schema.TEAM_KEY, *schema.GAME_ORDER, "HOME", "TEAM_WIN"}
    rolled_from = {schema.ROLLING[n][0] for n in names}
    games = silver if season is None else silver.where(F.col("SEASON") == season)
    canonical, hot = canonicalize_games(games, unique=unique), None
    canonical = canonical.select(*[c for c in canonical.columns if c in kept or c in rolled_from])
    if strategy == "auto":
        if unique:
            hot = frequent(canonical, schema.TEAM_KEY, max_group_rows)
        else:
            canonical, hot = measured(canonical, schema.TEAM_KEY, max_group_rows)
    # large groups are cut into chunks of their own
    tasks = tasks_for(canonical) if hot is not None and not hot.rows else None
    spread = lambda df, *keys: df if tasks is None else df.repartition(tasks, *keys)
    rest = rest and not kept.isdisjoint(schema.REST_COLUMNS)
    rolled = add_team_history(spread(canonical, *schema.TEAM_KEY), names, rest=rest, strategy=strategy, hot=hot, **options)
    history = attach_opponent(rolled.select(*[c for c in rolled.columns if c in kept]), tasks)
    if schema.PAIR_WIN_PCT in kept:
        history = spread(history, *schema.TEAM_KEY, "OPP_TEAM_ID", *(["HOME"] if venue_aware else []))
        history = add_pair_history(history, venue_aware=venue_aware, strategy=strategy, hot=hot, **options)
    return history.select(*wanted)


def latest_season(history: DataFrame) -> DataFrame:
    """One row: the season of the newest game."""
    return history.agg(F.max_by("SEASON", F.struct("GAME_DATE", "GAME_ID")).alias("SEASON"))


def newest_season_only(df: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the newest season; the season comes from a scalar subquery, so no join and no driver pull."""
    return df.where(F.col("SEASON") == latest_season(history).scalar())


def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in newest])
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def latest_snapshot(history: DataFrame) -> DataFrame:
    """Newest row per team in the newest season. Its rolling values exclude that newest game."""
    newest = newest_season_only(history, history)
    return latest_per_key(newest, ["TEAM_ID"], schema.GAME_ORDER).select(*schema.SNAPSHOT_COLUMNS)


def next_game_snapshot(canonical: DataFrame) -> DataFrame:
    """Like ``latest_snapshot`` but the rolling values include each team's newest game.

    These are the values the team brings into its next game. At most N rows per team and feature
    matter, so the ten newest rows per team are kept (a window group limit, before the shuffle) and
    averaged.
    """
    newest = newest_season_only(canonical, canonical)
    depth = max(rows for _, rows in schema.ROLLING.values() if rows)
    window = Window.partitionBy("TEAM_ID").orderBy(*[F.desc(c) for c in schema.GAME_ORDER])
    recent = newest.withColumn("_back", F.row_number().over(window)).where(F.col("_back") <= depth)
    first = F.col("_back") == 1
    plain = ["GAME_DATE", "LAST_GAME_DATE", "SEASON", "TEAM_ABBREVIATION", "TEAM_NAME"]
    return recent.groupBy("TEAM_ID").agg(
        *[F.max(F.when(first, F.col(c))).alias(c) for c in plain],
        *[
            F.avg(F.when(F.col("_back") <= rows, F.col(column))).alias(name)
            for name, (column, rows) in schema.ROLLING.items()
            if rows
        ],
    ).select(*schema.SNAPSHOT_COLUMNS)


def pair_win_pct(history: DataFrame) -> DataFrame:
    """Win share of each team against each opponent per season, over all their games."""
    return history.groupBy(
        "SEASON",
        F.col("TEAM_ID").alias("team_id"),
        F.col("OPP_TEAM_ID").alias("opp_id"),
        F.col("TEAM_NAME").alias("team_name"),
        F.col("OPP_TEAM_NAME").alias("opp_name"),
    ).agg(F.avg("TEAM_WIN").alias("winPCT"))
