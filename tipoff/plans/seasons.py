"""Player and team season tables as jobs: select, check, write the season's partition."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tipoff import schema
from tipoff.operators.quality import require_rows
from tipoff.operators.seasons import player_season_gold, team_season_gold
from tipoff.scratch import stage
from tipoff.sources.tables import TableStore


def _write(gold: DataFrame, store: TableStore, table: str) -> int:
    rows = require_rows(stage(gold, table), table)
    if store.exists(table):
        store.overwrite_partitions(rows, table, by="season")
    else:
        store.write_partitioned(rows, table, by="season", rebalance=True)
    return rows.count()


def write_team_season(df: DataFrame, store: TableStore, season: int) -> int:
    """The typed team rows of one season into their partition; other seasons stay. No rows is an error, and nothing is written."""
    return _write(team_season_gold(df, season), store, schema.TEAM_SEASONS)


def write_player_season(df: DataFrame, store: TableStore, season: int) -> int:
    """The player rows of one season, likewise."""
    return _write(player_season_gold(df, season), store, schema.PLAYER_SEASONS)
