"""Bronze to silver to the canonical game row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tipoff import schema
from tipoff.functions import exprs as X


def keep_newest(df: DataFrame, keys: Sequence[str], newest: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One row per key, the newest by ``newest``; remaining ties fall by all other columns, so reruns agree.

    ``row_number() = 1`` becomes a window group limit: each map task keeps one row per key before the
    shuffle, so a key with very many copies costs the reducer one row per task.

    ``within`` names columns that have one value a key. Rows that an earlier shuffle brought together by them are not moved again.
    """
    rest = [c for c in df.columns if c not in (*keys, *newest, *within)]
    window = Window.partitionBy(*within, *keys).orderBy(
        *[F.desc_nulls_last(c) for c in newest], *[F.desc_nulls_last(c) for c in rest]
    )
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def dedupe_games(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One row per (game, team), the newest ingest first."""
    stamps = [c for c in ("INGEST_DATE", "ingestion_date", "ingest_date") if c in df.columns]
    return keep_newest(df, schema.GAME_KEY, stamps, within).drop(*within)


def clean_silver(
    df: DataFrame, ingest_date: Column | str | None = None, dedupe: bool = True, within: Sequence[str] = ()
) -> DataFrame:
    """Typed date and season, HOME and TEAM_WIN flags, ingest tag, one row per (game, team).

    ``within``: helper columns as ``keep_newest`` has them, which are left out of the result.
    """
    cleaned = df.withColumns(
        {
            "GAME_DATE": X.as_date(F.col("GAME_DATE")),
            "SEASON": X.first_present(df, "SEASON", "season", "SEASON_ID").cast("string"),
        }
    )
    if ingest_date is not None:
        cleaned = cleaned.withColumn(
            "INGEST_DATE", F.lit(ingest_date) if isinstance(ingest_date, str) else ingest_date
        )
    flags = {"HOME": X.home_flag(F.col("MATCHUP")), "TEAM_WIN": X.win_flag(F.col("WL"))}
    cleaned = cleaned.withColumns({name: flag for name, flag in flags.items() if name in df.columns})
    kept = dedupe_games(cleaned, within) if dedupe else cleaned.drop(*within)
    # new flags come after the shuffle, as they follow from columns that it moves
    new = {name: flag for name, flag in flags.items() if name not in df.columns}
    last = [c for c in cleaned.columns if c == "INGEST_DATE" and c not in df.columns]
    return kept.withColumns(new).select(*[c for c in cleaned.columns if c not in (*last, *within)], *new, *last)


def canonicalize_games(df: DataFrame, unique: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """The 26 typed game columns plus flags and ratios, one row per (game, team).

    ``unique=True`` says the source already has one row per key (a table kept by ``merge_upsert``)
    and saves the shuffle of the dedup. ``within``: as in ``keep_newest``.
    """
    source = df if unique else dedupe_games(df, within)
    typed = source.select(
        F.col("GAME_ID").cast("string").alias("GAME_ID"),
        X.as_date(F.col("GAME_DATE")).alias("GAME_DATE"),
        X.first_present(source, "SEASON", "season", "SEASON_ID").cast("string").alias("SEASON"),
        *[F.col(c).cast("string").alias(c) for c in schema.GAME_TEXT if c != "SEASON"],
        *[F.col(c).try_cast("double").alias(c) for c in schema.BOX_SCORE],
    )
    return typed.withColumns(
        {
            "LAST_GAME_DATE": F.col("GAME_DATE"),
            "HOME": X.home_flag(F.col("MATCHUP")),
            "TEAM_WIN": X.win_flag(F.col("WL")),
            "eFG_PCT": X.effective_fg_pct(),
            "AST_TO_RATIO": X.assist_turnover_ratio(),
        }
    )


def rows_for_date(df: DataFrame, day: str) -> DataFrame:
    """Games of one day, one row per (game, team)."""
    return dedupe_games(df.where(F.col("GAME_DATE") == F.lit(day).cast("date")))


def rows_for_ingest(df: DataFrame, day: str) -> DataFrame:
    """Rows of one ingest day, by whichever ingest column is there; all rows when there is none."""
    for name in ("INGEST_DATE", "ingestion_date"):
        if name in df.columns:
            return df.where(F.col(name) == day)
    return df


def tag_ingest(
    df: DataFrame, season: str, season_type: str, ingestion_date: str, per_mode: str | None = None
) -> DataFrame:
    """Constant metadata columns. ``per_mode`` says how player rows count: per game or in total."""
    tags = {"SEASON": season, "season_type": season_type, "ingestion_date": ingestion_date}
    if per_mode is not None:
        tags["per_mode"] = per_mode
    return df.withColumns({name: F.lit(value) for name, value in tags.items()})


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; columns missing on one side become NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out
