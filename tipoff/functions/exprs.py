"""Scalar expressions. All are built-in column functions, so they stay in generated JVM code.

Raw input is parsed with ``try_*`` functions: a bad value becomes NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of ``names`` that is a column of ``df``."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise KeyError(f"no column of {', '.join(names)} is present")


def as_date(value: Column) -> Column:
    """Date from text, timestamp or date; NULL when it does not parse."""
    return value.try_cast("date")


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL when the denominator is zero or NULL."""
    return F.try_divide(numerator, denominator)


def home_flag(matchup: Column) -> Column:
    return F.when(matchup.rlike(r"(?i)vs\."), 1).otherwise(0)


def win_flag(outcome: Column) -> Column:
    return F.when(outcome == "W", 1).otherwise(0)


def effective_fg_pct() -> Column:
    return safe_ratio(F.col("FGM") + F.lit(0.5) * F.col("FG3M"), F.col("FGA"))


def assist_turnover_ratio() -> Column:
    return safe_ratio(F.col("AST"), F.col("TOV"))


def season_start_year(day: Column) -> Column:
    """A season starts in October."""
    return F.year(day) - F.when(F.month(day) < 10, 1).otherwise(0)


def season_of_year(year: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(((year + 1) % 100).cast("string"), 2, "0"))


def season_label(day: Column) -> Column:
    """``2025-26`` for any day from 2025-10-01 to 2026-09-30."""
    return season_of_year(season_start_year(day))


def season_range(first: int, last: int) -> Column:
    """Array of season labels whose start years are ``first`` to ``last``."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), season_of_year)


def clock_seconds(clock: Column, period: Column, iso: bool = False) -> Column:
    """Seconds left in the game for a ``MM:SS`` clock; 0 when the clock does not parse.

    Overtime periods add no remaining periods. With ``iso``, ``PTmmMss.ssS`` is read too.
    """
    whole = r"^\s*[+-]?\d+\s*$"
    parts = F.split(clock, ":")
    minutes, seconds = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    valid = (F.size(parts) == 2) & minutes.rlike(whole) & seconds.rlike(whole)
    in_period = F.try_add(F.try_multiply(minutes.try_cast("long"), F.lit(60)), seconds.try_cast("long"))
    rest = F.greatest(F.lit(0), F.lit(4) - period) * 720
    result = F.when(valid, F.try_add(in_period, rest))
    if iso:
        pattern = r"^PT(\d+)M(\d+)(?:\.\d+)?S$"
        iso_seconds = F.try_add(
            F.try_multiply(F.regexp_extract(clock, pattern, 1).try_cast("long"), F.lit(60)),
            F.regexp_extract(clock, pattern, 2).try_cast("long"),
        )
        result = result.when(clock.rlike(pattern), F.try_add(iso_seconds, rest))
    return F.coalesce(result.try_cast("int"), F.lit(0))


def parse_matchup(game_code: Column) -> Column:
    """``yyyyMMdd/AAAHHH`` to struct(away, home); empty strings when the code is too short."""
    code = F.element_at(F.split(game_code, "/"), -1)
    usable = (F.length(game_code) >= 6) & (F.length(code) >= 6)
    return F.struct(
        F.when(usable, F.substring(code, 1, 3)).otherwise("").alias("away"),
        F.when(usable, F.substring(code, 4, 3)).otherwise("").alias("home"),
    )


def format_score(score: Column) -> Column:
    """NULL as ``0``, whole numbers without a decimal point."""
    whole = score == F.floor(score)
    return (
        F.when(score.isNull() | F.isnan(score), "0")
        .when(whole, score.cast("long").cast("string"))
        .otherwise(score.cast("string"))
    )


def format_time(utc: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """UTC timestamp shown in ``zone`` to the minute; ``-`` when missing."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(utc, zone), "yyyy-MM-dd HH:mm"), F.lit("-"))


def local_date(utc: Column, zone: str) -> Column:
    """Calendar day of a UTC timestamp in ``zone``."""
    return F.to_date(F.from_utc_timestamp(utc, zone))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), " ", "_")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_metric_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(_strip(name)), r"[\s\-]+", "_")


def display_metric_name(name: Column) -> Column:
    """The variant used for display: only spaces become underscores."""
    return F.regexp_replace(F.lower(_strip(name)), " ", "_")


def normalize_metrics(metrics: Column) -> Column:
    """Map with normalised keys. Where two keys become equal, the later one wins."""
    entries = F.map_entries(metrics)
    renamed = F.transform(entries, lambda e: F.struct(normalize_metric_name(e.key).alias("k"), e.value.alias("v")))
    last = F.filter(
        renamed,
        lambda e, i: ~F.exists(F.slice(renamed, i + 2, F.size(renamed)), lambda later: later.k == e.k),
    )
    return F.map_from_entries(last)


def landed_name(kind: Column, season: Column, day: Column) -> Column:
    """Name of a landed file: ``games_2025-26_2025_12_01.csv``."""
    return F.concat_ws("_", kind, season, F.concat(F.date_format(day, "yyyy_MM_dd"), F.lit(".csv")))


def us_date(day: Column) -> Column:
    """A day as ``12/01/2025``, as the source of game logs is asked for it."""
    return F.date_format(day, "MM/dd/yyyy")


def file_date(name: Column) -> Column:
    """Date in a file name such as ``games_2025-26_2025_12_01.csv``; NULL when there is none."""
    return F.try_to_date(F.regexp_extract(name, r"(\d{4}_\d{2}_\d{2})(?=\.csv$)", 1), "yyyy_MM_dd")


def coerce_numeric(value: Column) -> Column:
    """Number or NULL; NaN counts as missing."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)
