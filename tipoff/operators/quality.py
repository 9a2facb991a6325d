"""Checks on columns, rows and values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.functions.exprs import as_date, coerce_numeric


def require_columns(df: DataFrame, names: Sequence[str], what: str = "table") -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def evaluate_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row (rule, value, passed) per rule. A rule is an aggregate; it passes when positive or true.

    All rules share one pass. ``column_count`` is always included.
    """
    named = {"column_count": F.lit(len(df.columns)), **rules}
    values = df.agg(*[F.coalesce(expr.cast("double"), F.lit(0.0)).alias(name) for name, expr in named.items()])
    return values.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("value")) for n in named])
        ).alias("r")
    ).select("r.rule", "r.value", (F.col("r.value") > 0).alias("passed"))


def drop_bad_dates(df: DataFrame, column: str) -> DataFrame:
    """Date or NULL; rows without a date are dropped."""
    return df.withColumn(column, as_date(F.col(column))).where(F.col(column).isNotNull())


def numeric_values(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is a number, as double."""
    return df.withColumn(column, coerce_numeric(F.col(column))).where(F.col(column).isNotNull())


def cast_by_map(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the named columns; values that do not fit become NULL. Others pass through."""
    return df.select(
        *[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns]
    )


def normalize_names(df: DataFrame, case: str = "lower") -> DataFrame:
    return df.toDF(*[c.lower() if case == "lower" else c.upper() for c in df.columns])
