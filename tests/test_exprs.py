import pytest
from pyspark.sql import functions as F

from tipoff.functions import exprs as X


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "day,label",
    [("2025-09-30", "2024-25"), ("2025-10-01", "2025-26"), ("1999-11-02", "1999-00"), ("2000-03-01", "1999-00")],
)
def test_season_label(spark, day, label):
    assert one(spark, X.season_label(F.lit(day).cast("date"))) == label


def test_season_range(spark):
    labels = one(spark, X.season_range(2010, 2025))
    assert labels[0] == "2010-11" and labels[-1] == "2025-26" and len(labels) == 16


@pytest.mark.parametrize(
    "clock,period,iso,seconds",
    [
        ("12:00", 1, False, 2880), ("00:30", 4, False, 30), ("05:00", 5, False, 300), ("0530", 1, False, 0),
        ("05:30.5", 1, False, 0), (None, 1, False, 0), ("1:2:3", 1, False, 0), ("PT05M30.20S", 4, False, 0),
        ("PT05M30.20S", 4, True, 330), ("04:10", 4, True, 250),
        ("99999999999:00", 1, False, 0), ("99999999999999999999:00", 1, False, 0),
    ],
)
def test_clock_seconds(spark, clock, period, iso, seconds):
    assert one(spark, X.clock_seconds(F.lit(clock).cast("string"), F.lit(period), iso)) == seconds


@pytest.mark.parametrize(
    "code,expected",
    [("20240101/AAABBB", ("AAA", "BBB")), ("AAABBB", ("AAA", "BBB")), ("20240101/AB", ("", "")), ("AB", ("", "")), (None, ("", ""))],
)
def test_parse_matchup(spark, code, expected):
    assert tuple(one(spark, X.parse_matchup(F.lit(code).cast("string")))) == expected


@pytest.mark.parametrize("score,text", [(None, "0"), (101.0, "101"), (0.0, "0"), (99.5, "99.5"), (float("nan"), "0")])
def test_format_score(spark, score, text):
    assert one(spark, X.format_score(F.lit(score).cast("double"))) == text


def test_times(spark):
    stamp = F.lit("2024-01-01 20:30:00").cast("timestamp")
    assert one(spark, X.format_time(stamp)) == "2024-01-02 04:30"
    assert one(spark, X.format_time(F.lit(None).cast("timestamp"))) == "-"
    assert str(one(spark, X.local_date(F.lit("2024-01-01 02:00:00").cast("timestamp"), "America/New_York"))) == "2023-12-31"


def test_metric_names(spark):
    assert one(spark, X.normalize_metric_name(F.lit("\tROC - AUC "))) == "roc_auc"
    assert one(spark, X.display_metric_name(F.lit(" Log-Loss x"))) == "log-loss_x"
    metrics = F.create_map(F.lit("Log Loss"), F.lit(1.0), F.lit("log-loss"), F.lit(2.0), F.lit("AUC"), F.lit(3.0))
    assert one(spark, X.normalize_metrics(metrics)) == {"log_loss": 2.0, "auc": 3.0}


def test_file_date(spark):
    assert str(one(spark, X.file_date(F.lit("games_2025-26_2025_12_01.csv")))) == "2025-12-01"
    assert one(spark, X.file_date(F.lit("games_2025_13_45.csv"))) is None
    assert one(spark, X.file_date(F.lit("games_2025_12_01.txt"))) is None


def test_guards(spark):
    assert one(spark, X.as_date(F.lit("soon"))) is None
    assert one(spark, X.coerce_numeric(F.lit("NaN"))) is None
    assert one(spark, X.coerce_numeric(F.lit("x1"))) is None
    assert one(spark, X.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, X.home_flag(F.lit("AAA VS. BBB"))) == 1
    assert one(spark, X.home_flag(F.lit("AAA @ BBB"))) == 0
    assert one(spark, X.win_flag(F.lit(None).cast("string"))) == 0
    with pytest.raises(KeyError):
        X.first_present(spark.range(1), "a", "b")
