import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, game_row, league
from tipoff import schema
from tipoff.operators import quality
from tipoff.sources import tables
from tipoff.sources.tables import TableStore


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "lake"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def small(spark, *values):
    return spark.createDataFrame(list(values), "GAME_ID string, TEAM_ID string, SEASON string, PTS double")


def test_bronze_keeps_zeros_and_landing_repeats(spark, tmp_path):
    root = str(tmp_path / "bronze")
    day1 = frame(spark, [game_row("0022500001", "2025-10-21", "A", "B", True, True)])
    tables.land_bronze(day1, root, "2025-10-21")
    tables.land_bronze(day1.withColumn("PTS", F.lit(7.0)), root, "2025-10-21")
    tables.land_bronze(frame(spark, [game_row("0022500002", "2025-10-22", "A", "B", True, True)]), root, "2025-10-22")
    assert rows(tables.read_bronze(spark, root), "GAME_ID", "PTS", "ingest_date") == [
        ("0022500001", 7.0, "2025-10-21"), ("0022500002", 10.0, "2025-10-22"),
    ]
    one = tables.read_bronze(spark, root, ingest_date="2025-10-22")
    assert rows(one, "GAME_ID") == [("0022500002",)]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan


def test_upsert_moves_and_empties_partitions(spark, store):
    store.write_partitioned(small(spark, ("1", "A", "s1", 1.0), ("2", "A", "s2", 2.0), ("3", "A", "s3", 3.0)), "t")
    change = small(spark, ("1", "A", "s2", 10.0), ("4", "A", "s4", 4.0))
    for _ in range(2):  # twice equals once
        store.merge_upsert(change, "t")
        assert rows(store.read("t"), "GAME_ID", "SEASON", "PTS") == [
            ("1", "s2", 10.0), ("2", "s2", 2.0), ("3", "s3", 3.0), ("4", "s4", 4.0),
        ]
    store.merge_upsert(small(spark), "t")
    assert store.read("t").count() == 4


def test_upsert_takes_one_source_row_per_key(spark, store):
    store.write_partitioned(small(spark, ("1", "A", "s1", 1.0)), "t")
    source = small(spark, ("1", "A", "s1", 2.0), ("1", "A", "s1", 3.0)).withColumn("stamp", F.col("PTS"))
    store.merge_upsert(source, "t", newest=["stamp"])
    assert rows(store.read("t"), "PTS") == [(3.0,)]


def test_missing_table(spark, store):
    assert not store.exists("t")
    with pytest.raises(ValueError, match="initial load"):
        store.merge_upsert(small(spark), "t")


def test_dynamic_overwrite_and_append(spark, store):
    store.write_partitioned(small(spark, ("1", "A", "s1", 1.0), ("2", "A", "s2", 2.0)), "t")
    store.overwrite_partitions(small(spark, ("9", "A", "s2", 9.0)), "t")
    assert rows(store.read("t"), "GAME_ID") == [("1",), ("9",)]
    store.write_partitioned(small(spark, ("5", "A", "s5", 5.0)), "t")
    assert rows(store.read("t"), "GAME_ID") == [("5",)]
    day = small(spark, ("1", "A", "s1", 1.0)).withColumn("ingestion_date", F.lit("2024-01-01"))
    store.append_by_ingestion(day, "log")
    store.append_by_ingestion(day, "log")
    assert store.read("log").count() == 2


def test_register_and_counts(spark, store):
    counted, observed = tables.counted(small(spark, ("1", "A", "s1", 1.0), ("2", "A", "s2", 2.0)), "rows")
    store.write_partitioned(counted, "t")
    assert observed.get["rows"] == 2
    name = store.register("t", "registered_games")
    assert spark.table(name).count() == 2
    store.write_full(small(spark, ("1", "A", "s1", 1.0)), "flat")
    assert spark.table(store.register("flat", "registered_flat")).count() == 1


def test_high_water_mark(spark, tmp_path):
    names = spark.createDataFrame([("a_2024_01_03.csv",), ("a_2024_01_05.csv",), ("a_2024_09_09.txt",)], "file_name string")
    mark = lambda today: [str(v) for v in tables.ingest_high_water_mark(names, today).first()]
    assert mark("2024-02-01") == ["2024-01-05", "2024-01-06"]
    assert mark("2024-01-05") == ["2024-01-05", "2024-01-05"]
    empty = tables.ingest_high_water_mark(names.where("false"), "2024-02-01").first()
    assert empty[0] is None and str(empty[1]) == "2024-02-01"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "g_2024_01_07.csv").write_text("x")
    assert rows(tables.landed_files(spark, str(tmp_path)), "file_name", "bytes") == [("g_2024_01_07.csv", 1)]


def test_landed_files_feed_the_mark(spark, tmp_path):
    """Games, teams and players landed under their names; landing again replaces, and the newest day gives the next start."""
    root = str(tmp_path / "landed")
    games = frame(spark, league(days=3))
    players = spark.createDataFrame([("p1", "2024-25"), ("p2", "2025-26")], "player_id string, season string")
    for day in ("2025-09-30", "2025-10-01", "2025-10-01"):
        tables.land_named(games, root, "games", day)
    tables.land_named(players, root, "player_stats", "2025-10-01")
    found = tables.landed_files(spark, root)
    assert rows(found, "file_name") == [
        ("games_2024-25_2025_09_30.csv",), ("games_2025-26_2025_10_01.csv",), ("player_stats_2024-25_2025_10_01.csv",),
        ("player_stats_2025-26_2025_10_01.csv",),
    ]
    assert [str(v) for v in tables.ingest_high_water_mark(found, "2025-12-01").first()] == ["2025-10-01", "2025-10-02"]
    again = spark.read.option("header", True).csv(f"{root}/_file=games_2025-26_2025_10_01.csv")
    assert again.count() == games.count()


def test_late_older_rows_never_replace_newer(spark, store):
    row = "GAME_ID string, TEAM_ID string, SEASON string, PTS double, INGEST_DATE string"
    make = lambda *v: spark.createDataFrame(list(v), row)
    store.write_partitioned(make(("1", "A", "s1", 1.0, "d3"), ("2", "A", "s1", 2.0, "d1"), ("3", "A", "s2", 3.0, None)), "t")
    late = make(("1", "A", "s9", 90.0, "d2"), ("2", "A", "s2", 20.0, "d2"), ("3", "A", "s2", 30.0, "d0"), ("4", "A", "s3", 4.0, None))
    for _ in range(2):
        replaced = store.merge_upsert(late, "t", version="INGEST_DATE")
        assert rows(store.read("t"), "GAME_ID", "SEASON", "PTS") == [("1", "s1", 1.0), ("2", "s2", 20.0), ("3", "s2", 30.0), ("4", "s3", 4.0)]
    assert rows(replaced, "GAME_ID") == [("2",), ("3",), ("4",)]
    # the same version again replaces, an unknown one does not
    store.merge_upsert(make(("1", "A", "s1", 5.0, "d3"), ("2", "A", "s2", 6.0, None)), "t", version="INGEST_DATE")
    assert rows(store.read("t"), "GAME_ID", "PTS") == [("1", 5.0), ("2", 20.0), ("3", 30.0), ("4", 4.0)]


def test_new_keys_are_appended(spark, store, tmp_path):
    """A merge without matches leaves the files there as they are, and matches are looked for in the source's range of keys only."""
    store.write_partitioned(small(spark, *[(f"{i:03d}", "A", f"s{i % 3}", 1.0) for i in range(60)]), "t")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "lake" / "t").rglob("*.parquet")}
    replaced = store.merge_upsert(small(spark, ("100", "A", "s1", 2.0), ("101", "B", "s7", 2.0)), "t")
    assert replaced.isEmpty() and store.read("t").count() == 62
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    store.merge_upsert(small(spark, ("001", "A", "s1", 9.0), ("200", "A", "s2", 9.0)), "t")
    now = set((tmp_path / "lake" / "t").rglob("*.parquet"))
    assert all((p in now) == ("SEASON=s1" not in str(p)) for p in before)
    assert store.read("t").where("PTS = 9").count() == 2 and store.read("t").count() == 63


def test_partition_values_keep_their_type(spark, store):
    text = spark.createDataFrame([("1", "2025", "2025-01-02"), ("2", "007", "x")], "k string, SEASON string, day string")
    store.write_partitioned(text, "t")
    assert rows(store.read("t"), "k", "SEASON") == [("1", "2025"), ("2", "007")]
    store.append_by_ingestion(text.where("k = '1'"), "log", by="day")
    assert dict(store.read("log").dtypes)["day"] == "string" and rows(store.read("log"), "day") == [("2025-01-02",)]
    store.merge_upsert(spark.createDataFrame([("1", "2026", "y")], text.schema), "t", keys=["k"])
    assert rows(store.read("t"), "k", "SEASON") == [("1", "2026"), ("2", "007")]


def test_season_and_delimited_files(spark, tmp_path):
    df = frame(spark, league(days=5))
    df.write.option("header", True).csv(str(tmp_path / "one"))
    df.write.options(header=True, sep="|", quote="'").csv(str(tmp_path / "two" / "deep"))
    both = tables.read_season_files(spark, [str(tmp_path / "one"), str(tmp_path / "one")], schema.BRONZE_GAMES)
    assert both.count() == 2 * df.count()
    assert tables.read_delimited(spark, str(tmp_path / "two"), schema.BRONZE_GAMES, "|", "'").count() == df.count()
    tables.export_csv(df, str(tmp_path / "three"))
    assert spark.read.option("header", True).csv(str(tmp_path / "three")).count() == df.count()


def test_quality(spark):
    df = spark.createDataFrame([("2024-01-01", "1"), ("never", "x"), (None, "NaN")], "d string, n string")
    with pytest.raises(ValueError, match="a, b"):
        quality.require_columns(df, ["b", "d", "a"])
    with pytest.raises(ValueError, match="no rows"):
        quality.require_rows(df.where("false"))
    assert quality.require_rows(df) is df
    assert quality.drop_bad_dates(df, "d").count() == 1
    assert quality.numeric_values(df, "n").count() == 1
    rules = {r["rule"]: (r["value"], r["passed"]) for r in quality.evaluate_rules(
        df, {"rows": F.count(F.lit(1)), "bad": F.count_if(F.lit(False)), "unknown": F.max(F.lit(None).cast("int"))}
    ).collect()}
    assert rules == {"column_count": (2.0, True), "rows": (3.0, True), "bad": (0.0, False), "unknown": (0.0, False)}
    assert quality.normalize_names(df, "upper").columns == ["D", "N"]
    cast = quality.cast_by_map(df, {"n": "int"}).collect()
    assert [r["n"] for r in cast] == [1, None, None]


def test_sql_scan(spark):
    assert tables.sql_scan(spark, "SELECT max(id) AS m FROM {t}", t=spark.range(5)).first()["m"] == 4


def test_a_key_leaves_a_partition_with_special_characters(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = "k string, v int, SEASON string"
    store.write_partitioned(spark.createDataFrame([("a", 1, "x:y/z"), ("b", 2, "w")], rows), "t")
    store.merge_upsert(spark.createDataFrame([("a", 5, "w")], rows), "t", keys=["k"])
    assert sorted(map(tuple, store.read("t").collect())) == [("a", 5, "w"), ("b", 2, "w")]


def test_a_second_backfill_keeps_the_first(spark, tmp_path):
    from tipoff.sources.tables import backfill

    games = spark.createDataFrame([(str(y), f"{y}-12-01") for y in range(1992, 1999)], "GAME_ID string, d string")
    games = games.withColumn("GAME_DATE", F.to_date("d")).drop("d")
    first = backfill(games, str(tmp_path), 1992, 1994)
    second = backfill(games, str(tmp_path), 1995, 1998)
    assert len(first) == 3 and len(second) == 4
    assert spark.read.option("header", True).csv(first + second).count() == 7


def test_a_day_lands_packed_where_its_rows_are(spark, tmp_path):
    """landed text is packed, and the rows of one day are not moved to be written."""
    root = str(tmp_path / "b")
    day = frame(spark, [game_row(f"{k:010d}", "2025-10-21", "A", "B", True, True, FG_PCT=k / 7) for k in range(40)]).repartition(3)
    tables.land_bronze(day, root, "2025-10-21")
    files = [p.name for p in (tmp_path / "b" / "ingest_date=2025-10-21").glob("part-*")]
    assert len(files) == 3 and all(f.endswith(".csv.gz") for f in files)
    back = tables.read_bronze(spark, root, ingest_date="2025-10-21").drop("ingest_date")
    assert sorted(back.collect()) == sorted(day.collect())


def test_a_merge_leaves_no_staged_copy(spark, tmp_path, monkeypatch):
    """what a merge stages goes when it is done, a staged source is neither copied nor removed."""
    from pathlib import Path

    from tipoff.scratch import stage

    store = TableStore(spark, str(tmp_path / "lake"))
    store.write_partitioned(spark.createDataFrame([(1, "a", 1.0), (2, "a", 1.0), (3, "b", 1.0)], "k int, SEASON string, v double"), "t")
    made, plain = [], tables.stage
    monkeypatch.setattr(tables, "stage", lambda df, name: (made.append(plain(df, name)), made[-1])[1])
    source = stage(spark.createDataFrame([(1, "a", 2.0), (4, "c", 2.0)], "k int, SEASON string, v double"), "t-source")
    store.merge_upsert(source, "t", keys=["k"], unique=True)
    store.merge_upsert(source.where("k = 1"), "t", keys=["k"])
    assert sorted((r.k, r.SEASON, r.v) for r in store.read("t").collect()) == [(1, "a", 2.0), (2, "a", 1.0), (3, "b", 1.0), (4, "c", 2.0)]
    there = [df._staged_path.rsplit("/", 1)[-1].rsplit("-", 1)[0] for df in made if Path(df._staged_path).exists()]
    assert there == ["t-matched", "t-matched"] and len(made) == 5
    assert source.count() == 2
