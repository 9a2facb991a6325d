"""In-game snapshots in batch and stream, the board, player and team seasons, and the silver stream."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import frame, game_row, league
from tipoff import schema
from tipoff.operators import board, seasons, snapshots
from tipoff.plans import daily
from tipoff.sources.tables import TableStore, land_bronze
from tipoff.streaming import snapshots as stream_snapshots
from tipoff.streaming.silver import stream_bronze_to_silver
from tipoff.streaming.snapshots import stream_game_snapshots

PBP = "GAME_ID string, actionNumber int, clock string, period int, scoreHome string, scoreAway string"


def random_game(rng, game, n, ordered=True):
    clocks = [rng.randint(0, 4 * 720 - 1) for _ in range(n)]
    if ordered:
        clocks.sort(reverse=True)
    events, home, away = [], 0, 0
    for i, left in enumerate(clocks):
        home, away = home + rng.choice([0, 2, 3]), away + rng.choice([0, 2, 3])
        period = 4 - left // 720
        events.append((game, i * 3 + 1, f"{left % 720 // 60:02d}:{left % 60:02d}", period, str(home), str(away)))
    return events


@pytest.fixture(scope="module")
def games():
    rng = random.Random(4)
    made = {f"g{i}": random_game(rng, f"g{i}", rng.randint(1, 60)) for i in range(12)}
    made["hot"] = random_game(rng, "hot", 4000)
    made["messy"] = random_game(rng, "messy", 80, ordered=False)
    made["one"] = random_game(rng, "one", 1)
    made["overtime"] = random_game(rng, "overtime", 30) + [
        ("overtime", 900 + i, f"{4 - i:02d}:30", 5, "100", "98") for i in range(5)
    ]
    made["noclock"] = [("noclock", 1, "12:00", 1, "0", "0"), ("noclock", 2, "x", 1, None, "2"), ("noclock", 3, "00:10.5", 4, "4", "2")]
    return made


def taken(df):
    rows = df.select("GAME_ID", "ACTION_NUMBER", "TIME_REMAINING", "CURRENT_SCORE_DIFF").collect()
    return sorted(tuple(r) for r in rows)


def test_snapshots_of_written_out_games(spark):
    events = [
        ("a", 1, "12:00", 1, "0", "0"), ("a", 2, "11:30", 1, "2", "0"), ("a", 3, "11:00", 1, "2", "3"), ("a", 4, "10:59", 1, "5", "3"),
        ("a", 7, "10:00", 1, "5", "6"), ("a", 8, "00:00", 4, "5", "6"), ("a", 9, "00:00", 4, "7", "6"),
        ("over", 1, "00:30", 4, "99", "99"), ("over", 2, "05:00", 5, "99", "99"), ("over", 3, "04:00", 5, "99", "101"),
        ("bad", 1, "12:00", 1, "0", "0"), ("bad", 2, "x", 1, None, "2"), ("bad", 3, "00:10.5", 4, "4", "2"),
        ("one", 5, "03:00", 2, "10", "20"),
    ]
    want = [
        ("a", 1, 2880, 0), ("a", 3, 2820, -1), ("a", 7, 2760, -1), ("a", 8, 0, -1), ("a", 9, 0, 1),
        # overtime runs on a clock of its own, so its last event is there only as the last
        ("over", 1, 30, 0), ("over", 3, 240, -2),
        ("bad", 1, 2880, 0), ("bad", 2, 0, -2), ("bad", 3, 0, 2),
        ("one", 5, 1620, -10),
    ]
    got = snapshots.game_snapshots(spark.createDataFrame(events, PBP))
    assert taken(got) == sorted(want)
    assert {r["GAME_ID"]: r["FINAL_WIN_HOME"] for r in got.collect()} == {"a": 1, "over": 0, "bad": 1, "one": 0}


@pytest.mark.parametrize("interval", [60, 300])
def test_snapshots_are_spaced(spark, games, interval):
    ordered = {g: e for g, e in games.items() if g not in ("messy", "overtime", "noclock")}
    events = [e for g in ordered.values() for e in g]
    random.Random(0).shuffle(events)
    by_game = {}
    for row in snapshots.game_snapshots(spark.createDataFrame(events, PBP), interval=interval).collect():
        assert row["HOME"] == 1 and row["CURRENT_FG_DIFF"] == 0
        by_game.setdefault(row["GAME_ID"], []).append(row)
    for game, sent in ordered.items():
        rows = sorted(by_game[game], key=lambda r: r["ACTION_NUMBER"])
        assert (rows[0]["ACTION_NUMBER"], rows[-1]["ACTION_NUMBER"]) == (sent[0][1], sent[-1][1])
        left = [r["TIME_REMAINING"] for r in rows]
        assert all(a - b >= interval for a, b in zip(left[:-2], left[1:-1]))
        # nothing due was passed over: between two snapshots no event is an interval after the first
        clock = {r["ACTION_NUMBER"]: r["TIME_REMAINING"] for r in snapshots.game_snapshots(spark.createDataFrame(sent, PBP), interval=0).collect()} if len(sent) < 30 else {}
        for a, b in zip(rows, rows[1:]):
            between = [t for n, t in clock.items() if a["ACTION_NUMBER"] < n < b["ACTION_NUMBER"]]
            assert all(a["TIME_REMAINING"] - t < interval for t in between)


def test_stream_equals_batch(spark, games, tmp_path):
    """Events arrive in three files; games end in different ones."""
    rows = [(*e, e is g[-1]) for g in games.values() for e in g]
    df = spark.createDataFrame(rows, PBP + ", isFinal boolean")
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for low, high in ((0, 60), (60, 500), (500, 10**6)):
        df.where((F.col("actionNumber") >= low) & (F.col("actionNumber") < high)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        stream_game_snapshots(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start(out).awaitTermination()
    columns = ["GAME_ID", "ACTION_NUMBER", "PERIOD", "TIME_REMAINING", "CURRENT_SCORE_DIFF", "CURRENT_FG_DIFF", "HOME", "FINAL_WIN_HOME"]
    want = snapshots.game_snapshots(spark.createDataFrame([e for g in games.values() for e in g], PBP)).select(*columns)
    assert sorted(map(tuple, spark.read.parquet(out).select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_events_are_thinned_before_the_shuffle(spark, monkeypatch):
    """A game with most of all events sends one row a clock second and input partition; what is left gives the same snapshots."""
    rng = random.Random(12)
    rows = []
    for n in range(20_000):
        t = 2880 - n * 2880 // 20_000
        rows.append(("hot", n, f"{t % 720 // 60:02d}:{t % 60:02d}", 4 - min(t // 720, 3), str(n // 200), str(n // 210), n == 19_999))
    rows += [(f"g{k}", n, f"{11 - n:02d}:00", 1, "1", "0", n == 11) for k in range(40) for n in range(12)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, PBP + ", isFinal boolean").repartition(3)
    thin = stream_snapshots.thinned_events(events)
    sizes = thin.groupBy("GAME_ID", F.spark_partition_id().alias("part")).count().where("GAME_ID = 'hot'").collect()
    assert len(sizes) == 3 and all(r["count"] <= 2881 for r in sizes)
    assert "Exchange" not in thin._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    columns = ["GAME_ID", "ACTION_NUMBER", "PERIOD", "TIME_REMAINING", "CURRENT_SCORE_DIFF"]
    want = sorted(map(tuple, snapshots.game_snapshots(events).select(*columns).collect()))
    monkeypatch.setattr(stream_snapshots, "HELD_EVENTS", 500)
    for frame_ in (thin, stream_snapshots.thinned_events(events)):
        again = frame_.select("GAME_ID", F.col("ACTION_NUMBER").alias("actionNumber"), F.format_string("%02d:%02d", F.expr("TIME_REMAINING % 720 div 60"), F.expr("TIME_REMAINING % 60")).alias("clock"), (4 - F.expr("TIME_REMAINING div 720")).alias("period"), "scoreHome", "scoreAway")
        same_clock = [r[1] for r in snapshots.game_snapshots(again).where("GAME_ID <> 'hot'").select(*columns).collect()]
        assert sorted(same_clock) == sorted(r[1] for r in want if r[0] != "hot")


def test_pregame(spark):
    from tipoff.plans.history import build_history

    history = build_history(frame(spark, league(days=12)))
    game = history.first()["GAME_ID"]
    taken_rows = snapshots.game_snapshots(
        spark.createDataFrame([(game, 1, "12:00", 1, "0", "0"), ("other", 1, "12:00", 1, "0", "0")], PBP)
    )
    got = {r["GAME_ID"]: r for r in snapshots.attach_pregame(taken_rows, history).collect()}
    home = history.where((F.col("GAME_ID") == game) & (F.col("HOME") == 1)).first()
    assert got[game]["ROLL_WIN_PCT_10"] == home["ROLL_WIN_PCT_10"] and got["other"]["REST_DAYS"] is None


def test_board(spark):
    games = spark.createDataFrame(
        [("1", "20240101/AAABBB", "2024-01-01 20:00:00", "Final"), ("2", "20240101/XXXBBB", None, None), ("3", "bad", None, "Q1")],
        "gameId string, gameCode string, t string, gameStatusText string",
    ).withColumn("gameTimeUTC", F.to_timestamp("t"))
    teams = spark.createDataFrame(
        [("1", 0, "20", "BBB", "B City", "Bs", 99.0), ("1", 1, "10", "AAA", "A City", "As", 101.5),
         ("2", 0, "10", "AAA", "A City", "As", None), ("2", 1, "20", "BBB", "B City", "Bs", 80.0), ("2", 2, "30", "CCC", "C", "Cs", 1.0)],
        "gameId string, position int, teamId string, teamTricode string, teamCity string, teamName string, score double",
    )
    predictions = spark.createDataFrame([("1", "AAA")], "gameId string, predicted_winner string")
    got = {r["gameId"]: r for r in board.games_board(games, teams, predictions).collect()}
    assert got["1"].asDict() == {
        "gameId": "1", "matchup": "AAA @ BBB", "game_time": "2024-01-02 04:00", "status": "Final", "score": "101.5 - 99",
        "away_team": "A City As", "home_team": "B City Bs", "predicted_winner": "AAA",
    }
    # the away code is unknown: both sides come from the first two team rows
    assert (got["2"]["matchup"], got["2"]["score"], got["2"]["game_time"], got["2"]["status"]) == ("AAA @ BBB", "0 - 80", "-", "-")
    assert (got["3"]["matchup"], got["3"]["away_team"], got["3"]["predicted_winner"]) == (" @ ", "", "Unknown")


def test_player_seasons(spark):
    rows = [(2024, "p1", "BOS"), (2024, "p1", "LAL"), (2024, "p1", "2TM"), (2023, "p1", "BOS"), (2024, "p2", "MIA"), (2024, "p3", "SEA")]
    df = spark.createDataFrame(rows, "season int, player_id string, team string")
    got = seasons.player_season_gold(df, 2024).orderBy("player_id", "team").collect()
    assert [(r["player_id"], r["team"], r["team_count"], r["changed_team"]) for r in got] == [
        ("p1", "BOS", 1, 1), ("p1", "LAL", 1, 1), ("p2", "MIA", 1, 0),
    ]
    counts = {r["team"]: r["team_count"] for r in seasons.team_count(df).collect()}
    assert counts["2TM"] == 2 and counts["BOS"] == 1
    earlier = seasons.player_season_gold(df, 2023).collect()
    assert [r["changed_team"] for r in earlier] == [0]


def test_team_seasons(spark):
    df = spark.createDataFrame([("41", "true", "99.5", "x", 2024), ("n/a", "maybe", "n/a", None, 2023)],
                               "w string, playoffs string, pace string, arena string, season int")
    got = seasons.team_season_gold(df).orderBy("season").collect()
    assert [tuple(r) for r in got] == [(None, None, None, None, 2023), (41, True, 99.5, "x", 2024)]
    assert seasons.team_season_gold(df, 2024).count() == 1


def test_silver_stream_equals_batch(spark, tmp_path):
    bronze, checkpoint = str(tmp_path / "bronze"), str(tmp_path / "cp")
    streamed, batch = TableStore(spark, str(tmp_path / "s")), TableStore(spark, str(tmp_path / "b"))
    rows = league(seed=3, teams=4, days=6)
    land_bronze(frame(spark, rows), bronze, "2024-01-01")
    stream_bronze_to_silver(spark, bronze, streamed, checkpoint).awaitTermination()
    fixed = [{**r, "PTS": r["PTS"] + 1} for r in rows[:6]] + [game_row("9" * 10, "2023-12-31", "T0", "T1", True, True)]
    land_bronze(frame(spark, fixed), bronze, "2024-01-02")
    for _ in range(2):  # nothing new the second time
        stream_bronze_to_silver(spark, bronze, streamed, checkpoint).awaitTermination()
    daily.load_silver(spark, bronze, batch)
    columns = ["GAME_ID", "TEAM_ID", "SEASON", "PTS", "HOME", "TEAM_WIN", "INGEST_DATE"]
    read = lambda store: sorted(tuple(r) for r in store.read(schema.SILVER_GAMES).select(*columns).collect())
    assert read(streamed) == read(batch) and len(read(batch)) == len(rows) + 1


def test_team_season_job(spark, tmp_path):
    from tipoff.plans.seasons import write_team_season

    columns = ", ".join(f"{c} string" for c in schema.TEAM_SEASON_TYPES)
    text = spark.createDataFrame([(y, *["7"] * len(schema.TEAM_SEASON_TYPES)) for y in (2019, 2020, 2020)], "season int, " + columns)
    store = TableStore(spark, str(tmp_path))
    assert write_team_season(text, store, 2020) == 2 and write_team_season(text, store, 2019) == 1
    assert write_team_season(text.where("season = 2019").limit(1), store, 2019) == 1
    assert store.read(schema.TEAM_SEASONS).groupBy("season").count().orderBy("season").collect() == [(2019, 1), (2020, 2)]
    with pytest.raises(ValueError, match="no rows"):
        write_team_season(text, store, 1999)
    assert store.read(schema.TEAM_SEASONS).count() == 3
