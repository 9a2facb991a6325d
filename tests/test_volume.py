"""What the game queries move and write: shuffles in the plan, staged tables, columns carried; and the rows they give."""

import re
from datetime import datetime

import pytest
from tests.conftest import frame, game_row, league, same, to_pandas

from tipoff import fixture as fx
from tipoff import schema
from tipoff.operators import games, ordered
from tipoff.operators import team_features as tf
from tipoff.plans import history as H
from tipoff.plans import offline
from tipoff.scratch import stage
from tipoff.suite import queries

KEYS = ["GAME_ID", "TEAM_ID"]


def plan(spark, df):
    """The plan of ``df`` without adaptive steps."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def shuffles(spark, df):
    return len(re.findall(r"Exchange hashpartitioning", plan(spark, df)))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Orders of one to three nations, one with a null key, a repeated line and an order without lines."""
    root = str(tmp_path_factory.mktemp("tables"))
    lines = [
        (order, part, supplier, number, 10.0, 100.0 * number + (order or 0), 0.05, 0.02)
        for order, suppliers in ((1, (1, 2, 1)), (2, (3, 3)), (3, (3, 2, 1, 3)), (None, (1, 2)), (4, (2, 3)))
        for number, (supplier, part) in enumerate(zip(suppliers, (1, 2, 1, 2)), 1)
    ]
    made = {
        "lineitem": (lines + lines[:1], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        "supplier": ([(1, 5), (2, 6), (3, 7)], "s_suppkey long, s_nationkey int"),
        "part": ([(1, 10), (2, 20)], "p_partkey long, p_size int"),
        "orders": ([(k, datetime(1996, 1 + k, 3)) for k in (1, 2, 3, 4, 5)], "o_orderkey long, o_orderdate timestamp"),
        "nation": ([(5, "E"), (6, "F"), (7, "G")], "n_nationkey int, n_name string"),
    }
    for name, (rows, columns) in made.items():
        spark.createDataFrame(rows, columns).write.parquet(f"{root}/{name}.parquet")
    return root


def test_game_rows_take_one_shuffle_of_lines(spark, tables, monkeypatch):
    monkeypatch.setattr(fx, "TASK_LINES", 5)
    # lines by order; the small tables are broadcast
    assert shuffles(spark, fx.team_games(spark, tables)) == 1
    rows = fx.team_games(spark, tables)
    assert sorted(r["GAME_ID"] for r in rows.collect()) == [f"{n:010d}" for n in (102, 102, 302, 302, 303, 303, 402, 402)]
    # order 1: nation 5 has lines 1 (twice) and 3, nation 6 line 2
    points = {r["TEAM_ID"]: r["PTS"] for r in rows.where("GAME_ID = '0000000102'").collect()}
    assert points == {"5": 101.0 * 2 + 301.0, "6": 201.0}


def test_corrections_come_with_their_rows(spark, tables):
    raw = fx.team_games_raw(spark, tables)
    assert "Union" not in plan(spark, raw)
    assert (spark.sparkContext.applicationId, tables, "team_games") not in fx._STAGED
    found = {}
    for r in raw.collect():
        found.setdefault((r["GAME_ID"], r["TEAM_ID"], r["WL"]), []).append((r["INGEST_DATE"], r["PTS"]))
    for (_, _, result), copies in found.items():
        copies.sort()
        assert len(copies) == (2 if result == "L" else 1)
        if result == "L":
            first, second = copies
            assert second[1] == first[1] + 1 and second[0] > first[0]


def test_silver_is_written_without_another_shuffle(spark, monkeypatch):
    rows = games.clean_silver(frame(spark, league(days=10)))
    hints = []
    plain = type(rows).hint
    monkeypatch.setattr(type(rows), "hint", lambda self, *a, **k: (hints.append(a), plain(self, *a, **k))[1])
    back = stage(rows, "silver-test", "SEASON")
    assert not hints
    same(to_pandas(rows, *KEYS), to_pandas(back, *KEYS))


def test_flags_follow_the_dedup(spark):
    rows = frame(spark, league(days=10))
    cleaned = games.clean_silver(rows, ingest_date="2024-01-01")
    assert cleaned.columns == [*rows.columns, "HOME", "TEAM_WIN", "INGEST_DATE"]
    moved = re.search(r"Exchange hashpartitioning.*\n.*", plan(spark, cleaned.where("PTS IS NOT NULL")))
    below = plan(spark, cleaned)[moved.end():]
    assert "AS HOME" not in below and "AS TEAM_WIN" not in below


def test_home_and_away_ids_in_one_shuffle(spark):
    rows = [
        game_row("1", "2024-01-01", "A", "B", True, True), game_row("1", "2024-01-01", "B", "A", False, False),
        game_row("2", "2024-01-02", "A", "C", False, True), game_row(None, "2024-01-03", "D", "E", True, True),
    ]
    named = tf.attach_home_away_ids(games.canonicalize_games(frame(spark, rows), unique=True))
    assert shuffles(spark, named) == 1
    got = {(r["GAME_ID"], r["TEAM_ID"]): (r["HOME_ID"], r["AWAY_ID"]) for r in named.collect()}
    assert got == {("1", "A"): ("A", "B"), ("1", "B"): ("A", "B"), ("2", "A"): (None, "A"), (None, "D"): (None, None)}


def test_history_of_a_unique_table_stages_nothing(spark, monkeypatch):
    silver = stage(games.clean_silver(frame(spark, league())), "silver-test")
    whole = to_pandas(H.build_history(games.clean_silver(frame(spark, league()))), *KEYS)
    monkeypatch.setattr(ordered, "stage", lambda *a: pytest.fail("staged"))
    same(whole, to_pandas(H.build_history(silver, unique=True), *KEYS))


def test_history_moves_the_columns_that_are_wanted(spark):
    silver = stage(games.clean_silver(frame(spark, league())), "silver-test")
    whole = to_pandas(H.build_history(silver, unique=True), *KEYS)
    wanted = [*KEYS, "OPP_TEAM_NAME", "ROLL_REB_10", "OPP_ROLL_STL_10", schema.PAIR_WIN_PCT, "BACK_TO_BACK"]
    few = H.build_history(silver, unique=True, columns=wanted)
    assert few.columns == wanted
    assert "PLUS_MINUS" not in plan(spark, few) and "FG3M" not in plan(spark, few)
    same(whole[wanted], to_pandas(few, *KEYS))


def test_offline_table_leaves_the_box_score(spark, monkeypatch):
    silver = stage(games.clean_silver(frame(spark, league())), "silver-test")
    seen, plain = [], offline.stage
    monkeypatch.setattr(offline, "stage", lambda df, name: (seen.append(df.columns), plain(df, name))[1])
    assert offline.offline_features(silver, unique=True).columns == schema.OFFLINE_COLUMNS
    assert not {"PTS", "FG3M", "PLUS_MINUS"} & set(seen[0])


@pytest.mark.parametrize("name", ["roll_win_pct", "roll_box_stats", "rest_days", "opponent_features", "pair_history_venue", "pair_history_all"])
def test_ordered_queries_stage_what_they_need(spark, tables, monkeypatch, name):
    seen, plain = [], ordered.stage
    monkeypatch.setattr(ordered, "stage", lambda df, kind: (seen.append(df.columns), plain(df, kind))[1])
    assert queries.REGISTRY[name](spark, tables).count() == 8
    assert seen and not {"PTS", "FG3M", "PLUS_MINUS", "MATCHUP"} & set(seen[0])


def test_bronze_queries_read_the_rows_once(spark, tables, monkeypatch):
    monkeypatch.setattr(fx, "staged", lambda *a, **k: pytest.fail("staged"))
    assert queries.delimited_files(spark, tables).count() == 8


def test_dedup_stays_where_an_order_lies(spark, tables, monkeypatch):
    """The lines' shuffle serves the dedup too, and the rows are those of a dedup of their own."""
    monkeypatch.setattr(fx, "TASK_LINES", 5)
    rows, within = fx.raw_in_orders(spark, tables)
    assert within == [fx.ORDER] and shuffles(spark, games.clean_silver(rows, within=within)) == 1
    plain_rows = games.clean_silver(fx.team_games_raw(spark, tables))
    assert games.clean_silver(rows, within=within).columns == plain_rows.columns
    same(to_pandas(plain_rows, *KEYS), to_pandas(games.clean_silver(rows, within=within), *KEYS))
    typed = games.canonicalize_games(rows, within=within)
    assert fx.ORDER not in typed.columns
    same(to_pandas(games.canonicalize_games(plain_rows), *KEYS), to_pandas(typed, *KEYS))


def test_dedup_leaves_the_orders_where_game_ids_may_meet(spark, tables, tmp_path):
    """With a hundred nations, the third digit of a game's number would be that of another order."""
    for name in ("lineitem", "part", "orders", "nation"):
        spark.read.parquet(f"{tables}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([(k, k) for k in range(1, 101)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rows, within = fx.raw_in_orders(spark, str(tmp_path))
    assert within == [] and fx.ORDER not in rows.columns


def test_jobs_on_history_build_the_columns_they_read(spark, tables, monkeypatch):
    """one table of few columns a job, or the larger one that is there."""
    monkeypatch.setattr(fx, "_STAGED", {})
    asked, plain_build = [], H.build_history
    monkeypatch.setattr(H, "build_history", lambda *a, **k: (asked.append(k["columns"]), plain_build(*a, **k))[1])
    assert queries.latest_season(spark, tables).collect()[0][0] is not None and len(asked) == 1
    # neither the teams' nor the pairs' games are put in order for it
    assert set(asked[0]) == {"SEASON", "GAME_DATE", "GAME_ID"}
    assert "Window" not in plan(spark, fx.history(spark, tables, ["SEASON", "GAME_ID"], once=True))
    few = to_pandas(fx.history(spark, tables, [*KEYS, "ROLL_REB_10", "OPP_ROLL_STL_10"]), *KEYS)
    made = len(asked)
    assert fx.history(spark, tables, [*KEYS, "ROLL_REB_10"]).columns == [*KEYS, "ROLL_REB_10"] and len(asked) == made
    whole = fx.history(spark, tables)
    assert len(asked) == made + 1
    same(few, to_pandas(whole, *KEYS)[list(few.columns)])
    queries.psi_by_feature(spark, tables)
    assert len(asked) == made + 1


def test_rows_of_a_game_move_as_they_are(spark):
    """the shuffle of the pairing is below its aggregates, so no partial lists are moved."""
    rows = tf.attach_opponent(games.canonicalize_games(frame(spark, league(days=10)), unique=True))
    assert shuffles(spark, rows) == 1
    shown = plan(spark, rows)
    assert shown.rindex("ObjectHashAggregate") < shown.index("Exchange hashpartitioning")


def test_tasks_of_the_history_follow_its_rows(spark, monkeypatch):
    """with few shuffle partitions a task's rows stay bounded; the rows are the same."""
    silver = stage(games.clean_silver(frame(spark, league())), "silver-test")
    whole = H.build_history(silver, unique=True)
    monkeypatch.setattr(H, "TASK_ROWS", 20)
    cut = H.build_history(silver, unique=True)
    tasks = silver.count() // 20 + 1
    assert len(re.findall(rf"Exchange hashpartitioning\([^\n]*, {tasks}\)", plan(spark, cut))) == 3
    same(to_pandas(whole, *KEYS), to_pandas(cut, *KEYS))
