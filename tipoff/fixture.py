"""Game-log rows derived from the given star-schema tables.

The nation of a supplier is a team and all its lines of an order are its box score. The order's first nation (by line
number) is at home to each of the others, one game each; an order of one nation has no opponent and gives no game. The
derivation runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff.functions import exprs as X
from tipoff.scratch import stage

_STAGED: dict[tuple[str, str, str], DataFrame] = {}
# lines of a task that makes game rows; about twice as many rows with their corrections are sorted in its memory
TASK_LINES = 250_000
# the order that a game row comes from, for those who ask for it
ORDER = "_order"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(spark: SparkSession, sf_dir: str, name: str, build, by: str | None = None) -> DataFrame:
    """A table of the medallion chain, written once per application and read by the later jobs."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name, by)
    return _STAGED[key]


def team_games(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    """One row a game and team; with ``order`` also the key of its order, by which the rows lie together."""
    # a line without an order meets none below
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    # a count of the files' footers
    tasks = table(spark, sf_dir, "lineitem").count() // TASK_LINES + 1
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("gd"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    qty, disc, line = F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber")
    shot = disc != 0
    # all lines of a team in an order; one shuffle by order serves both aggregates and the join with orders
    boxes = (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(*lines.columns, "s_nationkey", "p_size")
        .repartition(tasks, "l_orderkey")
        .groupBy("l_orderkey", "s_nationkey")
        .agg(
            F.min(line).alias("first_line"),
            F.round(F.sum("l_extendedprice"), 2).alias("PTS"),
            F.sum(F.when(shot, F.floor(qty * (1 - disc))).otherwise(0)).alias("FGM"),
            F.sum(F.when(shot, qty).otherwise(0)).alias("FGA"),
            F.sum(F.when(shot, F.floor(qty * disc * 2)).otherwise(0)).alias("FG3M"),
            F.floor(F.sum(qty) / 2).alias("FG3A"),
            F.max(disc).alias("FG3_PCT"),
            F.sum(line).alias("FTM"),
            F.sum(line + 2).alias("FTA"),
            F.max("l_tax").alias("FT_PCT"),
            F.sum(line).alias("OREB"),
            F.sum("p_size").alias("DREB"),
            F.sum(line + F.col("p_size")).alias("REB"),
            F.sum(F.col("l_partkey") % 31).alias("AST"),
            F.sum(F.col("l_suppkey") % 12).alias("STL"),
            F.sum(F.col("l_partkey") % 7).alias("BLK"),
            F.sum(F.col("l_partkey") % 5).alias("TOV"),
        )
    )
    # an order has at most one row a nation here; the array's order is that of the first two fields
    sides = boxes.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("first_line", *[c for c in boxes.columns if c not in ("l_orderkey", "first_line")]))).alias("teams")
    )
    # the date comes before the games are spread, as an order is one row here
    dated = sides.where(F.size("teams") > 1).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    games = dated.select(
        "l_orderkey", "gd", F.get("teams", F.lit(0)).alias("home"), F.posexplode(F.expr("slice(teams, 2, size(teams))")).alias("k", "away")
    )
    views = [F.struct(F.col(me).alias("me"), F.col(opp).alias("opp"), F.lit(me == "home").alias("at_home")) for me, opp in (("home", "away"), ("away", "home"))]
    rows = games.select("l_orderkey", "gd", (F.col("k") + 2).alias("number"), F.explode(F.array(*views)).alias("v")).select(
        "l_orderkey", "gd", "number", "v.at_home", "v.me.*", F.col("v.opp.s_nationkey").alias("opp_nation"), F.col("v.opp.PTS").alias("opp_price")
    )
    wide = rows.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    code = lambda nation: F.concat(F.lit("N"), F.lpad(F.col(nation).cast("string"), 2, "0"))
    number = lambda name: F.col(name).cast("double").alias(name)
    price, home = F.col("PTS"), F.col("at_home")
    return wide.select(
        F.format_string("%010d", F.col("l_orderkey").cast("long") * 100 + F.col("number")).alias("GAME_ID"),
        F.col("gd").alias("GAME_DATE"),
        X.season_label(F.col("gd")).alias("SEASON"),
        F.col("s_nationkey").cast("string").alias("TEAM_ID"),
        code("s_nationkey").alias("TEAM_ABBREVIATION"),
        F.col("n_name").alias("TEAM_NAME"),
        F.concat(code("s_nationkey"), F.when(home, " vs. ").otherwise(" @ "), code("opp_nation")).alias("MATCHUP"),
        F.when((price > F.col("opp_price")) | ((price == F.col("opp_price")) & home), "W").otherwise("L").alias("WL"),
        number("PTS"), number("FGM"), number("FGA"),
        F.when(F.col("FGA") != 0, F.col("FGM") / F.col("FGA")).alias("FG_PCT"),
        *[number(c) for c in ("FG3M", "FG3A", "FG3_PCT", "FTM", "FTA", "FT_PCT", "OREB", "DREB", "REB", "AST", "STL", "BLK", "TOV")],
        F.round(price - F.col("opp_price"), 2).alias("PLUS_MINUS"),
        F.when(F.month("gd").isin(4, 5, 6), "Playoffs").otherwise("Regular Season").alias("season_type"),
        F.col("gd").cast("string").alias("INGEST_DATE"),
        *([F.col("l_orderkey").alias(ORDER)] if order else []),
    )


def team_games_raw(spark: SparkSession, sf_dir: str, order: bool = False) -> DataFrame:
    """``team_games`` with a corrected copy of every lost game, ingested a day later with one more point."""
    kept = _STAGED.get((spark.sparkContext.applicationId, sf_dir, "team_games"))
    rows = team_games(spark, sf_dir, order) if kept is None else kept
    # row and copy come out of one pass
    lost = F.when(F.col("WL") == "L", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    later = F.date_add(F.col("INGEST_DATE").cast("date"), 1).cast("string")
    return rows.withColumn("_copy", F.explode(lost)).withColumns(
        {
            "PTS": F.when(F.col("_copy"), F.col("PTS") + 1).otherwise(F.col("PTS")),
            "INGEST_DATE": F.when(F.col("_copy"), later).otherwise(F.col("INGEST_DATE")),
        }
    ).drop("_copy")


def raw_in_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """``team_games_raw`` and what its dedup may stay within: a game has one order while its number in the order has two digits."""
    kept = (spark.sparkContext.applicationId, sf_dir, "team_games") in _STAGED
    nations = 0 if kept else table(spark, sf_dir, "supplier").agg(F.count_distinct("s_nationkey")).first()[0]
    within = [] if kept or nations > 98 else [ORDER]
    return team_games_raw(spark, sf_dir, order=bool(within)), within


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver games table, partitioned by season: one row per (game, team), newest ingest."""
    from tipoff.operators.games import clean_silver

    def build() -> DataFrame:
        rows, within = raw_in_orders(spark, sf_dir)
        return clean_silver(rows, within=within)

    return staged(spark, sf_dir, "silver", build, by="SEASON")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tipoff.operators.games import canonicalize_games

    return canonicalize_games(silver(spark, sf_dir), unique=True)


def history(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, once: bool = False) -> DataFrame:
    """The gold history table, for the jobs that read gold: all rows, with the columns that any of them reads.

    A job that names its ``columns`` gets a table of these, or a larger one if there is one by then; with ``once`` the rows of a
    job that reads them in one pass, which are not staged.
    """
    from tipoff import schema
    from tipoff.plans.history import build_history

    unread = {*schema.BOX_SCORE, "eFG_PCT", "AST_TO_RATIO", "MATCHUP", "WL"}
    read = [c for c in [*schema.HISTORY_COLUMNS, *schema.REST_COLUMNS] if c not in unread]
    wanted = read if columns is None else [c for c in read if c in columns]
    build = lambda: build_history(silver(spark, sf_dir), unique=True, columns=wanted)
    for (app, folder, name), kept in _STAGED.items():
        if (app, folder) == (spark.sparkContext.applicationId, sf_dir) and name.startswith("history") and {*wanted} <= {*kept.columns}:
            return kept.select(*wanted)
    return build() if once else staged(spark, sf_dir, "history" if wanted == read else f"history-{len(_STAGED)}", build)


def scored_history(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None, once: bool = False) -> DataFrame:
    """History with a stand-in probability that is a fixed function of recent form, with many ties."""
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.lit(0.05) + F.lit(0.9) * F.col("ROLL_WIN_PCT_10")))
    rows = history(spark, sf_dir, None if columns is None else [*columns, "ROLL_WIN_PCT_10"], once)
    return rows.withColumn("p", F.round(F.coalesce(p, F.lit(0.5)), 6))


def play_by_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as play-by-play: a user is a game, 30 days scale to 48 minutes, purchases and clicks score."""
    from tipoff.operators.ordered import Before, with_history

    elapsed = F.floor(
        (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp")))
        / 900000000
    ).cast("int")
    left = 720 - F.col("el") % 720
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("GAME_ID"),
        F.col("event_id").alias("actionNumber"),
        elapsed.alias("el"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("home_point"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("away_point"),
    )
    scored = with_history(
        events, ["GAME_ID"], ["actionNumber"],
        [Before("home_before", "home_point", "sum"), Before("away_before", "away_point", "sum")],
    )
    total = lambda side: (F.coalesce(f"{side}_before", F.lit(0)) + F.col(f"{side}_point")).cast("long")
    return scored.select(
        "GAME_ID", "actionNumber",
        F.concat(two(F.floor(left / 60)), F.lit(":"), two(left % 60)).alias("clock"),
        (1 + F.floor(F.col("el") / 720)).cast("int").alias("period"),
        total("home").alias("scoreHome"),
        total("away").alias("scoreAway"),
    )


def player_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer is a player, the order year a season; several teams in a season add a sum row."""
    from tipoff import schema

    codes = F.array(*[F.lit(c) for c in schema.TEAM_CODES])
    per_team = lambda: (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.year("o_orderdate").alias("season"),
            F.col("o_custkey").cast("string").alias("player_id"),
            F.get(codes, (F.col("o_orderkey") % len(schema.TEAM_CODES)).cast("int")).alias("team"),
        )
        .agg(F.count(F.lit(1)).alias("g"))
    )
    rows = staged(spark, sf_dir, "player_teams", per_team)
    sums = (
        rows.groupBy("season", "player_id")
        .agg(F.count(F.lit(1)).alias("teams"), F.sum("g").alias("g"))
        .where("teams >= 2")
        .select("season", "player_id", F.concat(F.col("teams").cast("string"), F.lit("TM")).alias("team"), "g")
    )
    return rows.unionByName(sums)


def team_seasons_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team season rows as text, one per supplier, with some values that are not numbers."""
    from tipoff import schema

    columns = []
    for i, (name, kind) in enumerate(schema.TEAM_SEASON_TYPES.items()):
        bad = (F.col("s_suppkey") + i) % 11 == 0
        whole = (F.col("s_suppkey") * (i + 1)) % 83
        value = {
            "int": whole.cast("string"),
            "double": F.concat(whole.cast("string"), F.lit(".25")),
            "boolean": F.when(whole % 2 == 0, "true").otherwise("false"),
            "string": F.concat(F.lit(f"{name}-"), whole.cast("string")),
        }[kind]
        columns.append(F.when(bad, "n/a").otherwise(value).alias(name))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", (2015 + F.col("s_suppkey") % 10).cast("int").alias("season"), *columns
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a model run. Metric keys come in mixed spellings; one metric is missing on small parts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    metrics = F.map_from_arrays(
        F.array(F.lit("Accuracy"), F.lit(" Log-Loss"), F.lit("roc  AUC")),
        F.array(size / 50.0, F.round(0.3 + (key % 97) / 100.0, 4), F.round(0.5 + size / 200.0, 4)),
    )
    partial = F.map_filter(metrics, lambda k, v: ~k.startswith("roc"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("run-"), F.lpad(key.cast("string"), 9, "0")).alias("run_id"),
        F.col("p_name").alias("run_name"),
        F.timestamp_seconds(1704067200 + key * 60).alias("start_time"),
        F.create_map(F.lit("triggered_by"), F.col("p_type")).alias("params"),
        F.when(size <= 3, partial).otherwise(metrics).alias("metrics"),
        F.create_map(F.lit("promoted"), F.when(size > 25, "true").otherwise("false")).alias("tags"),
    )


def tuning_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part is a trial; its two objectives are arithmetic on the key."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("trial"),
        F.round(0.4 + (key * 7919 % 1009) / 1009.0, 4).alias("log_loss"),
        F.round(0.5 + (key * 104729 % 1013) / 2026.0, 4).alias("roc_auc"),
    )


# what ``schedule`` reads of the history
SCHEDULED = ["GAME_ID", "TEAM_ID", "GAME_DATE", "OPP_TEAM_ID"]


def schedule(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Every past game row as a rematch a week later, with same-team and unknown-team entries."""
    month = F.month("GAME_DATE")
    return history(spark, sf_dir, None if columns is None else [*columns, *SCHEDULED]).select(
        F.concat_ws("-", "GAME_ID", "TEAM_ID").alias("game_id"),
        F.date_add("GAME_DATE", 7).alias("game_date"),
        F.col("TEAM_ID").alias("home_team_id"),
        F.when(month == 12, F.col("TEAM_ID")).when(month == 11, "99").otherwise(F.col("OPP_TEAM_ID")).alias("away_team_id"),
    )


# what the board reads of the history
BOARD = ["GAME_ID", "GAME_DATE", "TEAM_ABBREVIATION", "OPP_TEAM_ABBREVIATION", "HOME"]


def game_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The board's games, with codes that do not match, short codes and missing times."""
    month = F.month("GAME_DATE")
    code = F.concat(F.date_format("GAME_DATE", "yyyyMMdd"), F.lit("/"), F.col("OPP_TEAM_ABBREVIATION"), F.col("TEAM_ABBREVIATION"))
    return history(spark, sf_dir, BOARD, once=True).where("HOME = 1").select(
        F.col("GAME_ID").alias("gameId"),
        F.when(month == 1, F.lower(code)).when(month == 2, "N/A").otherwise(code).alias("gameCode"),
        F.when(month != 3, F.timestamp_seconds(F.unix_date("GAME_DATE") * F.lit(86400).cast("long") + 72000)).alias("gameTimeUTC"),
        F.when(month != 4, "Final").alias("gameStatusText"),
    )


def scoreboard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(games, teams, predictions) for the board."""
    home = history(spark, sf_dir, [*BOARD, "TEAM_SEASON_WIN_PCT"]).where("HOME = 1")
    games = game_codes(spark, sf_dir)
    teams = canonical(spark, sf_dir).select(
        F.col("GAME_ID").alias("gameId"),
        F.col("HOME").alias("position"),
        F.col("TEAM_ID").alias("teamId"),
        F.col("TEAM_ABBREVIATION").alias("teamTricode"),
        F.col("TEAM_NAME").alias("teamCity"),
        F.concat(F.lit("Club "), F.col("TEAM_ID")).alias("teamName"),
        F.when(F.col("TOV") != 0, F.col("PTS")).alias("score"),
    )
    predictions = home.where(F.month("GAME_DATE") != 5).select(
        F.col("GAME_ID").alias("gameId"),
        F.when(F.col("TEAM_SEASON_WIN_PCT") >= 0.5, F.col("TEAM_ABBREVIATION"))
        .otherwise(F.col("OPP_TEAM_ABBREVIATION"))
        .alias("predicted_winner"),
    )
    return games, teams, predictions
