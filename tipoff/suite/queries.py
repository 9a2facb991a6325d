"""The registered queries: one callable (spark, sf_dir) -> DataFrame per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tipoff import fixture as fx
from tipoff import schema
from tipoff.functions import exprs as X
from tipoff.operators import board, drift, games, impute, metrics, quality, runs, seasons, snapshots, splits, trials
from tipoff.operators import team_features as tf
from tipoff.operators.ordered import ordinal
from tipoff.plans import daily, history, offline, predict, training
from tipoff.plans import seasons as season_jobs
from tipoff.plans import trees
from tipoff.scratch import fresh_path, stage
from tipoff.sources import tables
from tipoff.sources.tables import TableStore
from tipoff.streaming.silver import stream_bronze_to_silver
from tipoff.streaming.snapshots import stream_game_snapshots

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ROLL_WIN = ["ROLL_WIN_PCT_5", "ROLL_WIN_PCT_10", "TEAM_SEASON_WIN_PCT"]
ROLL_BOX = [name for name in schema.ROLLING if name not in ROLL_WIN]
OPP_ROLL = [f"OPP_{name}" for name in schema.OPPONENT_ROLLING]
KEY = ["SEASON", *schema.GAME_KEY]
# columns of the history that a job reads: the model's, the pair lookup's, the drift check's, and those of the tables that serve matchups
TRAINED = [*KEY, "GAME_DATE", schema.LABEL, *schema.FEATURES]
PAIRED = ["SEASON", "TEAM_ID", "OPP_TEAM_ID", "TEAM_NAME", "OPP_TEAM_NAME", "TEAM_WIN"]
DRIFTING = ["GAME_DATE", *schema.FEATURES]
SERVED = [*PAIRED, *schema.SNAPSHOT_COLUMNS, *fx.SCHEDULED]
# the model of the queries: the library's defaults but for the trees, the fewest of the search space
QUERY_MODEL = {"n_estimators": trials.SPACE["n_estimators"][0]}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison with another engine."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def numbered(df: DataFrame) -> DataFrame:
    """``place``: the position of each row in the order that ``df`` has."""
    return ordinal(df.withColumn("_at", F.monotonically_increasing_id()), [], ["_at"], "place").drop("_at")


def long_counts(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# ---- silver and canonical rows ------------------------------------------------------
@query
def canonical_games(spark, sf):
    rows, within = fx.raw_in_orders(spark, sf)
    return rounded(games.canonicalize_games(rows, within=within))


@query
def silver_clean(spark, sf):
    raw, within = fx.raw_in_orders(spark, sf)
    rows = games.clean_silver(raw, within=within)
    return rows.select(*KEY, "GAME_DATE", "PTS", "HOME", "TEAM_WIN", "season_type", "INGEST_DATE")


@query
def rows_for_date(spark, sf):
    day = fx.silver(spark, sf).agg(F.max("GAME_DATE")).first()[0]
    return games.rows_for_date(fx.silver(spark, sf), str(day)).select(*KEY, "GAME_DATE", "PTS", "WL")


@query
def rows_for_ingest(spark, sf):
    day = fx.silver(spark, sf).agg(F.max("INGEST_DATE")).first()[0]
    return games.rows_for_ingest(fx.silver(spark, sf), day).select(*KEY, "GAME_DATE", "PTS", "INGEST_DATE")


@query
def union_tagged(spark, sf):
    raw = fx.silver(spark, sf).drop("season_type")
    month = F.month("GAME_DATE")
    frames = [
        games.tag_ingest(raw.where(test), "all", label, "2002-01-01")
        for label, test in zip(schema.SEASON_TYPES, (~month.isin(4, 5, 6), month.isin(4, 5, 6)))
    ]
    return games.stack(*frames).groupBy("SEASON", "season_type", "ingestion_date").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.avg("PTS"), 4).alias("avg_pts")
    )


# ---- windows --------------------------------------------------------------------------
@query
def roll_win_pct(spark, sf):
    rows = tf.add_team_history(fx.canonical(spark, sf).select(*KEY, "GAME_DATE", "TEAM_WIN"), ROLL_WIN, rest=False)
    return rounded(rows.select(*KEY, "GAME_DATE", "TEAM_WIN", *ROLL_WIN))


@query
def roll_box_stats(spark, sf):
    sources = dict.fromkeys(schema.ROLLING[name][0] for name in ROLL_BOX)
    rows = tf.add_team_history(fx.canonical(spark, sf).select(*KEY, "GAME_DATE", *sources), ROLL_BOX, rest=False)
    return rounded(rows.select(*KEY, *ROLL_BOX))


@query
def rest_days(spark, sf):
    return tf.add_team_history(fx.canonical(spark, sf).select(*KEY, "GAME_DATE"), [], rest=True).select(*KEY, "GAME_DATE", *schema.REST_COLUMNS)


@query
def opponent_features(spark, sf):
    sources = dict.fromkeys(schema.ROLLING[name][0] for name in schema.OPPONENT_ROLLING)
    sides = [*KEY, "HOME", "TEAM_NAME", "TEAM_WIN"]
    rows = fx.canonical(spark, sf).select(*dict.fromkeys([*sides, "GAME_DATE", *sources]))
    rolled = tf.add_team_history(rows, schema.OPPONENT_ROLLING, rest=False).select(*sides, *schema.OPPONENT_ROLLING)
    return rounded(tf.attach_opponent(rolled).select(*KEY, "HOME", "OPP_TEAM_ID", "OPP_TEAM_NAME", "OPP_TEAM_WIN", "WIN", *OPP_ROLL))


@query
def pair_history_venue(spark, sf):
    paired = tf.attach_opponent(fx.canonical(spark, sf).select(*KEY, "GAME_DATE", "HOME", "TEAM_WIN"))
    return rounded(tf.add_pair_history(paired).select(*KEY, "OPP_TEAM_ID", "HOME", schema.PAIR_WIN_PCT))


@query
def pair_history_all(spark, sf):
    paired = tf.attach_opponent(fx.canonical(spark, sf).select(*KEY, "GAME_DATE", "HOME", "TEAM_WIN"))
    return rounded(tf.add_pair_history(paired, venue_aware=False).select(*KEY, "OPP_TEAM_ID", schema.PAIR_WIN_PCT))


@query
def unpaired_games(spark, sf):
    one_sided = fx.canonical(spark, sf).where("NOT (HOME = 1 AND WL = 'L' AND TOV = 0)")
    return tf.unpaired_games(one_sided)


@query
def game_history(spark, sf):
    return rounded(history.build_history(fx.silver(spark, sf), unique=True))


@query
def season_pruned_history(spark, sf):
    return rounded(history.build_history(fx.silver(spark, sf), season="1997-98", unique=True))


@query
def latest_snapshot(spark, sf):
    return rounded(history.latest_snapshot(fx.history(spark, sf, [*schema.SNAPSHOT_COLUMNS, "GAME_ID"])))


@query
def next_game_snapshot(spark, sf):
    return rounded(history.next_game_snapshot(fx.canonical(spark, sf)))


@query
def latest_season(spark, sf):
    return history.latest_season(fx.history(spark, sf, ["SEASON", *schema.GAME_ORDER], once=True))


@query
def pair_winpct_lookup(spark, sf):
    return rounded(history.pair_win_pct(fx.history(spark, sf, PAIRED, once=True)))


@query
def home_away_ids(spark, sf):
    return tf.attach_home_away_ids(fx.canonical(spark, sf)).select(*KEY, "HOME_ID", "AWAY_ID")


# ---- imputation and the offline table --------------------------------------------------
@query
def impute_season_mean(spark, sf):
    rows = impute.impute_group_mean(fx.history(spark, sf, [*KEY, *schema.IMPUTED_FEATURES]), schema.IMPUTED_FEATURES)
    return rounded(rows.select(*KEY, *schema.IMPUTED_FEATURES))


@query
def impute_global_mean(spark, sf):
    rows = impute.impute_global_mean(fx.history(spark, sf, [*KEY, "REST_DAYS"]).select(*KEY, "REST_DAYS"), "REST_DAYS")
    return rounded(rows)


@query
def offline_features(spark, sf):
    return rounded(offline.offline_features(fx.silver(spark, sf), unique=True))


@query
def training_order(spark, sf):
    rows = games.stack(fx.history(spark, sf, ["GAME_DATE", *KEY, "WIN"]).select("GAME_DATE", *KEY, "WIN"))
    return numbered(offline.training_order(rows))


@query
def build_matrix_columns(spark, sf):
    return rounded(training.build_matrix(fx.history(spark, sf, TRAINED, once=True)).select(*KEY, *schema.FEATURES, "WIN"))


# ---- sources and sinks -------------------------------------------------------------------
def bronze_rows(spark, sf, once: bool = False) -> DataFrame:
    """``once``: for a query that reads them in one pass, so that staging them would only add a copy."""
    rows = fx.team_games(spark, sf) if once else fx.staged(spark, sf, "team_games", lambda: fx.team_games(spark, sf))
    return rows.withColumn("ingestion_date", F.col("INGEST_DATE")).select(
        *[f.name for f in schema.BRONZE_GAMES.fields]
    )


@query
def bronze_roundtrip(spark, sf):
    root = fresh_path(spark, "bronze")
    dated = bronze_rows(spark, sf, once=True).withColumn("ingest_date", F.last_day("GAME_DATE").cast("string"))
    tables.land_bronze(dated, root)
    back = games.clean_silver(tables.read_bronze(spark, root), ingest_date=F.col("ingest_date"))
    # not rounded: text and back must give the very same numbers
    return back.select(*KEY, "GAME_DATE", "PTS", "FG_PCT", "PLUS_MINUS", "HOME", "TEAM_WIN", "INGEST_DATE")


@query
def bronze_one_day(spark, sf):
    root = fresh_path(spark, "bronze")
    dated = bronze_rows(spark, sf, once=True).withColumn("ingest_date", F.last_day("GAME_DATE").cast("string"))
    tables.land_bronze(dated, root)
    return tables.read_bronze(spark, root, ingest_date="1997-03-31").select(*KEY, "GAME_DATE", "PTS", "ingest_date")


@query
def season_files(spark, sf):
    """All seasons written by one backfill job, then read as a list of season files."""
    rows = bronze_rows(spark, sf)
    year = X.season_start_year(F.to_date("GAME_DATE"))
    first, last = rows.agg(F.min(year), F.max(year)).first()
    folders = tables.backfill(rows, fresh_path(spark, "seasons"), first, last)
    back = tables.read_season_files(spark, folders, schema.BRONZE_GAMES)
    return back.groupBy("SEASON").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("PTS"), 4).alias("avg_pts"))


@query
def delimited_files(spark, sf):
    root = fresh_path(spark, "delimited")
    rows = bronze_rows(spark, sf, once=True)
    rows.write.options(header=True, sep=";", quote="'", **tables.PACKED).csv(f"{root}/nested/deeper")
    back = tables.read_delimited(spark, root, schema.BRONZE_GAMES, sep=";", quote="'")
    return rounded(back.select(*KEY, "MATCHUP", "PTS"))


@query
def export_csv(spark, sf):
    path = fresh_path(spark, "export")
    columns = [*KEY, "GAME_DATE", "ROLL_WIN_PCT_10"]
    rows = fx.history(spark, sf, columns, once=True).select(*columns)
    tables.export_csv(rows, path)
    return rounded(spark.read.schema(rows.schema).option("header", True).csv(path))


@query
def upsert_result(spark, sf):
    store = TableStore(spark, fresh_path(spark, "upsert"))
    original = fx.staged(spark, sf, "team_games", lambda: fx.team_games(spark, sf))
    last = original.agg(F.max("GAME_DATE")).scalar()
    store.write_partitioned(original.where(F.col("GAME_DATE") < last), "games")
    # new games of the last day, plus corrections of all lost games
    source = fx.team_games_raw(spark, sf).where((F.col("GAME_DATE") >= last) | (F.col("WL") == "L"))
    store.merge_upsert(source, "games", newest=["INGEST_DATE"])
    return store.read("games").select(*KEY, "GAME_DATE", "PTS", "WL", "INGEST_DATE")


@query
def partition_overwrite(spark, sf):
    store = TableStore(spark, fresh_path(spark, "overwrite"))
    rows = fx.silver(spark, sf).select(*KEY, "PTS")
    store.write_partitioned(rows, "games")
    newest = rows.where(F.col("SEASON") == rows.agg(F.max("SEASON")).scalar())
    store.overwrite_partitions(newest.withColumn("PTS", F.col("PTS") + 1), "games")
    return store.read("games").select(*KEY, "PTS")


@query
def append_by_ingestion(spark, sf):
    store = TableStore(spark, fresh_path(spark, "append"))
    rows = fx.silver(spark, sf).select(*KEY, "PTS")
    for day in ("2002-01-01", "2002-01-02"):
        store.append_by_ingestion(rows.withColumn("ingestion_date", F.lit(day)), "games")
    return store.read("games").select(*KEY, "PTS", F.col("ingestion_date").cast("string").alias("ingestion_date"))


@query
def register_table(spark, sf):
    store = TableStore(spark, fresh_path(spark, "catalog"))
    store.write_partitioned(fx.silver(spark, sf).select(*KEY, "PTS"), schema.SILVER_GAMES)
    # one name for every run, so that the catalog keeps no trace of earlier ones
    spark.sql("DROP TABLE IF EXISTS games_registered")
    name = store.register(schema.SILVER_GAMES, "games_registered")
    return spark.table(name).groupBy("SEASON").agg(F.count(F.lit(1)).alias("rows"), F.max("PTS").alias("max_pts"))


@query
def sql_scan(spark, sf):
    text = "SELECT SEASON, TEAM_ID, GAME_ID, WIN FROM {t} WHERE SEASON = (SELECT max(SEASON) FROM {t})"
    return tables.sql_scan(spark, text, t=fx.history(spark, sf, [*KEY, "WIN"]))


@query
def run_daily(spark, sf):
    """Everything before the last day as the initial load, then the last day as a daily run."""
    rows = bronze_rows(spark, sf)
    last = str(rows.agg(F.max("GAME_DATE")).first()[0])
    root, store = fresh_path(spark, "bronze"), TableStore(spark, fresh_path(spark, "lake"))
    tables.land_bronze(rows.where(F.col("GAME_DATE") < F.lit(last).cast("date")), root, "1990-01-01")
    daily.load_silver(spark, root, store)
    daily.load_gold(store)
    daily.run_daily(rows.where(F.col("GAME_DATE") == F.lit(last).cast("date")), root, store, last)
    return rounded(store.read(schema.GAME_HISTORY).select(*KEY, *schema.ROLLING, *OPP_ROLL, schema.PAIR_WIN_PCT, *schema.REST_COLUMNS))


@query
def high_water_mark(spark, sf):
    """Games, teams and players landed on the days on which items were last shipped; the newest file gives the next start."""
    root = fresh_path(spark, "landed")
    shipped = fx.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.max(F.to_date("l_shipdate")).alias("day"))
    kinds = {"games": fx.team_games(spark, sf).select(*KEY, "PTS"), "teams": fx.team_seasons_text(spark, sf).drop("season"), "player_stats": fx.player_seasons(spark, sf).drop("season")}
    days = sorted(str(r["day"]) for r in shipped.collect())  # an order has few items
    for (kind, rows), day in zip(kinds.items(), (days[0], days[len(days) // 2], days[-1])):
        tables.land_named(rows, root, kind, day)
    return tables.ingest_high_water_mark(tables.landed_files(spark, root), "2005-01-01")


@query
def landed_file_names(spark, sf):
    """The name of the file that would hold an order's games, its day, and the day as the source is asked for it."""
    day = F.to_date("o_orderdate")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", X.landed_name(F.lit("games"), X.season_label(day), day).alias("file_name"), X.us_date(day).alias("asked"),
    ).withColumn("day", X.file_date(F.col("file_name")))


@query
def late_ingest(spark, sf):
    """Corrections land first, then the older originals: each key keeps its newest ingest."""
    store = TableStore(spark, fresh_path(spark, "late"))
    rows = fx.team_games_raw(spark, sf)
    original = fx.staged(spark, sf, "team_games", lambda: fx.team_games(spark, sf))
    # an original meets itself unless its date is null, so only the others have to be looked for
    others = rows.where(F.col("INGEST_DATE").isNull() | (F.col("INGEST_DATE") != F.col("GAME_DATE").cast("string")))
    store.write_partitioned(others.join(original.select(*KEY[1:], "INGEST_DATE"), [*KEY[1:], "INGEST_DATE"], "left_anti"), "games")
    store.merge_upsert(original, "games", unique=True, version="INGEST_DATE")
    return store.read("games").select(*KEY, "GAME_DATE", "PTS", "WL", "INGEST_DATE")


@query
def daily_lookup(spark, sf):
    """The pair lookup after daily runs of the last two days, from the state of the days before."""
    rows = bronze_rows(spark, sf)
    days = sorted(str(r[0]) for r in rows.select("GAME_DATE").distinct().orderBy(F.desc("GAME_DATE")).limit(2).collect())
    root, store = fresh_path(spark, "bronze"), TableStore(spark, fresh_path(spark, "lake"))
    tables.land_bronze(rows.where(F.col("GAME_DATE") < F.lit(days[0]).cast("date")), root, "1990-01-01")
    daily.load_silver(spark, root, store)
    daily.load_gold(store)
    for day in days:
        daily.run_daily(rows.where(F.col("GAME_DATE") == F.lit(day).cast("date")), root, store, day)
    return rounded(store.read(schema.PAIR_LOOKUP))


@query
def team_season_job(spark, sf):
    """Two seasons written one after the other, each into its partition."""
    store, rows = TableStore(spark, fresh_path(spark, "seasons")), fx.team_seasons_text(spark, sf)
    for season in (2018, 2020, 2018):
        season_jobs.write_team_season(rows, store, season)
    return store.read(schema.TEAM_SEASONS).select("s_suppkey", "season", *schema.TEAM_SEASON_TYPES)


# ---- scalars ------------------------------------------------------------------------------
@query
def season_labels(spark, sf):
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", X.season_label(F.col("o_orderdate")).alias("season")
    )


@query
def season_backfill(spark, sf):
    """Every season label between the first and last order, with its orders."""
    year = X.season_start_year(F.to_date("o_orderdate"))
    counts = fx.table(spark, sf, "orders").groupBy(year.alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    span = counts.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("y")
    )
    kinds = F.explode(F.array(*[F.lit(k) for k in schema.SEASON_TYPES]))
    return (
        span.join(counts, "y", "left")
        .select(X.season_of_year(F.col("y")).alias("season"), kinds.alias("season_type"), F.coalesce("orders", F.lit(0)).alias("orders"))
        .withColumn("slug", X.slug(F.col("season_type")))
    )


@query
def clock_seconds(spark, sf):
    pbp = fx.play_by_play(spark, sf)
    return pbp.select("GAME_ID", "actionNumber", X.clock_seconds(F.col("clock"), F.col("period")).alias("seconds"))


@query
def parse_matchup(spark, sf):
    codes = fx.game_codes(spark, sf)
    return codes.select("gameId", X.parse_matchup(F.col("gameCode")).alias("m")).select(
        "gameId", F.col("m.away").alias("away"), F.col("m.home").alias("home")
    )


@query
def time_zones(spark, sf):
    ts = F.col("ts").cast("timestamp")
    return fx.table(spark, sf, "events").select(
        "event_id", X.format_time(ts).alias("shown"), X.local_date(ts, "America/Los_Angeles").cast("string").alias("local_day")
    )


@query
def metric_names(spark, sf):
    names = F.explode(F.map_keys("metrics"))
    return fx.model_runs(spark, sf).select("run_id", names.alias("raw_name")).select(
        "run_id", X.normalize_metric_name(F.col("raw_name")).alias("name"),
        X.display_metric_name(F.col("raw_name")).alias("shown"),
    )


@query
def name_case(spark, sf):
    return quality.normalize_names(fx.silver(spark, sf).select(*KEY, "PTS"))


@query
def first_present(spark, sf):
    lower = fx.silver(spark, sf).withColumnRenamed("SEASON", "SEASON_ID")
    return lower.select("GAME_ID", "TEAM_ID", X.first_present(lower, "SEASON", "season", "SEASON_ID").alias("label"))


@query
def project_ordered(spark, sf):
    return rounded(fx.history(spark, sf, [*schema.SNAPSHOT_COLUMNS, "GAME_ID"], once=True).select(*schema.SNAPSHOT_COLUMNS, "GAME_ID"))


@query
def season_filter(spark, sf):
    return fx.silver(spark, sf).where("SEASON = '1998-99' AND HOME = 1").select(*KEY, "MATCHUP", "PTS")


@query
def membership_filter(spark, sf):
    rows = fx.player_seasons(spark, sf)
    multi = F.col("team").isin(schema.MULTI_TEAM_CODES)
    return rows.withColumn("is_multi", multi).groupBy("season", "is_multi").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("g").alias("g")
    )


# ---- quality ------------------------------------------------------------------------------
@query
def quality_rules(spark, sf):
    rows = fx.table(spark, sf, "orders")
    return quality.evaluate_rules(
        rows,
        {
            "row_count": F.count(F.lit(1)),
            "keys_complete": F.every(F.col("o_orderkey").isNotNull()).cast("int"),
            "priced": F.min("o_totalprice"),
            "has_returned_status": F.count_if(F.col("o_orderstatus") == "R"),
        },
    )


@query
def bad_dates(spark, sf):
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "not a date").otherwise(F.to_date("o_orderdate").cast("string"))
    rows = fx.table(spark, sf, "orders").select("o_orderkey", text.alias("day"))
    return quality.drop_bad_dates(rows, "day")


@query
def numeric_coercion(spark, sf):
    text = F.when(F.col("event_type") == "error", F.col("props")).when(F.col("event_type") == "click", "NaN").otherwise(
        F.col("value").cast("string")
    )
    rows = fx.table(spark, sf, "events").select("event_id", text.alias("value"))
    return rounded(quality.numeric_values(rows, "value"))


@query
def cast_by_map(spark, sf):
    return quality.cast_by_map(fx.team_seasons_text(spark, sf), schema.TEAM_SEASON_TYPES)


# ---- seasons ------------------------------------------------------------------------------
@query
def team_season_gold(spark, sf):
    return seasons.team_season_gold(fx.team_seasons_text(spark, sf), 2020)


@query
def player_season_gold(spark, sf):
    return seasons.player_season_gold(fx.player_seasons(spark, sf))


@query
def multi_team_flag(spark, sf):
    return seasons.flag_multi_team(fx.player_seasons(spark, sf))


@query
def distinct_teams(spark, sf):
    return fx.silver(spark, sf).select("TEAM_ID", "TEAM_NAME").distinct()


@query
def row_counts(spark, sf):
    """Rows of three tables, observed while they are written."""
    store = TableStore(spark, fresh_path(spark, "counted"))
    found = []
    for name, df in {"silver": fx.silver(spark, sf), "history": history.build_history(fx.silver(spark, sf), unique=True), "raw": fx.team_games_raw(spark, sf)}.items():
        rows, observed = tables.counted(df, name)
        store.write_full(rows, name)
        found.append((name, observed.get["rows"]))
    return spark.createDataFrame(found, "name string, rows long")


@query
def preview(spark, sf):
    rows = fx.silver(spark, sf).select(*KEY, "GAME_DATE", "PTS")
    return numbered(rows.orderBy(*schema.GAME_ORDER, "TEAM_ID").limit(20))


# ---- splits --------------------------------------------------------------------------------
@query
def split_chronological(spark, sf):
    return splits.chronological_assignment(fx.history(spark, sf, schema.GAME_ORDER, once=True)).select(
        "GAME_ID", "first_date", F.col("game_rank").cast("long").alias("game_rank"), "split"
    )


@query
def split_in_season(spark, sf):
    return long_counts(splits.season_assignment(fx.history(spark, sf, ["SEASON", "GAME_ID"], once=True)), "game_rank")


@query
def split_summary(spark, sf):
    rows = fx.history(spark, sf, KEY)
    return long_counts(
        splits.split_summary(splits.assign_split(rows, splits.season_assignment(rows))),
        "rows", "games", "min_rows_per_game",
    )


@query
def split_rows(spark, sf):
    rows = fx.history(spark, sf, ["GAME_DATE", *KEY]).select("GAME_DATE", *KEY)
    parts = splits.split_frames(rows, splits.chronological_assignment(rows))
    return games.stack(*[df.withColumn("split", F.lit(name)) for name, df in parts.items()])


@query
def train_rows(spark, sf):
    rows = fx.history(spark, sf, ["GAME_DATE", *KEY]).select("GAME_DATE", *KEY)
    return splits.rows_in_split(rows, splits.chronological_assignment(rows), "train")


# ---- metrics -------------------------------------------------------------------------------
@query
def accuracy_logloss_auc(spark, sf):
    return rounded(metrics.evaluate(fx.scored_history(spark, sf, ["WIN"], once=True)))


@query
def metric_columns(spark, sf):
    rows = fx.scored_history(spark, sf, ["SEASON", "WIN"], once=True)
    return rounded(
        rows.groupBy("SEASON").agg(
            metrics.accuracy(F.col("WIN"), F.col("p")).alias("accuracy"),
            metrics.log_loss(F.col("WIN"), F.col("p")).alias("log_loss"),
        )
    )


@query
def confusion_matrix(spark, sf):
    rows = fx.scored_history(spark, sf, ["WIN"], once=True)
    return metrics.confusion_matrix(rows, F.col("WIN"), metrics.predicted(F.col("p")))


@query
def classification_report(spark, sf):
    rows = fx.scored_history(spark, sf, ["WIN"])
    return rounded(metrics.classification_report(rows, F.col("WIN"), metrics.predicted(F.col("p"))))


# ---- drift and health ------------------------------------------------------------------------
@query
def recency_split(spark, sf):
    reference, recent = drift.split_by_recency(fx.history(spark, sf, ["GAME_DATE", *KEY]).select("GAME_DATE", *KEY), 30)
    return games.stack(reference.withColumn("side", F.lit("reference")), recent.withColumn("side", F.lit("recent")))


@query
def quantile_edges(spark, sf):
    flagged = drift.with_recency(fx.history(spark, sf, DRIFTING), 30)
    return drift.quantile_edges(flagged, schema.FEATURES).select(
        "feature", F.col("ref_rows").cast("long").alias("ref_rows"), F.posexplode("edges").alias("position", "edge")
    ).withColumn("edge", F.round("edge", 6))


@query
def psi_by_feature(spark, sf):
    return rounded(drift.psi(drift.with_recency(fx.history(spark, sf, DRIFTING), 30), schema.FEATURES))


@query
def psi_event_values(spark, sf):
    events = fx.table(spark, sf, "events").select("value", F.to_date("ts").alias("day"))
    return rounded(drift.psi(drift.with_recency(events, 7, "day"), ["value"]))


@query
def average_psi(spark, sf):
    return rounded(drift.average_psi(drift.psi(drift.with_recency(fx.history(spark, sf, DRIFTING), 30), schema.FEATURES)))


@query
def health_report(spark, sf):
    report = training.health_report(fx.scored_history(spark, sf, [*DRIFTING, "WIN"]), fx.model_runs(spark, sf))
    return rounded(
        report.select(
            "should_retrain", F.array_join("reasons", ",").alias("reasons"), "average_psi",
            *[F.col(f"recent_metrics.{m}").alias(f"recent_{m}") for m in schema.METRICS],
            *[F.col(f"baseline_metrics.{m}").alias(f"baseline_{m}") for m in schema.METRICS],
            "recent_rows", "reference_rows",
        )
    )


@query
def latest_run(spark, sf):
    return rounded(runs.latest_metrics(fx.model_runs(spark, sf)).withColumn("start_time", F.col("start_time").cast("string")))


@query
def latest_promoted_run(spark, sf):
    newest = runs.latest_metrics(fx.model_runs(spark, sf), promoted_only=True)
    return rounded(newest.withColumn("start_time", F.col("start_time").cast("string")))


@query
def promotion_decision(spark, sf):
    candidates = fx.tuning_trials(spark, sf)
    return runs.promotion_decision(candidates, runs.latest_metrics(fx.model_runs(spark, sf), promoted_only=True))


@query
def pareto_trials(spark, sf):
    return trials.pareto_trials(fx.tuning_trials(spark, sf))


@query
def select_trial(spark, sf):
    return trials.select_trial(fx.tuning_trials(spark, sf))


@query
def draw_trials(spark, sf):
    """A point of the search space for every part, drawn by its key."""
    parts = fx.table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("trial"))
    return rounded(trials.add_draws(parts, 36))


# ---- in-game snapshots, board, matchups --------------------------------------------------------
@query
def game_snapshots(spark, sf):
    return snapshots.game_snapshots(fx.play_by_play(spark, sf))


@query
def snapshot_pregame(spark, sf):
    """The first game of an order gets the play-by-play of the user of the order's number."""
    taken = snapshots.game_snapshots(fx.play_by_play(spark, sf))
    named = taken.withColumn("GAME_ID", F.lpad(F.concat("GAME_ID", F.lit("02")), 10, "0"))
    return rounded(snapshots.attach_pregame(named, fx.history(spark, sf, ["HOME", "GAME_ID", *snapshots.PREGAME], once=True)))


@query
def games_board(spark, sf):
    return board.games_board(*fx.scoreboard(spark, sf))


@query
def lookup_pair(spark, sf):
    pairs = fx.schedule(spark, sf, PAIRED).select("home_team_id", "away_team_id").distinct()
    return rounded(predict.lookup_pair_win_pct(pairs, history.pair_win_pct(fx.history(spark, sf, PAIRED))))


def serving_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = fx.history(spark, sf, SERVED)
    return (
        fx.staged(spark, sf, "snapshot", lambda: history.latest_snapshot(rows)),
        fx.staged(spark, sf, "lookup", lambda: history.pair_win_pct(rows)),
    )


@query
def matchup_features(spark, sf):
    return rounded(predict.matchup_features(fx.schedule(spark, sf, SERVED), *serving_tables(spark, sf)))


@query
def matchup_winners(spark, sf):
    """Winner rule on a stand-in probability."""
    built = predict.matchup_features(fx.schedule(spark, sf, SERVED), *serving_tables(spark, sf))
    p = F.round((1 + F.col("ROLL_WIN_PCT_10") - F.col("OPP_ROLL_WIN_PCT_10")) / 2, 6)
    return rounded(predict.decide_winner(built.withColumn("p", p)))


# ---- models --------------------------------------------------------------------------------------
_MODELS: dict = {}


def model_and_test(spark, sf) -> tuple[PipelineModel, DataFrame]:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        rows = fx.staged(spark, sf, "training-rows", lambda: training.load_training_rows(fx.history(spark, sf, TRAINED)))
        parts = splits.split_frames(rows, splits.chronological_assignment(rows))
        model = training.fit_classifier(parts["train"].unionByName(parts["validation"]), QUERY_MODEL)
        _MODELS[key] = (model, parts["test"])
    return _MODELS[key]


@query
def fit_and_score(spark, sf):
    model, test = model_and_test(spark, sf)
    return metrics.evaluate(training.score(test, model))


@query
def feature_importance(spark, sf):
    return training.feature_importance(model_and_test(spark, sf)[0])


@query
def predict_matchups(spark, sf):
    fx.history(spark, sf, [*TRAINED, *SERVED])  # one table for both
    return predict.predict_matchups(fx.schedule(spark, sf, SERVED), *serving_tables(spark, sf), model_and_test(spark, sf)[0])


@query
def model_roundtrip(spark, sf):
    model, test = model_and_test(spark, sf)
    loaded = PipelineModel.load(training.save_model(model, fresh_path(spark, "model")))
    before = training.score(test, model).select(*schema.GAME_KEY, F.col("p").alias("p_before"))
    after = training.score(test, loaded).select(*schema.GAME_KEY, F.col("p").alias("p_after"))
    return before.join(after, schema.GAME_KEY).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p_before") != F.col("p_after")).alias("changed")
    )


@query
def tree_scores(spark, sf):
    """The saved trees, walked in a column expression, against the model: every test row's probability and every importance."""
    model, test = model_and_test(spark, sf)
    path = training.save_model(model, fresh_path(spark, "model"))
    nodes = stage(trees.tree_table(spark, path), "trees")
    filled = PipelineModel(model.stages[:-1]).transform(test).withColumn("p_trees", trees.tree_score(nodes, model.stages[-1].getMaxDepth()))
    both = model.stages[-1].transform(filled)
    off = F.abs(F.col("p_trees") - vector_to_array("probability")[1]) > 1e-9
    mine = training.feature_importance(model).withColumnRenamed("importance", "by_model")
    wrong = trees.tree_importance(nodes).join(mine, "feature").where(F.abs(F.col("importance") - F.col("by_model")) > 1e-9)
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(off | F.col("p_trees").isNull()).alias("changed")).withColumn(
        "importances_off", wrong.agg(F.count(F.lit(1))).scalar()
    )


@query
def checked_drift(spark, sf):
    """Drift per feature as the health check of a saved and promoted model reports it."""
    store = TableStore(spark, fresh_path(spark, "models"))
    path = training.save_model(model_and_test(spark, sf)[0], store.path("models/first"))
    training.record_run(store, "first", {"model_path": path}, {}, {"promoted": "true"})
    report = training.check_health(fx.history(spark, sf, TRAINED), store)
    return rounded(report.select(F.explode("drift_by_feature").alias("feature", "psi")))


# ---- streams ----------------------------------------------------------------------------------------
@query
def stream_silver(spark, sf):
    """Originals land and stream, then the corrections of lost games land and stream."""
    root, store = fresh_path(spark, "bronze"), TableStore(spark, fresh_path(spark, "lake"))
    checkpoint = fresh_path(spark, "stream-checkpoint")
    original = bronze_rows(spark, sf)
    corrected = original.where("WL = 'L'").withColumn("PTS", F.col("PTS") + 1)
    for day, rows in (("2002-01-01", original), ("2002-01-02", corrected)):
        tables.land_bronze(rows, root, day)
        stream_bronze_to_silver(spark, root, store, checkpoint).awaitTermination()
    return rounded(store.read(schema.SILVER_GAMES).select(*KEY, "GAME_DATE", "PTS", "HOME", "TEAM_WIN", "INGEST_DATE"))


@query
def stream_snapshots(spark, sf):
    """The play-by-play as two landed files, streamed in order."""
    source, out = fresh_path(spark, "pbp"), fresh_path(spark, "pbp-out")
    pbp = fx.play_by_play(spark, sf)
    last = pbp.groupBy("GAME_ID").agg(F.max("actionNumber").alias("_last"))
    marked = stage(
        pbp.join(last, "GAME_ID").withColumn("isFinal", F.col("actionNumber") == F.col("_last")).drop("_last"), "pbp"
    )
    middle = marked.agg(F.expr("max(actionNumber) div 2")).scalar()
    checkpoint = fresh_path(spark, "stream-checkpoint")
    for half in (F.col("actionNumber") <= middle, F.col("actionNumber") > middle):
        marked.where(half).write.mode("append").parquet(source)
        events = spark.readStream.schema(marked.schema).parquet(source)
        (
            stream_game_snapshots(events)
            .writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(out)
            .awaitTermination()
        )
    return spark.read.parquet(out)
