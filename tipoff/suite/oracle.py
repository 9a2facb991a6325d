"""SQL for the other engine: the expected rows of each registered query, from the same tables."""

from __future__ import annotations

import math

from tipoff import schema

SQL: dict[str, str] = {}

# ---- fixed values, written out anew: an edit of the library's own lists must show as a difference
KEY = ["SEASON", "GAME_ID", "TEAM_ID"]
BOX_SCORE = [
    "PTS", "FGM", "FGA", "FG_PCT", "FG3M", "FG3A", "FG3_PCT", "FTM", "FTA", "FT_PCT",
    "OREB", "DREB", "REB", "AST", "STL", "BLK", "TOV", "PLUS_MINUS",
]
ROLL_WIN = ["ROLL_WIN_PCT_5", "ROLL_WIN_PCT_10", "TEAM_SEASON_WIN_PCT"]
ROLL_BOX = [
    "ROLL_FG_PCT_10", "ROLL_EFG_PCT_10", "ROLL_AST_TO_RATIO_10", "ROLL_REB_10", "ROLL_STL_10", "ROLL_BLK_10", "ROLL_TOV_10",
]
ROLLED = """AVG("TEAM_WIN") OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS ROLL_WIN_PCT_5,
         AVG("TEAM_WIN") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_WIN_PCT_10,
         AVG("TEAM_WIN") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS TEAM_SEASON_WIN_PCT,
         AVG("FG_PCT") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_FG_PCT_10,
         AVG("eFG_PCT") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_EFG_PCT_10,
         AVG("AST_TO_RATIO") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_AST_TO_RATIO_10,
         AVG("REB") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_REB_10,
         AVG("STL") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_STL_10,
         AVG("BLK") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_BLK_10,
         AVG("TOV") OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ROLL_TOV_10"""
# the newest game counts in a team's next one
ROLLED_NEXT = """ROUND(AVG("TEAM_WIN") OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS ROLL_WIN_PCT_5,
         ROUND(AVG("TEAM_WIN") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_WIN_PCT_10,
         ROUND(AVG("FG_PCT") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_FG_PCT_10,
         ROUND(AVG("eFG_PCT") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_EFG_PCT_10,
         ROUND(AVG("AST_TO_RATIO") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_AST_TO_RATIO_10,
         ROUND(AVG("REB") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_REB_10,
         ROUND(AVG("STL") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_STL_10,
         ROUND(AVG("BLK") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_BLK_10,
         ROUND(AVG("TOV") OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS ROLL_TOV_10"""
OPPONENT_ROLL = [
    "ROLL_WIN_PCT_10", "ROLL_FG_PCT_10", "ROLL_REB_10", "ROLL_STL_10", "ROLL_BLK_10", "ROLL_TOV_10",
]
OPP_ROLL = [
    "OPP_ROLL_WIN_PCT_10", "OPP_ROLL_FG_PCT_10", "OPP_ROLL_REB_10", "OPP_ROLL_STL_10", "OPP_ROLL_BLK_10", "OPP_ROLL_TOV_10",
]
PAIR = "TEAM_VS_OPP_SEASON_WIN_PCT"
MODEL_FEATURES = [
    "HOME", "REST_DAYS", "BACK_TO_BACK",
    "ROLL_WIN_PCT_5", "ROLL_WIN_PCT_10", "ROLL_FG_PCT_10", "ROLL_EFG_PCT_10", "ROLL_AST_TO_RATIO_10",
    "ROLL_REB_10", "ROLL_STL_10", "ROLL_BLK_10", "ROLL_TOV_10",
    "OPP_ROLL_WIN_PCT_10", "OPP_ROLL_FG_PCT_10", "OPP_ROLL_REB_10", "OPP_ROLL_STL_10", "OPP_ROLL_BLK_10", "OPP_ROLL_TOV_10",
    "TEAM_VS_OPP_SEASON_WIN_PCT",
]
SPACE = {
    "n_estimators": (100, 1000, "int"),
    "learning_rate": (0.01, 0.1, "log"),
    "max_depth": (3, 10, "int"),
    "min_child_weight": (1, 10, "int"),
    "subsample": (0.5, 1.0, "float"),
    "colsample_bytree": (0.5, 1.0, "float"),
}

# common table expressions by name, each written over earlier ones
CTES: dict[str, str] = {
    "perf": """
  SELECT l.l_orderkey AS gk, s.s_nationkey AS tk, MIN(l.l_linenumber) AS ln,
         ROUND(SUM(l.l_extendedprice), 2) AS price,
         SUM(CASE WHEN l.l_discount = 0 THEN 0 ELSE FLOOR(l.l_quantity * (1 - l.l_discount)) END) AS fgm,
         SUM(CASE WHEN l.l_discount = 0 THEN 0 ELSE l.l_quantity END) AS fga,
         SUM(CASE WHEN l.l_discount = 0 THEN 0 ELSE FLOOR(l.l_quantity * l.l_discount * 2) END) AS fg3m,
         FLOOR(SUM(l.l_quantity) / 2) AS fg3a, MAX(l.l_discount) AS disc, MAX(l.l_tax) AS tax,
         SUM(l.l_linenumber) AS lines, SUM(l.l_linenumber + 2) AS lines2, SUM(p.p_size) AS psize,
         SUM(l.l_partkey % 31) AS ast, SUM(l.l_suppkey % 12) AS stl, SUM(l.l_partkey % 7) AS blk, SUM(l.l_partkey % 5) AS tov
  FROM lineitem l
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN part p ON p.p_partkey = l.l_partkey
  GROUP BY l.l_orderkey, s.s_nationkey""",
    "ranked": """
  SELECT f.*, n.n_name AS nm, CAST(o.o_orderdate AS DATE) AS gd,
         ROW_NUMBER() OVER (PARTITION BY gk ORDER BY ln, tk) AS rk,
         CASE WHEN MONTH(o.o_orderdate) < 10 THEN YEAR(o.o_orderdate) - 1 ELSE YEAR(o.o_orderdate) END AS sy,
         'N' || LPAD(CAST(tk AS VARCHAR), 2, '0') AS abbr
  FROM perf f
  JOIN nation n ON n.n_nationkey = f.tk
  JOIN orders o ON o.o_orderkey = f.gk""",
    "team_games": """
  SELECT printf('%010d', CAST(a.gk AS BIGINT) * 100 + GREATEST(a.rk, b.rk)) AS GAME_ID, a.gd AS GAME_DATE,
         CAST(a.sy AS VARCHAR) || '-' || LPAD(CAST((a.sy + 1) % 100 AS VARCHAR), 2, '0') AS SEASON,
         CAST(a.tk AS VARCHAR) AS TEAM_ID, a.abbr AS TEAM_ABBREVIATION, a.nm AS TEAM_NAME,
         a.abbr || CASE WHEN a.rk = 1 THEN ' vs. ' ELSE ' @ ' END || b.abbr AS MATCHUP,
         CASE WHEN a.price > b.price OR (a.price = b.price AND a.rk = 1) THEN 'W' ELSE 'L' END AS WL,
         CAST(a.price AS DOUBLE) AS PTS, CAST(a.fgm AS DOUBLE) AS FGM, CAST(a.fga AS DOUBLE) AS FGA,
         CASE WHEN a.fga <> 0 THEN CAST(a.fgm AS DOUBLE) / CAST(a.fga AS DOUBLE) END AS FG_PCT,
         CAST(a.fg3m AS DOUBLE) AS FG3M, CAST(a.fg3a AS DOUBLE) AS FG3A, CAST(a.disc AS DOUBLE) AS FG3_PCT,
         CAST(a.lines AS DOUBLE) AS FTM, CAST(a.lines2 AS DOUBLE) AS FTA, CAST(a.tax AS DOUBLE) AS FT_PCT,
         CAST(a.lines AS DOUBLE) AS OREB, CAST(a.psize AS DOUBLE) AS DREB, CAST(a.lines + a.psize AS DOUBLE) AS REB,
         CAST(a.ast AS DOUBLE) AS AST, CAST(a.stl AS DOUBLE) AS STL,
         CAST(a.blk AS DOUBLE) AS BLK, CAST(a.tov AS DOUBLE) AS TOV,
         ROUND(a.price - b.price, 2) AS PLUS_MINUS,
         CASE WHEN MONTH(a.gd) IN (4, 5, 6) THEN 'Playoffs' ELSE 'Regular Season' END AS season_type,
         CAST(a.gd AS VARCHAR) AS INGEST_DATE
  FROM ranked a JOIN ranked b ON a.gk = b.gk AND a.rk <> b.rk AND (a.rk = 1 OR b.rk = 1)""",
    "raw": """
  SELECT * FROM team_games
  UNION ALL
  SELECT * REPLACE (PTS + 1 AS PTS, CAST(CAST(INGEST_DATE AS DATE) + 1 AS VARCHAR) AS INGEST_DATE)
  FROM team_games WHERE WL = 'L'""",
    "silver": """
  SELECT * EXCLUDE (newest),
         CAST(CASE WHEN regexp_matches(MATCHUP, '(?i)vs\\.') THEN 1 ELSE 0 END AS INTEGER) AS HOME,
         CAST(CASE WHEN WL = 'W' THEN 1 ELSE 0 END AS INTEGER) AS TEAM_WIN
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY GAME_ID, TEAM_ID ORDER BY INGEST_DATE DESC) AS newest FROM raw)
  WHERE newest = 1""",
    "canonical": """
  SELECT GAME_ID, GAME_DATE, SEASON, TEAM_ID, TEAM_ABBREVIATION, TEAM_NAME, MATCHUP, WL, {box},
         GAME_DATE AS LAST_GAME_DATE, HOME, TEAM_WIN,
         CASE WHEN FGA <> 0 THEN (FGM + 0.5 * FG3M) / FGA END AS "eFG_PCT",
         CASE WHEN TOV <> 0 THEN AST / TOV END AS AST_TO_RATIO
  FROM {source}""",
    "rolled": """
  SELECT *, {windows},
         CAST(date_diff('day', LAG(GAME_DATE) OVER w, GAME_DATE) - 1 AS INTEGER) AS REST_DAYS,
         CAST(CASE WHEN date_diff('day', LAG(GAME_DATE) OVER w, GAME_DATE) - 1 = 0 THEN 1 ELSE 0 END AS INTEGER) AS BACK_TO_BACK
  FROM canonical
  WINDOW w AS (PARTITION BY SEASON, TEAM_ID ORDER BY GAME_DATE, GAME_ID)""",
    "history": """
  SELECT t.*, o.TEAM_ID AS OPP_TEAM_ID, o.TEAM_ABBREVIATION AS OPP_TEAM_ABBREVIATION, o.TEAM_NAME AS OPP_TEAM_NAME,
         o.TEAM_WIN AS OPP_TEAM_WIN, t.TEAM_WIN AS WIN, {opp},
         AVG(t.TEAM_WIN) OVER (PARTITION BY t.SEASON, t.TEAM_ID, o.TEAM_ID, t.HOME ORDER BY t.GAME_DATE, t.GAME_ID
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS TEAM_VS_OPP_SEASON_WIN_PCT
  FROM rolled t JOIN rolled o ON t.GAME_ID = o.GAME_ID AND t.SEASON = o.SEASON AND t.HOME <> o.HOME""",
    "latest_season": "SELECT SEASON FROM history ORDER BY GAME_DATE DESC, GAME_ID DESC LIMIT 1",
    "snapshot": """
  SELECT * FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY TEAM_ID ORDER BY GAME_DATE DESC, GAME_ID DESC) AS rn
    FROM history WHERE SEASON = (SELECT SEASON FROM latest_season)) WHERE rn = 1""",
    "lookup": """
  SELECT SEASON, TEAM_ID AS team_id, OPP_TEAM_ID AS opp_id, TEAM_NAME AS team_name, OPP_TEAM_NAME AS opp_name,
         AVG(TEAM_WIN) AS "winPCT"
  FROM history GROUP BY ALL""",
    "ids": """
  SELECT GAME_ID, MIN(CASE WHEN HOME = 1 THEN TEAM_ID END) AS HOME_ID, MIN(CASE WHEN HOME = 0 THEN TEAM_ID END) AS AWAY_ID
  FROM canonical GROUP BY GAME_ID""",
    "scored": """
  SELECT *, ROUND(COALESCE(LEAST(0.95, GREATEST(0.05, CAST(0.05 AS DOUBLE) + CAST(0.9 AS DOUBLE) * ROLL_WIN_PCT_10)), 0.5), 6) AS p
  FROM history""",
    "flagged": """
  SELECT *, GAME_DATE >= (SELECT MAX(GAME_DATE) FROM scored) - 30 AS recent FROM scored""",
    "pairs": "{unpivot}",
    "value_rows": "SELECT feature, value, recent FROM pairs WHERE value IS NOT NULL",
    "feature_lists": """
  SELECT feature, LIST_SORT(LIST(value) FILTER (WHERE NOT recent)) AS ref, LIST(value) FILTER (WHERE recent) AS cur
  FROM value_rows GROUP BY feature""",
    "places": """
  SELECT feature, ref, cur, k, (LEN(ref) - 1) * (CASE WHEN k = 10 THEN 1.0::DOUBLE ELSE k * (1e0 / 10) END) AS h
  FROM feature_lists, (SELECT UNNEST(RANGE(0, 11)) AS k)""",
    "edge_points": """
  SELECT feature, LEN(ref) AS ref_rows, COALESCE(LEN(cur), 0) AS cur_rows,
         CASE WHEN h - FLOOR(h) < 0.5
              THEN ref[CAST(FLOOR(h) AS BIGINT) + 1] + (ref[CAST(CEIL(h) AS BIGINT) + 1] - ref[CAST(FLOOR(h) AS BIGINT) + 1]) * (h - FLOOR(h))
              ELSE ref[CAST(CEIL(h) AS BIGINT) + 1] - (ref[CAST(CEIL(h) AS BIGINT) + 1] - ref[CAST(FLOOR(h) AS BIGINT) + 1]) * (1 - (h - FLOOR(h)))
         END AS edge
  FROM places""",
    "edges": """
  SELECT feature, ref_rows, cur_rows, edge, CAST(ROW_NUMBER() OVER (PARTITION BY feature ORDER BY edge) AS INTEGER) - 1 AS position,
         LEAD(edge) OVER (PARTITION BY feature ORDER BY edge) AS upper_edge,
         COUNT(*) OVER (PARTITION BY feature) AS n_edges
  FROM (SELECT DISTINCT feature, ref_rows, cur_rows, edge FROM edge_points)""",
    "bin_shares": """
  SELECT e.feature, e.position,
         CASE WHEN COUNT(v.value) FILTER (WHERE NOT v.recent) = 0 THEN 1e-6::DOUBLE ELSE COUNT(v.value) FILTER (WHERE NOT v.recent) / ANY_VALUE(e.ref_rows)::DOUBLE END AS r,
         CASE WHEN COUNT(v.value) FILTER (WHERE v.recent) = 0 THEN 1e-6::DOUBLE ELSE COUNT(v.value) FILTER (WHERE v.recent) / ANY_VALUE(e.cur_rows)::DOUBLE END AS c
  FROM edges e LEFT JOIN value_rows v ON v.feature = e.feature AND v.value >= e.edge
       AND (v.value < e.upper_edge OR (e.position = e.n_edges - 2 AND v.value = e.upper_edge))
  WHERE e.upper_edge IS NOT NULL AND e.n_edges >= 3 AND e.ref_rows >= 5 AND e.cur_rows >= 5
  GROUP BY e.feature, e.position""",
    "drift": """
  SELECT f.feature, COALESCE(SUM((c - r) * LN(c / r)), 0) AS psi
  FROM (SELECT UNNEST({features}) AS feature) f LEFT JOIN bin_shares b ON b.feature = f.feature
  GROUP BY f.feature""",
    "metric_rows": """
  SELECT AVG(CASE WHEN WIN = CASE WHEN p > 0.5 THEN 1 ELSE 0 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy,
         -AVG(WIN * LN(p) + (1 - WIN) * LN(1 - p)) AS log_loss,
         (SELECT SUM(pos * (below + neg / 2.0)) / (SUM(pos) * SUM(neg))
          FROM (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below
                FROM (SELECT p, COUNT(*) FILTER (WHERE WIN = 1)::DOUBLE AS pos, COUNT(*) FILTER (WHERE WIN <> 1)::DOUBLE AS neg
                      FROM {scored} GROUP BY p))) AS roc_auc
  FROM {scored}""",
    "recent_scored": "SELECT * FROM flagged WHERE recent",
    "recent_metrics": "",
    "side_sizes": """
  SELECT COUNT(*) FILTER (WHERE recent) AS recent_rows, COUNT(*) FILTER (WHERE NOT recent) AS reference_rows FROM flagged""",
    "average_drift": "SELECT AVG(psi) AS average_psi FROM drift",
    "season_ranked": """
  SELECT SEASON, GAME_ID, ROW_NUMBER() OVER (PARTITION BY SEASON ORDER BY md5('36|' || GAME_ID), GAME_ID) AS game_rank,
         COUNT(*) OVER (PARTITION BY SEASON) AS n
  FROM (SELECT DISTINCT SEASON, GAME_ID FROM history)""",
    "season_split": """
  SELECT SEASON, GAME_ID, game_rank,
         CASE WHEN game_rank <= FLOOR(n * 0.7::DOUBLE) THEN 'train'
              WHEN game_rank <= FLOOR(n * 0.7::DOUBLE) + FLOOR(n * 0.2::DOUBLE) THEN 'test' ELSE 'validation' END AS split
  FROM season_ranked""",
    "date_ranked": """
  SELECT GAME_ID, first_date, ROW_NUMBER() OVER (ORDER BY first_date, GAME_ID) AS game_rank, COUNT(*) OVER () AS n
  FROM (SELECT GAME_ID, MIN(GAME_DATE) AS first_date FROM history GROUP BY GAME_ID)""",
    "date_split": """
  SELECT GAME_ID, first_date, game_rank,
         CASE WHEN game_rank <= GREATEST(1, FLOOR(n * 0.7::DOUBLE)) THEN 'train'
              WHEN game_rank <= GREATEST(GREATEST(1, FLOOR(n * 0.7::DOUBLE)) + 1, FLOOR(n * 0.85::DOUBLE)) THEN 'validation' ELSE 'test' END AS split
  FROM date_ranked""",
    "pbp": """
  SELECT CAST(user_id AS VARCHAR) AS GAME_ID, CAST(event_id AS BIGINT) AS "actionNumber", el,
         CAST(1 + el // 720 AS INTEGER) AS period, CAST(720 - el % 720 AS INTEGER) AS lft,
         CAST(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS "scoreHome",
         CAST(SUM(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS "scoreAway"
  FROM (SELECT *, CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 900000000 AS INTEGER) AS el FROM events)
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "timed": """
  SELECT *, lft + GREATEST(0, 4 - period) * 720 AS t,
         ROW_NUMBER() OVER (PARTITION BY GAME_ID ORDER BY "actionNumber") AS pos,
         COUNT(*) OVER (PARTITION BY GAME_ID) AS n
  FROM pbp""",
    "kept": """
  SELECT GAME_ID, pos, t FROM timed WHERE pos = 1
  UNION ALL
  SELECT k.GAME_ID, MIN(e.pos), ARG_MIN(e.t, e.pos)
  FROM kept k JOIN timed e ON e.GAME_ID = k.GAME_ID AND e.pos > k.pos AND k.t - e.t >= 60
  GROUP BY k.GAME_ID, k.pos""",
    "snaps": """
  SELECT e.GAME_ID, e."actionNumber" AS ACTION_NUMBER, e.period AS PERIOD, CAST(e.t AS INTEGER) AS TIME_REMAINING,
         CAST(e."scoreHome" - e."scoreAway" AS BIGINT) AS CURRENT_SCORE_DIFF, CAST(0 AS INTEGER) AS CURRENT_FG_DIFF, CAST(1 AS INTEGER) AS HOME,
         CAST(CASE WHEN f."scoreHome" > f."scoreAway" THEN 1 ELSE 0 END AS INTEGER) AS FINAL_WIN_HOME,
         e.pos = e.n AS is_final
  FROM timed e JOIN timed f ON f.GAME_ID = e.GAME_ID AND f.pos = f.n
  WHERE e.pos = e.n OR (e.GAME_ID, e.pos) IN (SELECT GAME_ID, pos FROM kept)""",
    "players_raw": """
  SELECT YEAR(o_orderdate) AS season, CAST(o_custkey AS VARCHAR) AS player_id,
         {codes}[CAST(o_orderkey % 30 AS INTEGER) + 1] AS team, COUNT(*) AS g
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""",
    "players": """
  SELECT CAST(season AS INTEGER) AS season, player_id, team, CAST(g AS BIGINT) AS g FROM players_raw
  UNION ALL
  SELECT CAST(season AS INTEGER), player_id, CAST(COUNT(*) AS VARCHAR) || 'TM', CAST(SUM(g) AS BIGINT)
  FROM players_raw GROUP BY season, player_id HAVING COUNT(*) >= 2""",
    "flagged_players": """
  SELECT p.*, CAST(CASE WHEN EXISTS (SELECT 1 FROM players m WHERE m.season = p.season AND m.player_id = p.player_id
                    AND m.team IN ('2TM', '3TM', '4TM')) THEN 1 ELSE 0 END AS INTEGER) AS changed_team
  FROM players p""",
    "teams_text": "SELECT s_suppkey, CAST(2015 + s_suppkey % 10 AS INTEGER) AS season, {columns} FROM supplier",
    "teams_typed": "SELECT s_suppkey, season, {columns} FROM teams_text",
    "runs": """
  SELECT 'run-' || LPAD(CAST(p_partkey AS VARCHAR), 9, '0') AS run_id, p_name AS run_name,
         CAST(make_timestamp((1704067200 + p_partkey * 60) * 1000000) AS TIMESTAMP) AS start_time,
         p_size / 50.0::DOUBLE AS accuracy, ROUND(0.3::DOUBLE + (p_partkey % 97) / 100.0::DOUBLE, 4) AS log_loss,
         CASE WHEN p_size > 3 THEN ROUND(0.5::DOUBLE + p_size / 200.0::DOUBLE, 4) END AS roc_auc,
         p_size > 25 AS promoted
  FROM part""",
    "newest_run": "SELECT * EXCLUDE (promoted) FROM runs ORDER BY start_time DESC, run_id DESC LIMIT 1",
    "newest_promoted": "SELECT * EXCLUDE (promoted) FROM runs WHERE promoted ORDER BY start_time DESC, run_id DESC LIMIT 1",
    "trials": """
  SELECT p_partkey AS trial, ROUND(0.4::DOUBLE + (p_partkey * 7919 % 1009) / 1009.0::DOUBLE, 4) AS log_loss,
         ROUND(0.5::DOUBLE + (p_partkey * 104729 % 1013) / 2026.0::DOUBLE, 4) AS roc_auc
  FROM part""",
    "schedule": """
  SELECT GAME_ID || '-' || TEAM_ID AS game_id, GAME_DATE + 7 AS game_date, TEAM_ID AS home_team_id,
         CASE WHEN MONTH(GAME_DATE) = 12 THEN TEAM_ID WHEN MONTH(GAME_DATE) = 11 THEN '99' ELSE OPP_TEAM_ID END AS away_team_id
  FROM history""",
    "newest_pairs": "SELECT * FROM lookup WHERE SEASON = (SELECT MAX(SEASON) FROM lookup)",
    "built": """
  SELECT s.game_id, CAST(s.game_date AS DATE) AS game_date, s.home_team_id, s.away_team_id,
         h.TEAM_ABBREVIATION AS home_team_abbr, a.TEAM_ABBREVIATION AS away_team_abbr,
         CASE WHEN s.home_team_id = s.away_team_id THEN 'home and away teams must differ'
              WHEN h.TEAM_ID IS NULL THEN 'home team has no snapshot'
              WHEN a.TEAM_ID IS NULL THEN 'away team has no snapshot'
              WHEN w."winPCT" IS NULL THEN 'pair has no win percentage' END AS error,
         1.0::DOUBLE AS HOME,
         CAST(COALESCE(date_diff('day', h.LAST_GAME_DATE, CAST(s.game_date AS DATE)) - 1, 0) AS DOUBLE) AS REST_DAYS,
         CASE WHEN COALESCE(date_diff('day', h.LAST_GAME_DATE, CAST(s.game_date AS DATE)) - 1, 0) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS BACK_TO_BACK,
         {home}, {away}, w."winPCT" AS TEAM_VS_OPP_SEASON_WIN_PCT
  FROM schedule s LEFT JOIN snapshot h ON h.TEAM_ID = s.home_team_id LEFT JOIN snapshot a ON a.TEAM_ID = s.away_team_id
       LEFT JOIN newest_pairs w ON w.team_id = s.home_team_id AND w.opp_id = s.away_team_id""",
    "board_games": """
  SELECT GAME_ID AS "gameId",
         CASE WHEN MONTH(GAME_DATE) = 1 THEN LOWER(code) WHEN MONTH(GAME_DATE) = 2 THEN 'N/A' ELSE code END AS "gameCode",
         CASE WHEN MONTH(GAME_DATE) <> 3 THEN CAST(GAME_DATE AS TIMESTAMP) + INTERVAL 20 HOUR END AS utc,
         CASE WHEN MONTH(GAME_DATE) <> 4 THEN 'Final' END AS status
  FROM (SELECT *, strftime(GAME_DATE, '%Y%m%d') || '/' || OPP_TEAM_ABBREVIATION || TEAM_ABBREVIATION AS code FROM history WHERE HOME = 1)""",
    "board_codes": """
  SELECT *, CASE WHEN LEN("gameCode") >= 6 AND LEN(tail) >= 6 THEN SUBSTR(tail, 1, 3) ELSE '' END AS away,
         CASE WHEN LEN("gameCode") >= 6 AND LEN(tail) >= 6 THEN SUBSTR(tail, 4, 3) ELSE '' END AS home
  FROM (SELECT *, SPLIT_PART("gameCode", '/', -1) AS tail FROM board_games)""",
    "board_teams": """
  SELECT GAME_ID AS gid, HOME AS pos, TEAM_ABBREVIATION AS tri, TEAM_NAME || ' Club ' || TEAM_ID AS full_name,
         CASE WHEN TOV = 0 THEN '0' WHEN PTS = FLOOR(PTS) THEN CAST(CAST(PTS AS BIGINT) AS VARCHAR) ELSE CAST(PTS AS VARCHAR) END AS score
  FROM canonical""",
}


def fill() -> None:
    box = ", ".join(BOX_SCORE)
    CTES["canonical"] = CTES["canonical"].format(box=box, source="silver")
    CTES["rolled"] = CTES["rolled"].format(windows=ROLLED)
    CTES["history"] = CTES["history"].format(opp=", ".join(f"o.{n} AS OPP_{n}" for n in OPPONENT_ROLL))
    CTES["pairs"] = "\n  UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value, recent FROM flagged" for f in MODEL_FEATURES
    )
    CTES["drift"] = CTES["drift"].format(features=str(MODEL_FEATURES))
    CTES["recent_metrics"] = CTES["metric_rows"].format(scored="recent_scored")
    CTES["metric_rows"] = CTES["metric_rows"].format(scored="scored")
    CTES["players_raw"] = CTES["players_raw"].format(codes=str(schema.TEAM_CODES))
    text, typed = [], []
    for i, (name, kind) in enumerate(schema.TEAM_SEASON_TYPES.items()):
        whole = f"(s_suppkey * {i + 1}) % 83"
        value = {
            "int": f"CAST({whole} AS VARCHAR)",
            "double": f"CAST({whole} AS VARCHAR) || '.25'",
            "boolean": f"CASE WHEN ({whole}) % 2 = 0 THEN 'true' ELSE 'false' END",
            "string": f"'{name}-' || CAST({whole} AS VARCHAR)",
        }[kind]
        text.append(f"CASE WHEN (s_suppkey + {i}) % 11 = 0 THEN 'n/a' ELSE {value} END AS {name}")
        typed.append(name if kind == "string" else f"TRY_CAST({name} AS {'INTEGER' if kind == 'int' else kind}) AS {name}")
    CTES["teams_text"] = CTES["teams_text"].format(columns=", ".join(text))
    CTES["teams_typed"] = CTES["teams_typed"].format(columns=", ".join(typed))
    home = [n for n in schema.SNAPSHOT_COLUMNS if n.startswith("ROLL_")]
    CTES["built"] = CTES["built"].format(
        home=", ".join(f"h.{n}" for n in home), away=", ".join(f"a.{n} AS OPP_{n}" for n in OPPONENT_ROLL)
    )


fill()
ORDER = list(CTES)
RECURSIVE = {"kept"}


def _names_in(text: str) -> list[str]:
    import re

    words = set(re.findall(r"[A-Za-z_]+", text))
    return [n for n in ORDER if n in words and re.search(rf"\b(FROM|JOIN|IN \(SELECT [\w, ]+ FROM)\s+{n}\b", text)]


def sql(text: str, **replaced: str) -> str:
    """``text`` with the common table expressions it needs in front. ``replaced`` overrides some by name."""
    ctes = {**CTES, **replaced}
    needed: list[str] = []

    def visit(body: str, within: str | None = None) -> None:
        for name in _names_in(body):
            if name != within and name not in needed:
                visit(ctes[name], name)
                needed.append(name)

    visit(text)
    if not needed:
        return text
    head = "WITH RECURSIVE " if RECURSIVE & set(needed) else "WITH "
    shared = {"ranked", "history", "canonical", "team_games", "flagged", "value_rows", "timed", "board_teams"}
    parts = [f"{n} AS {'MATERIALIZED ' if n in shared else ''}({ctes[n]})" for n in needed]
    return head + ",\n".join(parts) + "\n" + text


def r(*names: str, digits: int = 6, prefix: str = "") -> str:
    return ", ".join(f'ROUND({prefix}"{n}", {digits}) AS "{n}"' for n in names)


def cols(*names: str, prefix: str = "") -> str:
    return ", ".join(f'{prefix}"{n}"' for n in names)


K = cols(*KEY)
RATES = [*ROLL_WIN, *ROLL_BOX, *OPP_ROLL, PAIR]
HISTORY = ", ".join(
    f'ROUND("{c}", 6) AS "{c}"' if c in (*RATES, *BOX_SCORE, "eFG_PCT", "AST_TO_RATIO") else f'"{c}"'
    for c in [*schema.HISTORY_COLUMNS, *schema.REST_COLUMNS]
)
FEATURES = ", ".join(
    f'ROUND(COALESCE(CAST("{c}" AS DOUBLE), 0), 6) AS "{c}"' for c in MODEL_FEATURES
)
SNAP_RATES = [c for c in schema.SNAPSHOT_COLUMNS if c.startswith("ROLL_")]
SNAP_PLAIN = [c for c in schema.SNAPSHOT_COLUMNS if not c.startswith("ROLL_")]


def imputed(columns: list[str]) -> str:
    return ", ".join(
        f"ROUND(COALESCE({c}, AVG({c}) OVER (PARTITION BY SEASON), 0), 6) AS {c}" for c in columns
    )


SQL["canonical_games"] = sql(
    f'SELECT GAME_ID, GAME_DATE, SEASON, TEAM_ID, TEAM_ABBREVIATION, TEAM_NAME, MATCHUP, WL, {r(*BOX_SCORE)}, '
    f'LAST_GAME_DATE, HOME, TEAM_WIN, {r("eFG_PCT", "AST_TO_RATIO")} FROM canonical'
)
SQL["silver_clean"] = sql(f"SELECT {K}, GAME_DATE, PTS, HOME, TEAM_WIN, season_type, INGEST_DATE FROM silver")
SQL["rows_for_date"] = sql(
    f"SELECT {K}, GAME_DATE, PTS, WL FROM silver WHERE GAME_DATE = (SELECT MAX(GAME_DATE) FROM silver)"
)
SQL["rows_for_ingest"] = sql(
    f"SELECT {K}, GAME_DATE, PTS, INGEST_DATE FROM silver WHERE INGEST_DATE = (SELECT MAX(INGEST_DATE) FROM silver)"
)
SQL["union_tagged"] = sql(
    "SELECT 'all' AS SEASON, season_type, '2002-01-01' AS ingestion_date, COUNT(*) AS rows, ROUND(AVG(PTS), 4) AS avg_pts "
    "FROM silver GROUP BY season_type"
)
SQL["roll_win_pct"] = sql(f"SELECT {K}, GAME_DATE, TEAM_WIN, {r(*ROLL_WIN)} FROM rolled")
SQL["roll_box_stats"] = sql(f"SELECT {K}, {r(*ROLL_BOX)} FROM rolled")
SQL["rest_days"] = sql(f"SELECT {K}, GAME_DATE, REST_DAYS, BACK_TO_BACK FROM rolled")
SQL["opponent_features"] = sql(
    f"SELECT {K}, HOME, OPP_TEAM_ID, OPP_TEAM_NAME, OPP_TEAM_WIN, WIN, {r(*OPP_ROLL)} FROM history"
)
SQL["pair_history_venue"] = sql(f"SELECT {K}, OPP_TEAM_ID, HOME, {r(PAIR)} FROM history")
SQL["pair_history_all"] = sql(
    f"SELECT {K}, OPP_TEAM_ID, ROUND(AVG(TEAM_WIN) OVER (PARTITION BY SEASON, TEAM_ID, OPP_TEAM_ID ORDER BY GAME_DATE, GAME_ID "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS {PAIR} FROM history"
)
SQL["unpaired_games"] = sql(
    "SELECT 'no_home_row' AS reason, COUNT(*) AS games FROM (SELECT GAME_ID FROM canonical "
    "WHERE NOT (HOME = 1 AND WL = 'L' AND TOV = 0) GROUP BY GAME_ID HAVING SUM(HOME) = 0)"
)
SQL["game_history"] = sql(f"SELECT {HISTORY} FROM history")
SQL["season_pruned_history"] = sql(f"SELECT {HISTORY} FROM history WHERE SEASON = '1997-98'")
SQL["latest_snapshot"] = sql(f"SELECT {cols(*SNAP_PLAIN)}, {r(*SNAP_RATES)} FROM snapshot")
SQL["next_game_snapshot"] = sql(
    f"SELECT {cols(*SNAP_PLAIN)}, {cols(*SNAP_RATES)} FROM (SELECT {cols(*SNAP_PLAIN)}, "
    + ROLLED_NEXT
    + ", ROW_NUMBER() OVER (PARTITION BY TEAM_ID ORDER BY GAME_DATE DESC, GAME_ID DESC) AS rn FROM canonical "
    "WHERE SEASON = (SELECT SEASON FROM canonical ORDER BY GAME_DATE DESC, GAME_ID DESC LIMIT 1) "
    "WINDOW w AS (PARTITION BY TEAM_ID ORDER BY GAME_DATE, GAME_ID)) WHERE rn = 1"
)
SQL["latest_season"] = sql("SELECT SEASON FROM latest_season")
SQL["pair_winpct_lookup"] = sql('SELECT SEASON, team_id, opp_id, team_name, opp_name, ROUND("winPCT", 6) AS "winPCT" FROM lookup')
SQL["home_away_ids"] = sql(f"SELECT {cols(*KEY, prefix='c.')}, HOME_ID, AWAY_ID FROM canonical c LEFT JOIN ids i ON i.GAME_ID = c.GAME_ID")
SQL["impute_season_mean"] = sql(f"SELECT {K}, {imputed(MODEL_FEATURES[3:])} FROM history")
SQL["impute_global_mean"] = sql(
    f"SELECT {K}, ROUND(COALESCE(REST_DAYS, (SELECT AVG(REST_DAYS) FROM history)), 6) AS REST_DAYS FROM history"
)
SQL["offline_features"] = sql(
    "SELECT GAME_DATE, SEASON, h.GAME_ID AS GAME_ID, TEAM_ABBREVIATION, MATCHUP, WIN, HOME_ID, AWAY_ID, HOME, "
    "ROUND(COALESCE(REST_DAYS, (SELECT AVG(REST_DAYS) FROM history)), 6) AS REST_DAYS, BACK_TO_BACK, "
    f"{imputed(MODEL_FEATURES[3:])} FROM history h LEFT JOIN ids i ON i.GAME_ID = h.GAME_ID"
)
SQL["training_order"] = sql(
    f"SELECT GAME_DATE, {K}, WIN, ROW_NUMBER() OVER (ORDER BY GAME_DATE, GAME_ID, TEAM_ID) AS place FROM history"
)
SQL["build_matrix_columns"] = sql(f"SELECT {K}, {FEATURES}, WIN FROM history")

BRONZE = "SELECT * FROM team_games"
SQL["bronze_roundtrip"] = sql(
    f"SELECT {K}, GAME_DATE, PTS, FG_PCT, PLUS_MINUS, CAST(CASE WHEN MATCHUP LIKE '% vs. %' THEN 1 ELSE 0 END AS INTEGER) AS HOME, "
    "CAST(CASE WHEN WL = 'W' THEN 1 ELSE 0 END AS INTEGER) AS TEAM_WIN, CAST(LAST_DAY(GAME_DATE) AS VARCHAR) AS INGEST_DATE FROM team_games"
)
SQL["bronze_one_day"] = sql(
    f"SELECT {K}, CAST(GAME_DATE AS VARCHAR) AS GAME_DATE, PTS, '1997-03-31' AS ingest_date FROM team_games "
    "WHERE LAST_DAY(GAME_DATE) = DATE '1997-03-31'"
)
SQL["season_files"] = sql("SELECT SEASON, COUNT(*) AS rows, ROUND(AVG(PTS), 4) AS avg_pts FROM team_games GROUP BY SEASON")
SQL["delimited_files"] = sql(f"SELECT {K}, MATCHUP, PTS FROM team_games")
SQL["export_csv"] = sql(f"SELECT {K}, GAME_DATE, {r('ROLL_WIN_PCT_10')} FROM history")
SQL["upsert_result"] = sql(f"SELECT {K}, GAME_DATE, PTS, WL, INGEST_DATE FROM silver")
SQL["partition_overwrite"] = sql(
    f"SELECT {K}, CASE WHEN SEASON = (SELECT MAX(SEASON) FROM silver) THEN PTS + 1 ELSE PTS END AS PTS FROM silver"
)
SQL["append_by_ingestion"] = sql(
    f"SELECT {K}, PTS, ingestion_date FROM silver, (SELECT UNNEST(['2002-01-01', '2002-01-02']) AS ingestion_date)"
)
SQL["register_table"] = sql("SELECT SEASON, COUNT(*) AS rows, MAX(PTS) AS max_pts FROM silver GROUP BY SEASON")
SQL["sql_scan"] = sql("SELECT SEASON, TEAM_ID, GAME_ID, WIN FROM history WHERE SEASON = (SELECT MAX(SEASON) FROM history)")
SQL["run_daily"] = sql(
    f"SELECT {K}, {r(*RATES)}, REST_DAYS, BACK_TO_BACK FROM history", raw="SELECT * FROM team_games"
)
SQL["high_water_mark"] = (
    "SELECT MAX(CAST(l_shipdate AS DATE)) AS last_run, "
    "CASE WHEN MAX(CAST(l_shipdate AS DATE)) < DATE '2005-01-01' THEN CAST(MAX(CAST(l_shipdate AS DATE)) + 1 AS DATE) ELSE DATE '2005-01-01' END AS start_date "
    "FROM lineitem"
)
SQL["daily_lookup"] = sql(
    'SELECT SEASON, team_id, opp_id, team_name, opp_name, ROUND("winPCT", 6) AS "winPCT" FROM lookup', raw="SELECT * FROM team_games"
)
SQL["late_ingest"] = SQL["upsert_result"]
YEAR = "YEAR(o_orderdate) - CASE WHEN MONTH(o_orderdate) < 10 THEN 1 ELSE 0 END"
LABEL = "CAST(y AS VARCHAR) || '-' || LPAD(CAST((y + 1) % 100 AS VARCHAR), 2, '0')"
SQL["landed_file_names"] = (
    f"SELECT o_orderkey, 'games_' || {LABEL} || '_' || strftime(d, '%Y_%m_%d') || '.csv' AS file_name, strftime(d, '%m/%d/%Y') AS asked, d AS day "
    f"FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, {YEAR} AS y FROM orders)"
)
SQL["season_labels"] = f"SELECT o_orderkey, {LABEL} AS season FROM (SELECT o_orderkey, {YEAR} AS y FROM orders)"
SQL["season_backfill"] = (
    f"WITH c AS (SELECT {YEAR} AS y, COUNT(*) AS n FROM orders GROUP BY 1), "
    "s AS (SELECT UNNEST(RANGE((SELECT MIN(y) FROM c), (SELECT MAX(y) FROM c) + 1)) AS y) "
    f"SELECT {LABEL.replace('y ', 's.y ')} AS season, k.season_type, COALESCE(n, 0) AS orders, "
    "REPLACE(LOWER(k.season_type), ' ', '_') AS slug "
    "FROM s LEFT JOIN c ON c.y = s.y, (SELECT UNNEST(['Regular Season', 'Playoffs']) AS season_type) k"
)
SQL["clock_seconds"] = sql('SELECT GAME_ID, "actionNumber", CAST(t AS INTEGER) AS seconds FROM timed')
SQL["parse_matchup"] = sql('SELECT "gameId", away, home FROM board_codes')
SQL["metric_names"] = sql(
    "SELECT run_id, regexp_replace(LOWER(TRIM(raw)), '[\\s\\-]+', '_', 'g') AS name, REPLACE(LOWER(TRIM(raw)), ' ', '_') AS shown "
    "FROM (SELECT run_id, roc_auc, UNNEST(['Accuracy', ' Log-Loss', 'roc  AUC']) AS raw FROM runs) WHERE raw <> 'roc  AUC' OR roc_auc IS NOT NULL"
)
SQL["time_zones"] = (
    "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS shown, "
    # January 2024: eight hours behind
    "CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS local_day FROM events"
)
SQL["name_case"] = sql("SELECT SEASON AS season, GAME_ID AS game_id, TEAM_ID AS team_id, PTS AS pts FROM silver")
SQL["first_present"] = sql("SELECT GAME_ID, TEAM_ID, SEASON AS label FROM silver")
SQL["project_ordered"] = sql(f"SELECT {cols(*SNAP_PLAIN)}, {r(*SNAP_RATES)}, GAME_ID FROM history")
SQL["season_filter"] = sql(f"SELECT {K}, MATCHUP, PTS FROM silver WHERE SEASON = '1998-99' AND HOME = 1")
SQL["membership_filter"] = sql(
    "SELECT season, team IN ('2TM', '3TM', '4TM') AS is_multi, COUNT(*) AS rows, CAST(SUM(g) AS BIGINT) AS g FROM players GROUP BY ALL"
)
SQL["quality_rules"] = (
    "SELECT rule, value, value > 0 AS passed FROM ("
    "SELECT 'column_count' AS rule, 6.0::DOUBLE AS value UNION ALL "
    "SELECT 'row_count', COUNT(*)::DOUBLE FROM orders UNION ALL "
    "SELECT 'keys_complete', CASE WHEN COUNT(*) = COUNT(o_orderkey) THEN 1.0 ELSE 0.0 END FROM orders UNION ALL "
    "SELECT 'priced', MIN(o_totalprice) FROM orders UNION ALL "
    "SELECT 'has_returned_status', COUNT(*) FILTER (WHERE o_orderstatus = 'R')::DOUBLE FROM orders)"
)
SQL["bad_dates"] = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority <> '1-URGENT'"
SQL["numeric_coercion"] = "SELECT event_id, ROUND(value, 6) AS value FROM events WHERE event_type NOT IN ('error', 'click')"
SQL["cast_by_map"] = sql("SELECT * FROM teams_typed")
SQL["team_season_gold"] = sql("SELECT * FROM teams_typed WHERE season = 2020")
SQL["team_season_job"] = sql("SELECT * FROM teams_typed WHERE season IN (2018, 2020)")
SQL["player_season_gold"] = sql(
    "SELECT *, CAST(1 AS INTEGER) AS team_count FROM flagged_players "
    f"WHERE team NOT IN ('2TM', '3TM', '4TM') AND team IN {(*schema.TEAM_CODES, 'MULTI')}"
)
SQL["multi_team_flag"] = sql("SELECT * FROM flagged_players")
SQL["distinct_teams"] = sql("SELECT DISTINCT TEAM_ID, TEAM_NAME FROM silver")
SQL["row_counts"] = sql(
    "SELECT 'silver' AS name, COUNT(*) AS rows FROM silver UNION ALL SELECT 'history', COUNT(*) FROM history "
    "UNION ALL SELECT 'raw', COUNT(*) FROM raw"
)
SQL["preview"] = sql(f"SELECT {K}, GAME_DATE, PTS, ROW_NUMBER() OVER (ORDER BY GAME_DATE, GAME_ID, TEAM_ID) AS place FROM silver QUALIFY place <= 20")
SQL["split_chronological"] = sql("SELECT GAME_ID, first_date, game_rank, split FROM date_split")
SQL["split_in_season"] = sql("SELECT SEASON, GAME_ID, game_rank, split FROM season_split")
SQL["split_summary"] = sql(
    "SELECT split, CAST(SUM(n) AS BIGINT) AS rows, COUNT(*) AS games, MIN(n) AS min_rows_per_game FROM ("
    "SELECT s.split, h.GAME_ID, COUNT(*) AS n FROM history h JOIN season_split s ON s.SEASON = h.SEASON AND s.GAME_ID = h.GAME_ID "
    "GROUP BY ALL) GROUP BY split"
)
SQL["split_rows"] = sql(
    f"SELECT GAME_DATE, {cols(*KEY, prefix='h.')}, split FROM history h JOIN date_split s ON s.GAME_ID = h.GAME_ID"
)
SQL["train_rows"] = sql(
    f"SELECT GAME_DATE, {cols(*KEY, prefix='h.')} FROM history h WHERE GAME_ID IN (SELECT GAME_ID FROM date_split WHERE split = 'train')"
)
SQL["accuracy_logloss_auc"] = sql(f"SELECT {r('accuracy', 'log_loss', 'roc_auc')} FROM metric_rows")
SQL["metric_columns"] = sql(
    "SELECT SEASON, ROUND(AVG(CASE WHEN WIN = CASE WHEN p > 0.5 THEN 1 ELSE 0 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, "
    "ROUND(-AVG(WIN * LN(p) + (1 - WIN) * LN(1 - p)), 6) AS log_loss FROM scored GROUP BY SEASON"
)
SQL["confusion_matrix"] = sql(
    "SELECT CAST(label AS INTEGER) AS label, CAST(prediction AS INTEGER) AS prediction, "
    "COUNT(p) AS rows FROM (SELECT UNNEST([0, 0, 1, 1]) AS label, UNNEST([0, 1, 0, 1]) AS prediction) c "
    "LEFT JOIN scored s ON s.WIN = c.label AND CASE WHEN p > 0.5 THEN 1 ELSE 0 END = c.prediction GROUP BY ALL"
)
_CELL = "COUNT(*) FILTER (WHERE WIN = {a} AND (CASE WHEN p > 0.5 THEN 1 ELSE 0 END) = {g})::DOUBLE AS c{a}{g}"
SQL["classification_report"] = sql(
    "SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM ("
    "WITH m AS (SELECT *, c00 / (c00 + c10) AS p0, c11 / (c11 + c01) AS p1, c00 / (c00 + c01) AS r0, c11 / (c11 + c10) AS r1, "
    "2 * c00 / (2 * c00 + c10 + c01) AS f0, 2 * c11 / (2 * c11 + c10 + c01) AS f1, c00 + c01 AS s0, c10 + c11 AS s1, "
    "(c00 + c11) / (c00 + c01 + c10 + c11) AS acc FROM (SELECT "
    + ", ".join(_CELL.format(a=a, g=g) for a in (0, 1) for g in (0, 1))
    + " FROM scored)) "
    "SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM m UNION ALL SELECT '1', p1, r1, f1, s1 FROM m "
    "UNION ALL SELECT 'accuracy', acc, acc, acc, s0 + s1 FROM m "
    "UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM m "
    "UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM m)"
)
SQL["recency_split"] = sql(
    f"SELECT GAME_DATE, {K}, CASE WHEN GAME_DATE >= (SELECT MAX(GAME_DATE) FROM history) - 30 THEN 'recent' ELSE 'reference' END AS side FROM history"
)
SQL["quantile_edges"] = sql("SELECT feature, ref_rows, position, ROUND(edge, 6) AS edge FROM edges")
SQL["psi_by_feature"] = sql("SELECT feature, ROUND(psi, 6) AS psi FROM drift")
SQL["checked_drift"] = SQL["psi_by_feature"]
SQL["average_psi"] = sql("SELECT ROUND(AVG(psi), 6) AS average_psi FROM drift")
SQL["psi_event_values"] = sql(
    "SELECT feature, ROUND(psi, 6) AS psi FROM drift",
    pairs="SELECT 'value' AS feature, value, CAST(ts AS DATE) >= (SELECT MAX(CAST(ts AS DATE)) FROM events) - 7 AS recent FROM events",
    drift=CTES["drift"].replace(str(MODEL_FEATURES), "['value']"),
)
SQL["health_report"] = sql(
    "SELECT reasons <> '' AS should_retrain, reasons, ROUND(average_psi, 6) AS average_psi, ROUND(ma, 6) AS recent_accuracy, ROUND(ml, 6) AS recent_log_loss, "
    "ROUND(mr, 6) AS recent_roc_auc, ROUND(ba, 6) AS baseline_accuracy, ROUND(bl, 6) AS baseline_log_loss, ROUND(br, 6) AS baseline_roc_auc, "
    "recent_rows, reference_rows FROM ("
    "SELECT CONCAT_WS(',', CASE WHEN average_psi >= 0.2 THEN 'feature_drift_average_psi>0.2' END, "
    "CASE WHEN m.log_loss > b.log_loss + 0.03 THEN 'log_loss_degraded' END, CASE WHEN m.roc_auc < b.roc_auc - 0.03 THEN 'roc_auc_degraded' END) AS reasons, "
    "average_psi, m.accuracy AS ma, m.log_loss AS ml, m.roc_auc AS mr, b.accuracy AS ba, b.log_loss AS bl, b.roc_auc AS br, recent_rows, reference_rows "
    "FROM recent_metrics m JOIN average_drift ON TRUE LEFT JOIN newest_run b ON TRUE JOIN side_sizes ON TRUE)"
)
_RUN = f"SELECT run_id, run_name, CAST(start_time AS VARCHAR) AS start_time, {r('accuracy', 'log_loss', 'roc_auc')}"
SQL["latest_run"] = sql(f"{_RUN} FROM newest_run")
SQL["latest_promoted_run"] = sql(f"{_RUN} FROM newest_promoted")
SQL["promotion_decision"] = sql(
    "SELECT t.trial, t.log_loss, t.roc_auc, b.log_loss IS NULL OR b.roc_auc IS NULL OR (t.log_loss < b.log_loss AND t.roc_auc >= b.roc_auc) AS promote "
    "FROM trials t LEFT JOIN newest_promoted b ON TRUE"
)
SQL["pareto_trials"] = sql(
    "SELECT * FROM trials a WHERE NOT EXISTS (SELECT 1 FROM trials b WHERE b.log_loss <= a.log_loss AND b.roc_auc >= a.roc_auc "
    "AND (b.log_loss < a.log_loss OR b.roc_auc > a.roc_auc))"
)
SQL["select_trial"] = sql("SELECT * FROM trials ORDER BY log_loss, roc_auc DESC, trial LIMIT 1")


def _draw(name: str) -> str:
    low, high, kind = SPACE[name]
    u = f"(CAST('0x' || md5('36|' || CAST(trial AS VARCHAR) || '|{name}')[1:8] AS BIGINT) / 4294967296.0::DOUBLE)"
    if kind == "int":
        return f"CAST({low} + FLOOR({u} * {high - low + 1}) AS INTEGER) AS {name}"
    if kind == "log":
        a, b = math.log(low), math.log(high)
        return f"ROUND(EXP(CAST({a!r} AS DOUBLE) + {u} * (CAST({b!r} AS DOUBLE) - CAST({a!r} AS DOUBLE))), 6) AS {name}"
    return f"ROUND({low}::DOUBLE + {u} * {high - low}, 6) AS {name}"


SQL["draw_trials"] = (
    f"SELECT trial, {', '.join(_draw(n) for n in SPACE)} FROM (SELECT CAST(p_partkey AS INTEGER) AS trial FROM part)"
)
_SNAP = "GAME_ID, ACTION_NUMBER, PERIOD, TIME_REMAINING, CURRENT_SCORE_DIFF, CURRENT_FG_DIFF, HOME"
SQL["game_snapshots"] = sql(f"SELECT {_SNAP}, FINAL_WIN_HOME FROM snaps")
SQL["stream_snapshots"] = sql(
    f"SELECT {_SNAP}, FINAL_WIN_HOME FROM snaps"
)
SQL["snapshot_pregame"] = sql(
    "SELECT LPAD(s.GAME_ID || '02', 10, '0') AS GAME_ID, ACTION_NUMBER, PERIOD, TIME_REMAINING, CURRENT_SCORE_DIFF, CURRENT_FG_DIFF, "
    f"s.HOME AS HOME, FINAL_WIN_HOME, {r('ROLL_WIN_PCT_10', 'ROLL_FG_PCT_10', 'ROLL_EFG_PCT_10', 'OPP_ROLL_WIN_PCT_10')}, REST_DAYS, BACK_TO_BACK "
    "FROM snaps s LEFT JOIN history h ON h.GAME_ID = LPAD(s.GAME_ID || '02', 10, '0') AND h.HOME = 1"
)
SQL["games_board"] = sql(
    'SELECT g."gameId" AS "gameId", COALESCE(CASE WHEN a.gid IS NOT NULL AND h.gid IS NOT NULL THEN a.tri ELSE f.tri END, g.away) || \' @ \' || COALESCE(CASE WHEN a.gid IS NOT NULL AND h.gid IS NOT NULL THEN h.tri ELSE s.tri END, g.home) AS matchup, '
    "COALESCE(strftime(utc + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M'), '-') AS game_time, COALESCE(status, '-') AS status, "
    "CASE WHEN a.gid IS NOT NULL AND h.gid IS NOT NULL THEN a.score ELSE f.score END || ' - ' || CASE WHEN a.gid IS NOT NULL AND h.gid IS NOT NULL THEN h.score ELSE s.score END AS score, "
    "CASE WHEN a.gid IS NOT NULL AND h.gid IS NOT NULL THEN a.full_name ELSE f.full_name END AS away_team, CASE WHEN a.gid IS NOT NULL AND h.gid IS NOT NULL THEN h.full_name ELSE s.full_name END AS home_team, "
    "COALESCE(w.winner, 'Unknown') AS predicted_winner "
    "FROM board_codes g LEFT JOIN board_teams a ON a.gid = g.\"gameId\" AND a.tri = g.away LEFT JOIN board_teams h ON h.gid = g.\"gameId\" AND h.tri = g.home "
    "LEFT JOIN board_teams f ON f.gid = g.\"gameId\" AND f.pos = 0 LEFT JOIN board_teams s ON s.gid = g.\"gameId\" AND s.pos = 1 "
    "LEFT JOIN (SELECT GAME_ID, CASE WHEN TEAM_SEASON_WIN_PCT >= 0.5 THEN TEAM_ABBREVIATION ELSE OPP_TEAM_ABBREVIATION END AS winner "
    "FROM history WHERE HOME = 1 AND MONTH(GAME_DATE) <> 5) w ON w.GAME_ID = g.\"gameId\""
)
SQL["lookup_pair"] = sql(
    'SELECT p.home_team_id, p.away_team_id, ROUND(w."winPCT", 6) AS pair_win_pct FROM (SELECT DISTINCT home_team_id, away_team_id FROM schedule) p '
    "LEFT JOIN newest_pairs w ON w.team_id = p.home_team_id AND w.opp_id = p.away_team_id"
)
_MATCH = "game_id, home_team_id, away_team_id, home_team_abbr, away_team_abbr, error"
SQL["matchup_features"] = sql(f"SELECT {_MATCH}, game_date, {r(*MODEL_FEATURES)} FROM built")
SQL["matchup_winners"] = sql(
    "SELECT game_id, home_team_id, away_team_id, CASE WHEN p >= 0.5 THEN home_team_id WHEN p < 0.5 THEN away_team_id END AS predicted_winner_id, "
    "home_team_abbr, away_team_abbr, CASE WHEN p >= 0.5 THEN home_team_abbr WHEN p < 0.5 THEN away_team_abbr END AS predicted_winner_abbr, "
    "ROUND(p, 6) AS home_win_probability, ROUND(CASE WHEN p >= 0.5 THEN p ELSE 1 - p END, 6) AS confidence, error FROM ("
    "SELECT *, CASE WHEN error IS NULL THEN ROUND((1 + ROLL_WIN_PCT_10 - OPP_ROLL_WIN_PCT_10) / 2, 6) END AS p FROM built)"
)
SQL["stream_silver"] = sql(
    f"SELECT {K}, GAME_DATE, CASE WHEN WL = 'L' THEN PTS + 1 ELSE PTS END AS PTS, "
    "CAST(CASE WHEN MATCHUP LIKE '% vs. %' THEN 1 ELSE 0 END AS INTEGER) AS HOME, CAST(CASE WHEN WL = 'W' THEN 1 ELSE 0 END AS INTEGER) AS TEAM_WIN, "
    "CASE WHEN WL = 'L' THEN '2002-01-02' ELSE '2002-01-01' END AS INGEST_DATE FROM team_games"
)
# the loaded model scores every test row as the saved one did
SQL["model_roundtrip"] = sql(
    "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS changed FROM history h JOIN date_split s ON s.GAME_ID = h.GAME_ID WHERE split = 'test'"
)
# the saved trees, walked without MLlib, give every test row and every feature the same number
SQL["tree_scores"] = sql(
    "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS changed, CAST(0 AS BIGINT) AS importances_off FROM history h "
    "JOIN date_split s ON s.GAME_ID = h.GAME_ID WHERE split = 'test'"
)
