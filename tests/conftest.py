from __future__ import annotations

import random
import sys
from datetime import date, timedelta
from pathlib import Path

import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tipoff import schema  # noqa: E402
from tipoff.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def game_row(game, day, team, opponent, home, won, season="2023-24", **stats):
    """One team's row of a game; unnamed stats get plain values."""
    row = {
        "GAME_ID": game, "GAME_DATE": day, "SEASON": season, "TEAM_ID": team, "TEAM_ABBREVIATION": team,
        "TEAM_NAME": f"Team {team}", "MATCHUP": f"{team} {'vs.' if home else '@'} {opponent}",
        "WL": {True: "W", False: "L", None: None}[won],
    }
    row.update({c: 10.0 for c in schema.BOX_SCORE})
    row.update({"season_type": "Regular Season", "ingestion_date": day}, **stats)
    return row


def league(seed=7, teams=6, days=60, start=date(2023, 10, 20), seasons=1):
    """Rows of a small league: every other day a random round of games."""
    rng = random.Random(seed)
    names = [f"T{i}" for i in range(teams)]
    rows, number = [], 0
    for s in range(seasons):
        first = date(start.year + s, start.month, start.day)
        label = f"{first.year}-{(first.year + 1) % 100:02d}"
        for offset in range(days):
            if rng.random() < 0.4:
                continue
            day = (first + timedelta(days=offset)).isoformat()
            rng.shuffle(names)
            for home, away in zip(names[::2], names[1::2]):
                if rng.random() < 0.3:
                    continue
                number += 1
                won = rng.random() < 0.55
                for team, opp, is_home, win in ((home, away, True, won), (away, home, False, not won)):
                    stats = {c: float(rng.randint(0, 12)) for c in ("FGM", "FGA", "FG3M", "AST", "TOV", "REB", "STL", "BLK", "PTS")}
                    stats["FG_PCT"] = None if rng.random() < 0.1 else rng.randint(300, 600) / 1000
                    rows.append(game_row(f"{number:010d}", day, team, opp, is_home, win, label, **stats))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.BRONZE_GAMES.fields) for r in rows], schema.BRONZE_GAMES)


def to_pandas(df, *keys):
    out = df.toPandas()
    return out.sort_values(list(keys)).reset_index(drop=True)


def same(left, right):
    pd.testing.assert_frame_equal(left, right[left.columns], check_dtype=False, rtol=1e-9, atol=1e-12)
