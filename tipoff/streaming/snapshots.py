"""In-game snapshots as a keyed stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tipoff.operators.snapshots import timed_columns

OUTPUT = (
    "GAME_ID string, ACTION_NUMBER bigint, PERIOD int, TIME_REMAINING int, CURRENT_SCORE_DIFF bigint, "
    "CURRENT_FG_DIFF int, HOME int, FINAL_WIN_HOME int"
)


KEPT = "ACTION_NUMBER bigint, PERIOD int, TIME_REMAINING int, scoreHome bigint, scoreAway bigint"
KEPT_COLUMNS = ["ACTION_NUMBER", "PERIOD", "TIME_REMAINING", "scoreHome", "scoreAway"]


class GreedySnapshots(StatefulProcessor):
    """State per game: seconds left at the last snapshot, and the snapshots so far (one a minute of the clock at most).

    Snapshots come out when the game's final event does, all with the winner.

    Batches must bring a game's events in order; within a batch any order will do. ``first_per_second`` has thinned
    the events before they got here; what several input partitions bring of one clock second is reduced here again.
    """

    def __init__(self, interval: int = 60):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "remaining int")
        self.kept = handle.getListState("kept", KEPT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept_rows, finals = None, []
        for chunk in rows:
            finals.append(chunk[chunk["isFinal"]])
            pool = chunk if kept_rows is None else pd.concat([kept_rows, chunk])
            kept_rows = pool.sort_values("ACTION_NUMBER").drop_duplicates("TIME_REMAINING")
        if kept_rows is None:
            return
        last = self.last.get()[0] if self.last.exists() else None
        due = []
        for position, remaining in enumerate(kept_rows["TIME_REMAINING"].tolist()):
            if last is None or last - remaining >= self.interval:
                due.append(position)
                last = remaining
        out = kept_rows.iloc[due]
        ends = pd.concat(finals)
        if not len(ends):
            self.last.update((int(last),))
            if len(out):
                self.kept.appendList([tuple(map(int, r)) for r in out[KEPT_COLUMNS].itertuples(index=False)])
            return
        out = pd.concat([out, ends[~ends["ACTION_NUMBER"].isin(out["ACTION_NUMBER"])]])
        earlier = pd.DataFrame(list(self.kept.get()) if self.kept.exists() else [], columns=KEPT_COLUMNS)
        out = pd.concat([earlier, out[KEPT_COLUMNS]]).astype("int64")
        self.last.clear()
        self.kept.clear()
        end = ends.iloc[-1]
        yield pd.DataFrame(
            {
                "GAME_ID": key[0],
                "ACTION_NUMBER": out["ACTION_NUMBER"],
                "PERIOD": out["PERIOD"],
                "TIME_REMAINING": out["TIME_REMAINING"],
                "CURRENT_SCORE_DIFF": out["scoreHome"] - out["scoreAway"],
                "CURRENT_FG_DIFF": 0,
                "HOME": 1,
                "FINAL_WIN_HOME": int(end["scoreHome"] > end["scoreAway"]),
            }
        ).reset_index(drop=True)

    def close(self) -> None:
        pass


# events a map task holds before it passes them on
HELD_EVENTS = 200_000


def _thinned(rows: pa.Table) -> pa.Table:
    """The first event of each game and second of the clock, and all final events."""
    keys = rows.select(["GAME_ID", "TIME_REMAINING", "isFinal"]).to_pandas()
    order = pc.sort_indices(rows.column("ACTION_NUMBER"), null_placement="at_end").to_numpy()
    later = keys.iloc[order].duplicated(["GAME_ID", "TIME_REMAINING"]).to_numpy()
    keep = np.empty(len(order), bool)
    keep[order] = ~later
    return rows.filter(pa.array(keep | keys["isFinal"].to_numpy(bool)))


def first_per_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A map-side combine: of an input partition, one event of a game and second of the clock leaves the task, besides final ones.

    After an event at t seconds no later event at t is ever due, so the rest changes nothing. A game has 2,880 such seconds.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = _thinned(table if held is None else pa.concat_tables([held, table]))
        if held.num_rows >= HELD_EVENTS:  # many games: pass them on, later ones are reduced again downstream
            yield from held.to_batches()
            held = None
    if held is not None:
        yield from held.combine_chunks().to_batches()


def thinned_events(events: DataFrame) -> DataFrame:
    """Timed events, combined in each input partition before any shuffle."""
    rows = events.select(*timed_columns(), F.coalesce("isFinal", F.lit(False)).alias("isFinal"))
    return rows.mapInArrow(first_per_second, rows.schema)


def stream_game_snapshots(events: DataFrame, interval: int = 60) -> DataFrame:
    """Streaming play-by-play (with ``isFinal`` on a game's last event) to snapshots.

    A game's snapshots come out together when its marker comes, all labelled with the winner.
    """
    return thinned_events(events).groupBy("GAME_ID").transformWithStateInPandas(
        GreedySnapshots(interval), OUTPUT, outputMode="Append", timeMode="None"
    )
