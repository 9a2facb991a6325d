"""Both physical plans of ordered features against pandas, with a hot group."""

import random

import pandas as pd
import pytest

from tests.conftest import same, to_pandas
from tipoff.operators.ordered import Before, GapDays, TrailingMean, measured, ordinal, with_history

SPECS = [
    TrailingMean("t3", "x", 3), TrailingMean("t7", "x", 7), Before("s", "n", "sum"), Before("c", "x", "count"),
    Before("m", "n", "max"), Before("avg", "n", "mean"), GapDays("gap", "d"),
]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None])
        day = pd.Timestamp("2024-01-01") + pd.Timedelta(days=rng.randint(0, 40))
        data.append((key, day.date(), f"{i:05d}", None if rng.random() < 0.2 else rng.randint(0, 9) / 2, rng.randint(-5, 5)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, d date, id string, x double, n int")


def expected(rows):
    pdf = rows.toPandas().sort_values(["d", "id"])
    g = pdf.groupby("k", dropna=False, sort=False)
    pdf["t3"] = g["x"].transform(lambda s: s.shift(1).rolling(3, min_periods=1).mean())
    pdf["t7"] = g["x"].transform(lambda s: s.shift(1).rolling(7, min_periods=1).mean())
    pdf["s"] = g["n"].transform(lambda s: s.shift(1).expanding().sum())
    pdf["c"] = g["x"].transform(lambda s: s.notna().cumsum() - s.notna())
    pdf["m"] = g["n"].transform(lambda s: s.shift(1).expanding().max())
    pdf["avg"] = g["n"].transform(lambda s: s.shift(1).expanding().mean())
    pdf["gap"] = g["d"].transform(lambda s: pd.to_datetime(s).diff().dt.days - 1)
    return pdf.sort_values("id").reset_index(drop=True)


@pytest.mark.parametrize("options", [{"strategy": "window"}, {"strategy": "chunked", "chunk_rows": 40},
                                     {"strategy": "chunked", "chunk_rows": 4}, {"max_group_rows": 50, "chunk_rows": 100}])
def test_matches_pandas(rows, options):
    got = to_pandas(with_history(rows, ["k"], ["d", "id"], SPECS, **options), "id")
    want = expected(rows)
    same(want, got)


def test_global_group(rows):
    window = to_pandas(with_history(rows, [], ["d", "id"], SPECS, strategy="window"), "id")
    chunked = to_pandas(with_history(rows, [], ["d", "id"], SPECS, strategy="chunked", chunk_rows=50), "id")
    same(window, chunked)


@pytest.mark.parametrize("strategy", ["window", "chunked"])
def test_ordinal(rows, strategy):
    got = to_pandas(ordinal(rows, ["k"], ["d", "id"], "rank", strategy=strategy, chunk_rows=30), "k", "rank")
    for _, group in got.groupby("k", dropna=False):
        assert group["rank"].tolist() == list(range(1, len(group) + 1))
        assert group[["d", "id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_measured(rows):
    """Only large groups are named, in the pass that writes the rows; what follows reads the written rows."""
    staged, hot = measured(rows, ["k"], 50)
    sizes = {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    large = {k for k, n in sizes.items() if n > 50}
    others, named = hot.split(staged)
    assert "hot" in large and {r["k"] for r in named.select("k").distinct().collect()} == large
    assert hot.rows == sum(sizes[k] for k in large) and others.count() == 600 - hot.rows
    assert measured(rows, ["k"], 600)[1].rows == 0
    assert measured(rows.where("false"), ["k"], 0)[1].rows == 0
    assert measured(rows, [], 599)[1].rows == 600 and measured(rows, [], 600)[1].rows == 0


def test_upstream_runs_once(rows, spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    watched = rows.mapInArrow(count, rows.schema)
    for limit in (50, 10_000):
        before = seen.value
        with_history(watched, ["k"], ["d", "id"], SPECS, max_group_rows=limit, chunk_rows=100).collect()
        assert seen.value - before == 600


def test_unknown_strategy(rows):
    with pytest.raises(ValueError):
        with_history(rows, ["k"], ["id"], SPECS, strategy="other")
