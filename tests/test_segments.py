import random
import statistics

import pytest
from pyspark.sql import functions as F

from evigraph.operators import segments


def log(n=600, seed=5):
    """A log in which one key owns most rows and many rows share a time."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 8)}"
        rows.append((key, i // 3, i, rng.choice("abc"), rng.choice([1.0, 2.0, 2.5, rng.random()])))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    rows = log()
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "key string, ts long, seq long, v string, x double").cache()


def by_key():
    out = {}
    for r in sorted(log(), key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_previous_number_and_streak(frame, parts):
    order = ["ts", "seq"]
    got = segments.previous_value(frame, ["key"], order, "v", "p", parts)
    got = segments.numbered(got, ["key"], order, "n", parts)
    got = segments.running_streak(got, ["key"], order, F.col("v") == "a", "s", parts)
    got = {r["seq"]: (r["p"], r["n"], r["s"]) for r in got.collect()}
    assert len(got) == 600
    for rows in by_key().values():
        streak = 0
        for n, r in enumerate(rows, 1):
            streak = 0 if r[3] == "a" else streak + 1
            before = rows[n - 2][3] if n > 1 else None
            assert got[r[2]] == (before, n, streak)


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_median_is_exact(frame, parts):
    got = {r["key"]: r["m"] for r in segments.exact_median(frame, ["key"], "x", "m", parts).collect()}
    for key, rows in by_key().items():
        assert got[key] == pytest.approx(statistics.median(r[4] for r in rows), abs=1e-12)


def test_slices_bound_the_rows_of_a_hot_key(frame):
    sizes = segments.with_slices(frame, "ts", 10).groupBy("key", segments.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 600 / 10 * 1.5


@pytest.mark.parametrize("parts", [1, 5])
def test_nulls_and_ties_lose_no_row(spark, parts):
    """Null keys and order values, one value of the first order column for most rows."""
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 5, 5, 5, 5, 5, 9]), i,
             rng.choice(["x", "y", None])) for i in range(300)]
    frame = spark.createDataFrame(rows, "key string, ts long, seq long, v string")
    got = segments.previous_value(frame, ["key"], ["ts", "seq"], "v", "p", parts)
    got = segments.numbered(got, ["key"], ["ts", "seq"], "n", parts)
    got = segments.running_streak(got, ["key"], ["ts", "seq"], F.col("v") == "x", "s", parts)
    got = {r["seq"]: (r["p"], r["n"], r["s"]) for r in got.collect()}
    keys = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        keys.setdefault(r[0], []).append(r)
    assert len(got) == 300
    for mine in keys.values():
        streak = 0
        for n, r in enumerate(mine, 1):
            streak = 0 if r[3] == "x" else streak + 1
            assert got[r[2]] == (mine[n - 2][3] if n > 1 else None, n, streak)


def test_dates_and_texts_order(spark):
    frame = spark.sql("SELECT 'k' key, date'2024-01-01' + CAST(id AS int) d, CAST(id AS string) t, id FROM range(9)")
    for column in ("d", "t"):
        got = segments.numbered(frame, ["key"], [column], "n", 4).collect()
        assert all(r["n"] == r["id"] + 1 for r in got)


@pytest.mark.parametrize("parts", [1, 4])
def test_median_of_a_null_group(spark, parts):
    rows = [(None, float(i)) for i in range(7)] + [("g", 1.0), ("g", 2.0), ("g", None)]
    frame = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["m"] for r in segments.exact_median(frame, ["g"], "x", "m", parts).collect()}
    assert got == {None: 3.0, "g": 1.5}


def test_one_time_is_cut_by_the_second_column(spark):
    frame = spark.sql("SELECT 'hot' key, 7L ts, id seq FROM range(1000)")
    sizes = segments.with_slices(frame, ["ts", "seq"], 10).groupBy(segments.SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] <= 300
