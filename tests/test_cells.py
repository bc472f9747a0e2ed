"""The stored partition index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import cells, knn
from evigraph.plans.catalog import retrieval

V = "id long, embedding array<float>"


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], V)


def as_queries(vectors):
    return vectors.withColumnRenamed("id", "query_id")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["distance"], 9)) for r in df.collect())


@pytest.mark.parametrize("metric", knn.METRICS)
def test_probing_all_cells_is_exact(spark, metric):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((300, 8)), np.repeat(rng.standard_normal((1, 8)), 150, axis=0)])
    every = table(spark, x)
    asked = as_queries(every.where("id % 7 = 0"))
    index = cells.build(every, cells=10, sample=200)
    want = rows(knn.knn(asked, every, k=4, metric=metric))
    assert rows(cells.search(asked, index, every, k=4, probes=10, metric=metric)) == want
    assert rows(cells.search(asked, index, every, k=4, probes=10, metric=metric, max_query_bytes=2000)) == want


def test_clustered_vectors_need_few_probes_and_folders(spark):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((16, 12)) * 8
    x = (middle[:, None, :] + rng.standard_normal((16, 60, 12)) * 0.3).reshape(-1, 12)
    every = table(spark, x)
    index = cells.build(every, cells=16, rounds=8)
    asked = as_queries(every.where("id < 60"))             # all of one cluster
    found = cells.search(asked, index, every, k=5, probes=2)
    want = {r[:3] for r in rows(knn.knn(asked, every, k=5))}
    got = {r[:3] for r in rows(found)}
    assert len(got & want) >= 0.95 * len(want)
    read = spark.read.parquet(index.path)
    near = cells.nearest_centres(x[:60], index.centres, 2)
    assert read.where(F.col("cell").isin(*np.unique(near).tolist())).count() < len(x) / 3


def test_appended_vectors_are_found(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 6))
    first, later = table(spark, x[:150]), table(spark, x[150:], first=150)
    index = cells.build(first, cells=8)
    cells.append(index, later)
    every = first.unionByName(later)
    assert rows(cells.search(as_queries(later), index, every, probes=8)) == rows(knn.knn(as_queries(later), every))


def test_nulls_and_empty_tables(spark):
    every = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0, 0.0])], V)
    index = cells.build(every)
    assert len(index.centres) == 3
    found = rows(cells.search(as_queries(every), index, every, k=2))
    assert [(q, i) for q, _, i, _ in found] == [(1, 1), (1, 4), (3, 3), (3, 1), (4, 1), (4, 4)]
    none = every.limit(0)
    assert cells.search(as_queries(every), cells.build(none), none).count() == 0
    assert cells.search(as_queries(none), index, every).count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_recall_on_the_given_tables(spark, sf):
    root = f"/root/testdata/sf{sf}"
    row = retrieval.nearest_in_cells_recall(spark, root).first()
    print(sf, row)
    assert row["found"] >= 0.9 * row["wanted"]


def test_pairs_compared_on_the_given_tables(spark):
    asked, every = retrieval._asked(spark, "/root/testdata/sf0.1")
    x = np.stack([np.array(r["embedding"], dtype=float) for r in every.collect()])
    q = np.stack([np.array(r["embedding"], dtype=float) for r in asked.collect()])
    centres = cells.fit_centres(every)
    size = np.bincount(cells.nearest_centres(x, centres)[:, 0], minlength=len(centres))
    compared = size[cells.nearest_centres(q, centres, cells.PROBES)].sum()
    print("share of n * n", compared / len(x) ** 2, "share of queries * n", compared / len(x) / len(q))
    assert compared < 0.2 * len(x) ** 2 and compared < 0.65 * len(x) * len(q)
