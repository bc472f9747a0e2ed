import inspect
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigraph.operators import knn
from evigraph.operators.embed import answer, embed
from evigraph.plans.catalog import retrieval


def tables(spark, seed=1, n=400, q=30, copies=150):
    """Vectors with a large group of exact copies, so that ties are the rule."""
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, 8)).astype(np.float32)
    v[:copies] = v[0]
    w = rng.standard_normal((q, 8)).astype(np.float32)
    w[0] = v[0]
    vectors = spark.createDataFrame([(f"v{i:03d}", r.tolist()) for i, r in enumerate(v)],
                                    "id string, embedding array<float>")
    queries = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(w)],
                                    "query_id long, embedding array<float>")
    return queries, vectors, w.astype(float), v.astype(float)


def brute(w, v, k, metric):
    out = {}
    for i, q in enumerate(w):
        if metric == "l2_squared":
            d = ((v - q) ** 2).sum(axis=1)
        else:
            d = 1 - v @ q / (np.linalg.norm(v, axis=1) * np.linalg.norm(q))
        order = sorted(range(len(v)), key=lambda j: (round(d[j], 9), j))[:k]
        out[i] = [f"v{j:03d}" for j in order]
    return out


def ids(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    return got


@pytest.mark.parametrize("metric", knn.METRICS)
@pytest.mark.parametrize("options", [{}, {"max_query_bytes": 900}])
def test_exact_search_equals_brute_force(spark, metric, options):
    queries, vectors, w, v = tables(spark)
    got = ids(knn.knn(queries, vectors.repartition(5), 7, metric, **options))
    assert got == brute(w, v, 7, metric)


def test_equal_vectors_are_not_gathered():
    """Ten thousand copies at the k-th distance cost k candidates a query, not all of them."""
    rng = np.random.default_rng(3)
    vectors = np.repeat(rng.standard_normal((1, 16)), 10_000, axis=0)
    names = np.array([f"v{i:05d}" for i in range(10_000)])[::-1].copy()
    tracemalloc.start()
    q, found, dist = knn._block_best(rng.standard_normal((100, 16)), vectors, names, 5, "l2_squared")
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert len(q) == 500 and set(found) == {f"v{i:05d}" for i in range(5)}


def test_fewer_vectors_than_k_and_no_match(spark):
    queries, vectors, *_ = tables(spark)
    few = vectors.where("id < 'v003'")
    assert all(len(x) == 3 for x in ids(knn.knn(queries, few, 10)).values())
    assert knn.knn(queries, vectors.where("false"), 3).isEmpty()


def test_hashed_search_finds_most_and_invents_nothing(spark):
    queries, vectors, w, v = tables(spark, copies=1)
    exact = brute(w, v, 5, "l2_squared")
    found = ids(knn.knn(queries, vectors, 5, approx=True, tables=12, bits=2, block_rows=50))
    shared = sum(len(set(found.get(i, [])) & set(x)) for i, x in exact.items())
    assert shared >= 0.8 * sum(len(x) for x in exact.values())
    one_bucket = knn.knn(queries, vectors, 5, approx=True, tables=40, bits=1, block_rows=60)
    assert ids(one_bucket) == exact


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_hashes_reach_the_recall_floor(spark, sf):
    """With the parameters of ``nearest_hashed``, also without the self match."""
    table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    names, v = table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)
    found = {}
    for r in retrieval.nearest_hashed(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    hits = others = wanted = 0
    for name, q in zip(names, v):
        near = set(names[np.lexsort((names, ((v - q) ** 2).sum(axis=1)))[:5]])
        hits += len(near & found[name])
        others += len(near & found[name] - {name})
        wanted += len(near)
    assert hits >= 0.9 * wanted
    assert others >= 0.9 * (wanted - len(names))
    assert inspect.signature(knn.knn).parameters["tables"].default == retrieval.TABLES
    assert inspect.signature(knn.knn).parameters["bits"].default == retrieval.BITS


def test_filters(spark):
    df = spark.createDataFrame([(1, "chem", "rdkit"), (2, "chem", "vina"), (3, "Chem", "rdkit")],
                               "id int, domain string, tool string")
    def kept(**f):
        return sorted(r["id"] for r in knn.metadata_filter(df, **f).collect())
    assert kept() == [1, 2, 3]
    assert kept(domain=" chem ", tool=None) == [1, 2]
    assert kept(domain="chem", tool="vina") == [2]
    for error, fields in ((ValueError, {"domain": " "}), (TypeError, {"domain": 3}),
                          (ValueError, {"colour": "x"})):
        with pytest.raises(error):
            knn.metadata_filter(df, **fields)


def test_filter_reaches_the_scan(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plan = knn.metadata_filter(docs.select("doc_id", "source"), source="src1")
    assert "EqualTo(source,src1)" in plan._jdf.queryExecution().executedPlan().toString()


def test_threshold_keeps_equal_and_unknown(spark):
    df = spark.createDataFrame([(1, 0.25), (2, 0.85), (3, 0.95), (4, None)], "id int, distance double")
    assert sorted(r["id"] for r in knn.threshold(df).collect()) == [1, 2, 4]


def test_bad_arguments(spark):
    queries, vectors, *_ = tables(spark, n=3, q=1, copies=1)
    for bad in ({"k": 0}, {"metric": "dot"}):
        with pytest.raises(ValueError):
            knn.knn(queries, vectors, **bad)


def test_embedding_hooks(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, " "), (3, "beta")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed(df, dim=32).collect()}
    assert sorted(got) == [1, 3] and abs(sum(x * x for x in got[1]) - 1) < 1e-6
    own = embed(df, model=lambda texts: [[float(len(t))] for t in texts]).collect()
    assert sorted((r["id"], r["embedding"][0]) for r in own) == [(1, 10.0), (3, 4.0)]
    asked = spark.createDataFrame([("q", "ctx")], "question string, context string")
    assert answer(asked, lambda q, c: q + c).first()["answer"] == "qctx"


def test_embedded_search_equals_brute_force(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    rows = [(f"v{i:02d}", " ".join(words[j] for j in range(6) if i >> j & 1)) for i in range(1, 40)]
    vectors = embed(spark.createDataFrame(rows, "id string, text string"), dim=64)
    asked = embed(spark.createDataFrame([(1, "alpha gamma"), (2, "zeta beta eps")],
                                        "query_id long, text string"), dim=64)
    v = {r["id"]: np.array(r["embedding"]) for r in vectors.collect()}
    for r in asked.collect():
        order = sorted((round(float(((x - np.array(r["embedding"])) ** 2).sum()), 9), i)
                       for i, x in v.items())[:4]
        hits = knn.knn(asked.where(F.col("query_id") == r["query_id"]), vectors, 4)
        assert [h["id"] for h in hits.orderBy("rank").collect()] == [i for _, i in order]


def test_hashed_search_compares_no_pair_for_each_table(spark, monkeypatch):
    """Where most pairs share several buckets, rows are not repeated for their tables."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((260, 8)).astype(np.float32)
    base[200:] = base[:60]                              # copies: ties go by id
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(base)], "id long, embedding array<float>")
    asked = rows.withColumnRenamed("id", "query_id")
    for tables, bits, metric, k in ((20, 4, "l2_squared", 5), (2, 3, "cosine", 4), (40, 1, "l2_squared", 300)):
        codes = (base.astype(np.float64) @ knn.hash_planes(tables, bits, 8).T >= 0).reshape(len(base), tables, bits)
        code = (codes * (1 << np.arange(bits))).sum(axis=2)
        share = (code[:, None] == code[None]).any(axis=2)
        a = base.astype(np.float64)
        far = ((a[:, None] - a[None]) ** 2).sum(axis=2) if metric == "l2_squared" else \
            1 - (a @ a.T) / np.sqrt((a * a).sum(axis=1)[:, None] * (a * a).sum(axis=1)[None])
        want = {(q, int(i)) for q in range(len(a))
                for i in sorted(np.flatnonzero(share[q]), key=lambda i: (round(far[q, i], 9), i))[:k]}
        with monkeypatch.context() as m:
            m.setattr(knn, "_BLOCK_BYTES", 4 * 8 * 70)  # several blocks of 70 vectors
            if tables > 2:                              # no cells by bucket are made
                m.setattr(knn, "_pair_up", None)
            got = knn.knn(asked, rows, k, metric, approx=True, tables=tables, bits=bits, block_rows=50).collect()
        assert {(r["query_id"], r["id"]) for r in got} == want and len(got) == len(want)


def test_large_query_batches_stay_off_the_driver(spark, monkeypatch):
    queries, vectors, w, v = tables(spark)
    monkeypatch.setattr(knn, "_broadcast_scan", None)
    monkeypatch.setattr(knn, "_BLOCK_BYTES", 8 * 4 * 50)
    monkeypatch.setattr(knn, "_STEP", 16)
    for metric in knn.METRICS:
        assert ids(knn.knn(queries, vectors, 7, metric, max_query_bytes=900)) == brute(w, v, 7, metric)


def test_single_precision_cut_loses_no_neighbour():
    """Vectors far from the origin and close together, where rough distances are of little use."""
    rng = np.random.default_rng(5)
    for shift in (0.0, 1e3, 1e16, 1e-12):
        v = rng.standard_normal((500, 16)) * (1e-12 if shift == 1e-12 else 1.0) + (shift if shift > 1 else 0.0)
        w = v[:20] + rng.standard_normal((20, 16)) * 1e-3
        q, found, dist = knn._block_best(w, v, np.arange(500), 5, "l2_squared")
        for i in range(20):
            d = ((w[i] - v) ** 2).sum(axis=1)
            assert found[q == i].tolist() == np.lexsort((np.arange(500), d))[:5].tolist()


def test_a_model_gets_few_texts_at_a_time(spark):
    df = spark.range(1500).selectExpr("id", "concat('t', id) AS text").coalesce(1)
    out = embed(df, model=lambda texts: [[float(len(texts))] for _ in texts])
    assert max(r["embedding"][0] for r in out.collect()) <= 256
