import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import chunking


def walk(text, size, overlap):
    """(number, stripped window) of a plain left-to-right walk."""
    start, number = 0, 0
    while start < len(text):
        end = min(start + size, len(text))
        yield number, text[start:end].strip()
        if end >= len(text):
            return
        start, number = end - overlap, number + 1


def texts():
    rng = random.Random(3)
    alphabet = "ab \n\u00e9\u00a0\U0001f600"
    out = ["x" * n for n in (1, 9, 10, 11, 18, 19, 20, 28, 29)] + ["   " * 12 + "tail", "a" + " " * 40 + "b"]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    return out + ["word " * 900]


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4), (1, 0), (64, 13)])
def test_windows_equal_a_plain_walk(spark, size, overlap):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id int, text string")
    gapped, dense = {}, {}
    for r in chunking.chunk(df, size, overlap).collect():
        gapped.setdefault(r["id"], []).append((r["position"], r["chunk_number"], r["chunk_text"]))
    for r in chunking.chunk(df, size, overlap, "dense").collect():
        dense.setdefault(r["id"], []).append((r["chunk_number"], r["chunk_text"]))
    for i, text in rows:
        kept = [(n, w) for n, w in walk(text, size, overlap) if w]
        assert sorted(gapped.get(i, [])) == [(p, n, w) for p, (n, w) in enumerate(kept)]
        kept = [w for _, w in walk(text.strip(), size, overlap) if w]
        assert sorted(dense.get(i, [])) == list(enumerate(kept, 1))


def test_ids(spark):
    df = spark.createDataFrame([("d/a.b.md", "dom", 2, "x" * 25, "ff")],
                               "source string, domain string, page int, text string, document_sha256 string")
    simple = [r["chunk_id"] for r in chunking.simple_chunks(df, 10, 0).orderBy("chunk_id").collect()]
    assert simple == ["d_a.b_chunk_000", "d_a.b_chunk_001", "d_a.b_chunk_002"]
    content = [r["chunk_id"] for r in chunking.content_chunks(df, 20, 0).orderBy("chunk_id").collect()]
    assert content == ["sha256:ff::d/a.b.md::p2::c1", "sha256:ff::d/a.b.md::p2::c2"]


def test_sql_function_equals_the_dataframe(spark, data):
    chunking.register_chunk_function(spark)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    by_sql = spark.sql("SELECT d.doc_id, c.chunk_number, c.chunk_text FROM {d} d, "
                       "LATERAL chunk_text(d.text, 200, 20) c", d=docs)
    by_df = chunking.chunk(docs, 200, 20).select("doc_id", "chunk_number", "chunk_text")
    assert by_sql.exceptAll(by_df).isEmpty() and by_df.exceptAll(by_sql).isEmpty()


@pytest.mark.parametrize("size,overlap", [(0, 0), (5, -1), (5, 5)])
def test_bad_window(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_window(size, overlap)


def test_chunking_does_not_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    plan = chunking.chunk(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert chunking.duplicate_ids(docs.select(F.lit("a").alias("chunk_id"))).first()["copies"] > 1


def test_chunk_function_in_sql_moves_no_text(spark):
    chunking.register_chunk_function(spark)
    docs = spark.createDataFrame([(1, "ab " * 9000), (2, None), (3, " "), (4, "ab " * 9000)], "id int, text string")
    out = spark.sql("SELECT d.id, c.chunk_number, c.chunk_text FROM {docs} d, LATERAL chunk_text(d.text, 100, 10) c", docs=docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = chunking.chunk(docs, 100, 10).select("id", "chunk_number", "chunk_text").collect()
    assert len(want) == 600 and sorted(out.collect()) == sorted(want)
