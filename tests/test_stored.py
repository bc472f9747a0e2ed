"""Stored tables updated in place, and tables bucketed by key."""

import os
from pathlib import Path

from pyspark.sql import functions as F

from evigraph.session import scratch_path
from evigraph.sources import buckets, stored, tables

SCHEMA = "id long, text string, seq long"


def table(spark, parts=8):
    like = spark.createDataFrame([], SCHEMA)
    return stored.KeyedTable(spark, scratch_path(spark, "t"), like.schema, ("id",), parts)


def rows(t):
    return sorted(((r["id"], r["text"]) for r in t.read().collect()), key=str)


def files(t):
    return {str(p): os.stat(p).st_mtime_ns for p in Path(t.path.removeprefix("file:")).rglob("part-*.parquet")}


def test_upsert_replaces_adds_and_keeps_other_folders(spark):
    t = table(spark)
    t.upsert(spark.range(200).selectExpr("id", "concat('a', id) AS text", "id AS seq"), "seq")
    before = files(t)
    new = spark.createDataFrame([(3, "old", 1), (3, "new", 2), (1000, "more", 1)], SCHEMA)
    written = t.upsert(new, "seq")
    assert 1 <= written <= 2
    after = files(t)
    kept = {p for p in before if after.get(p) == before[p]}
    assert len({Path(p).parent for p in before} - {Path(p).parent for p in kept}) <= 2
    assert rows(t) == sorted([(i, f"a{i}") for i in range(200) if i != 3] + [(3, "new"), (1000, "more")], key=str)
    t.upsert(new, "seq")                                    # repeating it changes nothing
    assert len(rows(t)) == 201


def test_upsert_of_null_keys_nothing_and_reset(spark):
    t = table(spark, 3)
    assert t.upsert(spark.createDataFrame([], SCHEMA), "seq") == 0 and rows(t) == []
    t.upsert(spark.createDataFrame([(None, "x", 1), (5, None, 1)], SCHEMA), "seq")
    t.upsert(spark.createDataFrame([(None, "y", 1)], SCHEMA), "seq")
    assert rows(t) == sorted([(None, "y"), (5, None)], key=str)
    t.reset()
    assert rows(t) == []
    t.upsert(spark.createDataFrame([(1, "z", 1)], SCHEMA), "seq")
    assert rows(t) == [(1, "z")]


def test_joins_on_a_bucketed_table_move_the_other_side_only(spark):
    stored_rows = buckets.bucketed(spark.range(1000).withColumn("x", F.col("id") * 2), ["id"])
    other = spark.range(0, 2000, 3).withColumn("y", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored_rows.join(other, "id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        assert joined.count() == 334
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


def test_documents_hold_a_bounded_share(spark):
    items = spark.range(5000).selectExpr("id", "to_json(struct(id)) AS record")
    path = scratch_path(spark, "docs")
    documents = tables.json_arrays(items, "id", "record", 5000)
    assert documents.count() == 5
    tables.write_documents(documents, path)
    got = tables.read_manifest(spark, path, "id long")
    assert got.count() == 5000 and len(got.inputFiles()) == 5
