import random

import pytest
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.operators import jobs, workers
from evigraph.session import scratch_path
from evigraph.plans import ingestion as stream_ingest
from evigraph.streaming import jobs as streams

EVENT = "job_id string, state string, ts timestamp, seq long"


def arrivals(spark, rows, schema, batches):
    """Rows cut into files that a stream reads one by one."""
    path = scratch_path(spark, "arrivals")
    size = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * size:(i + 1) * size], schema)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), path


def events(n=60):
    import datetime as dt
    start = dt.datetime(2024, 1, 1)
    states = ["QUEUED", "RUNNING", "VALIDATING", "QUEUED", "FAILED", "RUNNING", "COMPLETED"]
    return [(f"j{i * i % 4}", states[(i * 5) % 7], start + dt.timedelta(minutes=i * (1 + i % 3)), i)
            for i in range(n)]


def mixed(rows, seed=1):
    out = list(rows)
    random.Random(seed).shuffle(out)
    return out


@pytest.mark.parametrize("batches", [1, 4])
def test_states_do_not_depend_on_arrival(spark, batches):
    stream, path = arrivals(spark, mixed(events()), EVENT, batches)
    job = streams.stream_states(stream, scratch_path(spark, "s"), bound="10 days")
    want = jobs.replay_states(spark.read.schema(EVENT).parquet(path), ["ts", "seq"])
    assert job.state().exceptAll(want).isEmpty() and job.state().count() == want.count()
    assert job.late().isEmpty()


@pytest.mark.parametrize("bound", ["10 minutes", "10 days"])
def test_sorted_arrivals_need_no_bound(spark, bound):
    stream, path = arrivals(spark, sorted(events(), key=lambda r: (r[2], r[3])), EVENT, 5)
    job = streams.stream_states(stream, scratch_path(spark, "s"), bound=bound)
    want = jobs.replay_states(spark.read.schema(EVENT).parquet(path), ["ts", "seq"])
    assert job.state().exceptAll(want).isEmpty() and job.late().isEmpty()


def test_late_rows_go_to_the_side_and_are_counted(spark):
    rows = sorted(events(), key=lambda r: (r[2], r[3]))
    early, rest = rows[:6], rows[6:]
    stream, _ = arrivals(spark, rest[-20:] + rest[:-20] + early, EVENT, 3)
    job = streams.stream_states(stream, scratch_path(spark, "s"), bound="1 minute")
    late = job.late().count()
    assert late > 0
    done = job.state().selectExpr("sum(accepted + rejected)").first()[0]
    assert done + late == len(rows)


@pytest.mark.parametrize("batches", [1, 4])
def test_streaks_do_not_depend_on_arrival(spark, batches):
    rows = [(f"w{i % 3}", "healthy" if i % 7 == 0 else "timeout", r[2], i)
            for i, r in enumerate(sorted(events(), key=lambda r: (r[2], r[3])))]
    schema = "worker_id string, health string, ts timestamp, seq long"
    stream, path = arrivals(spark, mixed(rows), schema, batches)
    got = streams.stream_streaks(stream, scratch_path(spark, "s"), "10 days").state()
    batch = workers.failure_streaks(spark.read.schema(schema).parquet(path), ["ts", "seq"])
    want = batch.groupBy("worker_id").agg(F.max_by("consecutive_failures", "seq").alias("n"))
    assert {r["worker_id"]: r["consecutive_failures"] for r in got.collect()} == {
        r["worker_id"]: r["n"] for r in want.collect()}


def test_stale_periods_do_not_depend_on_arrival(spark):
    rows = sorted(events(), key=lambda r: (r[2], r[3]))
    seen = []
    for arrived, batches, bound in ((rows, 1, "10 minutes"), (rows, 4, "10 minutes"), (mixed(rows), 4, "10 days")):
        stream, _ = arrivals(spark, arrived, EVENT, batches)
        out = streams.stream_stale(stream, scratch_path(spark, "s"), 600, bound)
        seen.append(sorted((r["job_id"], r["previous_state"], r["last_event"]) for r in out.collect()))
    now = rows[-1][2]
    want = []
    for job in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == job]
        for a, b in zip(mine, mine[1:] + [(job, None, now, 0)]):
            if a[1] in jobs.IN_FLIGHT and (b[2] - a[2]).total_seconds() >= 600:
                want.append((job, a[1], a[2]))
    assert seen[0] == seen[1] == seen[2] == sorted(want)


def test_ingestion_is_replay_safe(spark):
    schema = "source string, domain string, text string"
    rows = [("a.txt", "d", "x" * 2500), ("b.txt", "d", "short"), ("a.txt", "d", "x" * 2500)]
    stream, path = arrivals(spark, rows, schema, 3)
    target = scratch_path(spark, "chunks")
    stream_ingest.ingest_stream(stream, target, scratch_path(spark, "c1")).awaitTermination()
    first = spark.read.parquet(target).count()
    assert first == 4
    again = spark.readStream.schema(schema).parquet(path)
    stream_ingest.ingest_stream(again, target, scratch_path(spark, "c2")).awaitTermination()
    assert spark.read.parquet(target).count() == first


def test_ingestion_in_several_batches(spark):
    """Later batches meet stored chunks of other documents, and of the same text from another source."""
    schema = "source string, domain string, text string"
    rows = [(f"{s}.txt", "d", f"{t} " * 900) for t in range(40) for s in ("a", "b")]
    path, target = scratch_path(spark, "batches"), scratch_path(spark, "chunks")
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
    stream_ingest.ingest_stream(stream, target, scratch_path(spark, "c3")).awaitTermination()
    got = {(r["source"], r["document_sha256"]) for r in spark.read.parquet(target).collect()}
    assert len(got) == len(rows)


def test_a_batch_writes_one_file_a_folder_and_is_planned_adaptively(spark, monkeypatch):
    seen, ingest_documents, adaptive = [], stream_ingest.ingest_documents, "spark.sql.adaptive.enabled"
    monkeypatch.setattr(stream_ingest, "ingest_documents", lambda batch, *x: seen.append(
        batch.sparkSession.conf.get(adaptive)) or ingest_documents(batch, *x))
    rows = [(f"{k}.txt", "d", "".join(chr(97 + (k + n * n) % 23) for n in range(30_000))) for k in range(3)]
    stream, _ = arrivals(spark, rows, "source string, domain string, text string", 1)
    target = scratch_path(spark, "chunks")
    stream_ingest.ingest_stream(stream, target, scratch_path(spark, "c4")).awaitTermination()
    stored = spark.read.parquet(target)
    assert stored.count() == 90 and stored.select("chunk_id").distinct().count() == 90
    assert stored.select(F.input_file_name()).distinct().count() == stored.select("prefix").distinct().count()
    assert seen and set(seen) == {spark.conf.get(adaptive)}


def test_vocabulary_of_states():
    assert {a for pair in vocab.TRANSITIONS for a in pair} <= set(vocab.JOB_STATES)
