"""Keyed state, timers and closing windows: restart, late rows, and what a micro-batch writes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from evigraph.operators import jobs
from evigraph.session import scratch_path
from evigraph.streaming import keyed

from test_streams import EVENT, arrivals, events, mixed

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def append(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("batches, arrived, bound", [(1, "mixed", "10 days"), (4, "mixed", "10 days"), (4, "sorted", "10 minutes")])
def test_states_do_not_depend_on_arrival(spark, batches, arrived, bound):
    rows = mixed(events()) if arrived == "mixed" else sorted(events(), key=lambda r: (r[2], r[3]))
    stream, path = arrivals(spark, rows, EVENT, batches)
    job = keyed.stream_states(stream, scratch_path(spark, "k"), bound=bound)
    want = jobs.replay_states(spark.read.schema(EVENT).parquet(path), ["ts", "seq"])
    assert table(job.latest("job_id")) == table(want) and job.late_rows == 0


def test_a_restarted_stream_goes_on_and_writes_touched_keys_only(spark):
    stream, path = arrivals(spark, [(f"j{i}", "QUEUED", at(i % 7), i) for i in range(200)], EVENT, 1)
    target = scratch_path(spark, "k")
    first = keyed.stream_states(stream, target)
    assert max(b["updated"] for b in first.batches) == 200
    seen = first.changes().agg(F.max("batch_id")).first()[0]
    later = [("j3", "RUNNING", at(30), 900), ("j5", "RUNNING", at(31), 901), ("j3", "COMPLETED", at(32), 902)]
    append(spark, path, later)
    again = keyed.stream_states(spark.readStream.schema(EVENT).parquet(path), target)
    new = again.changes().where(F.col("batch_id") > seen)
    assert {r["job_id"] for r in new.collect()} == {"j3", "j5"}        # of 200 keys two are written
    state = {r["job_id"]: tuple(r)[1:] for r in again.latest("job_id").collect()}
    want = {r["job_id"]: tuple(r)[1:] for r in jobs.replay_states(spark.read.schema(EVENT).parquet(path), ["ts", "seq"]).collect()}
    assert state == want and len(state) == 200


def test_rows_behind_the_watermark_are_counted(spark):
    stream, path = arrivals(spark, [("a", "QUEUED", at(0), 1), ("a", "RUNNING", at(60), 2)], EVENT, 1)
    target = scratch_path(spark, "k")
    keyed.stream_states(stream, target, bound="10 minutes")
    append(spark, path, [("a", "FAILED", at(20), 3), ("a", "VALIDATING", at(55), 4), ("b", "QUEUED", at(1), 5)])
    job = keyed.stream_states(spark.readStream.schema(EVENT).parquet(path), target, bound="10 minutes")
    assert job.late_rows == 2
    assert [r["accepted"] + r["rejected"] for r in job.latest("job_id").collect()] == [3]


def test_silence_is_reported_by_the_watermark_alone(spark):
    """Job a goes silent and has no further row; rows of b move event time on."""
    stream, path = arrivals(spark, [("a", "RUNNING", at(0), 1), ("b", "QUEUED", at(1), 2)], EVENT, 1)
    target = scratch_path(spark, "k")
    options = {"seconds": 600, "bound": "1 minute"}
    first = keyed.stream_silent(stream, target, **options)
    assert first.changes().where("reported").count() == 0
    for minute in (5, 30):
        append(spark, path, [("b", "QUEUED", at(minute), 10 + minute)])
        job = keyed.stream_silent(spark.readStream.schema(EVENT).parquet(path), target, **options)
        told = [(r["job_id"], r["states"]) for r in job.changes().where("reported").collect()]
        assert told == ([("a", ["RUNNING"])] if minute == 30 else [])
    append(spark, path, [("a", "COMPLETED", at(40), 99)])      # and it is reported once
    job = keyed.stream_silent(spark.readStream.schema(EVENT).parquet(path), target, **options)
    assert job.changes().where("reported").count() == 1
    newest = spark.createDataFrame([(at(40),)], "now timestamp")
    assert [(r["job_id"], r["last_event"]) for r in keyed.silent_periods(job, newest, 600).collect()] == [("a", at(0))]


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows_close_and_late_rows_do_not_reopen_them(spark, slide):
    rows = [("a", "X", at(10), 1), ("a", "X", at(50), 2), ("a", "Y", at(70), 3), ("a", "X", at(130), 4)]
    stream, path = arrivals(spark, rows, EVENT, 1)
    target = scratch_path(spark, "k")
    run = lambda s: keyed.closed_counts(s, target, "1 hour", slide, "5 minutes", event="state")
    first = run(stream)
    before = table(first.changes().drop("batch_id"))
    assert (at(0), at(60), "X", 2) in before and all(r[1] <= at(125) for r in before)
    append(spark, path, [("a", "X", at(20), 5), ("a", "X", at(140), 6), ("a", "X", at(300), 7)])
    job = run(spark.readStream.schema(EVENT).parquet(path))
    after = table(job.changes().drop("batch_id"))
    assert job.late_rows >= 1 and set(before) < set(after)
    assert (at(120), at(180), "X", 2) in after and (at(300), at(360), "X", 1) not in after
    assert job.batches[-1]["kept"] <= (1 if slide is None else 2)       # closed windows have left the state


def test_sessions_close_at_the_watermark(spark):
    rows = [("a", "X", at(m), m) for m in (0, 10, 20, 100)] + [("b", "X", at(15), 1)]
    stream, path = arrivals(spark, rows, EVENT, 1)
    job = keyed.closed_sessions(stream, scratch_path(spark, "k"), "30 minutes", "5 minutes")
    assert table(job.changes().drop("batch_id")) == [("a", at(0), at(50), 3), ("b", at(15), at(45), 1)]
