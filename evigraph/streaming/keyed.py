"""Streaming jobs with keyed state, event-time timers and windows that close.

State lives in the state store under the stream's checkpoint, RocksDB with changelogs, so a
micro-batch reads and writes the keys it touches and nothing else, and a restarted query goes on
where it stopped. Rows wait in the state of their key until the watermark, the newest event time
less ``bound``, has passed them, and are applied in event order. Timers wake a key when a waiting
row is due or a job has been silent for long enough, also if no row of it ever comes again.

Rows behind the watermark take no part. They are counted by the query (``late_rows``).

Every micro-batch writes the changed rows to a folder of its own, which a replay overwrites.
Reading takes the last row of each key. Rows without a time take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs as batch_jobs
from .jobs import BOUND, _stored

_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Drained:
    """A stream run over the data that is there now; running it again on the same path goes on."""

    def __init__(self, changes: DataFrame, path: str, mode: str):
        self.path, self.like, spark = path, changes, changes.sparkSession
        before = {name: spark.conf.get(name, None) for name in _STORE}
        for name, value in _STORE.items():
            spark.conf.set(name, value)

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

        try:
            query = (changes.writeStream.outputMode(mode).foreachBatch(write)
                     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)
        query.awaitTermination()
        #: One entry a micro-batch: keys whose state was written, keys in the store, rows that came too late.
        self.batches = [{"updated": s.numRowsUpdated, "kept": s.numRowsTotal, "late": s.numRowsDroppedByWatermark}
                        for p in query.recentProgress for s in p.stateOperators]
        self.late_rows = sum(b["late"] for b in self.batches)

    def changes(self) -> DataFrame:
        """All rows written, with the micro-batch they are from."""
        return _stored(self.like, f"{self.path}/table")

    def latest(self, key: str) -> DataFrame:
        """The last row of each key."""
        rest = [c for c in self.like.columns if c != key]
        return self.changes().groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("_last")).select(key, "_last.*")


# --- ordered jobs -------------------------------------------------------------------------------

_WAITING = "ts array<bigint>, seq array<bigint>, value array<string>"


def _arrived(frames: Iterator[pd.DataFrame], waiting: tuple) -> list[tuple]:
    """Waiting and new rows of a key in event order."""
    rows = list(zip(*waiting))
    for pdf in frames:
        rows += zip(pdf["ts_us"].tolist(), pdf["seq"].tolist(), [None if pd.isna(v) else v for v in pdf["value"]])
    return sorted(rows, key=lambda r: r[:2])


def _columns(rows: list[tuple]) -> tuple:
    return tuple([r[k] for r in rows] for k in range(3))


def _wake(state, mark: int, times: list[int]) -> None:
    """Set the timer to the first of the times (microseconds) to come."""
    if times:
        state.setTimeoutTimestamp(max(mark // 1000 + 1, min(times) // 1000 + 1))


def _in_order(rows: DataFrame, key: str, value: str, bound: str) -> DataFrame:
    return rows.where("ts IS NOT NULL").select(
        key, "ts", F.unix_micros("ts").alias("ts_us"), F.col("seq").cast("long").alias("seq"),
        F.col(value).alias("value")).withWatermark("ts", bound)


def _fold(rows: DataFrame, path: str, key: str, value: str, bound: str, core: str, start: tuple, apply) -> Drained:
    """Apply the rows of each key in event order; a changed key gives its state with waiting rows applied as well."""
    names = [part.split()[0] for part in core.split(", ")]

    def work(keys, frames, state):
        now, waiting = start, ((), (), ())
        if state.exists:
            held = state.get
            now, waiting = tuple(held[:len(names)]), tuple(held[len(names):])
        mark = state.getCurrentWatermarkMs() * 1000
        queue = _arrived(frames, waiting)
        due = [r for r in queue if r[0] < mark]
        for r in due:
            now = apply(now, r[2])
        queue = queue[len(due):]
        state.update((*now, *_columns(queue)))
        _wake(state, mark, [r[0] for r in queue[:1]])
        if not state.hasTimedOut:
            for r in queue:
                now = apply(now, r[2])
            yield pd.DataFrame({key: [keys[0]], **{n: [v] for n, v in zip(names, now)}})

    kind = rows.schema[key].dataType.simpleString()
    changed = _in_order(rows, key, value, bound).groupBy(key).applyInPandasWithState(
        work, f"{key} {kind}, {core}", f"{core}, {_WAITING}", "update", "EventTimeTimeout")
    return Drained(changed, path, "update")


def stream_states(events: DataFrame, path: str, allowed=None, bound: str = BOUND) -> Drained:
    """Job states of an event stream (job_id, state, ts, seq): ``job_id, state, accepted, rejected``.

    A step that is not allowed is rejected and leaves the state; events without a state are passed over.
    """
    pairs = frozenset(batch_jobs._pairs(allowed))

    def apply(now, value):
        state, accepted, rejected = now
        if value is None:
            return now
        if state is None or state == value or (state, value) in pairs:
            return value, accepted + 1, rejected
        return state, accepted, rejected + 1

    return _fold(events.where("state IS NOT NULL"), path, "job_id", "state", bound,
                 "state string, accepted bigint, rejected bigint", (None, 0, 0), apply)


def stream_streaks(beats: DataFrame, path: str, bound: str = BOUND) -> Drained:
    """Failures since the last healthy heartbeat: ``worker_id, health, consecutive_failures``."""
    def apply(now, value):
        return value, 0 if value == "healthy" else now[1] + 1

    return _fold(beats, path, "worker_id", "health", bound, "health string, consecutive_failures bigint", (None, 0), apply)


def stream_silent(events: DataFrame, path: str, seconds: int = 300, bound: str = BOUND,
                  in_flight: tuple[str, ...] = batch_jobs.IN_FLIGHT) -> Drained:
    """Silent periods of in-flight jobs, reported when the watermark has passed the limit.

    A row names periods by the state and time of the event they follow. Rows with ``reported`` are
    final, each period once: either the next event of the job came that late, or a timer fired
    without one. Of the others the last of a job counts: what the rows that still wait add, and as
    its last period the one that has not ended, if any.
    """
    limit, flying = seconds * 1_000_000, frozenset(in_flight)

    def work(keys, frames, state):
        # the last event applied, and whether its silence is reported
        last, at, told, waiting = None, None, False, ((), (), ())
        if state.exists:
            last, at, told, *waiting = state.get
        mark = state.getCurrentWatermarkMs() * 1000
        queue, told_now, rest = _arrived(frames, tuple(waiting)), [], []

        def quiet(until):
            return last in flying and not told and until - at >= limit

        due = [r for r in queue if r[0] < mark]
        for r in due:
            if quiet(r[0]):
                told_now.append((last, at, True))
            last, at, told = r[2], r[0], False
        queue = queue[len(due):]
        if quiet(mark):                             # what waits is not older than the watermark
            told_now.append((last, at, True))
            told = True
        state.update((last, at, told, *_columns(queue)))
        times = [r[0] for r in queue[:1]]
        if last in flying and not told:
            times.append(at + limit)
        _wake(state, mark, times)
        for r in queue:
            if quiet(r[0]):
                rest.append((last, at, True))
            last, at, told = r[2], r[0], False
        if last in flying and not told:
            rest.append((last, at, False))
        rows = [(True, told_now), (False, rest)] if told_now else [(False, rest)]
        yield pd.DataFrame([(keys[0], reported, *_columns(periods)) for reported, periods in rows],
                           columns=["job_id", "reported", "states", "times", "ended"])

    changed = _in_order(events, "job_id", "state", bound).groupBy("job_id").applyInPandasWithState(
        work, "job_id string, reported boolean, states array<string>, times array<bigint>, ended array<boolean>",
        f"last string, at bigint, told boolean, {_WAITING}", "append", "EventTimeTimeout")
    return Drained(changed, path, "append")


def silent_periods(job: Drained, newest: DataFrame, seconds: int = 300) -> DataFrame:
    """Periods that reached the limit, and those still open at the event time ``newest`` (one row ``now``)."""
    lists = ["states", "times", "ended"]
    rows = job.changes()
    told = rows.where("reported").select("job_id", *lists)
    last = rows.where("NOT reported").groupBy("job_id").agg(F.max_by(F.struct(*lists), "batch_id").alias("l"))
    periods = told.unionByName(last.select("job_id", "l.*")).select("job_id", F.explode(F.arrays_zip(*lists)).alias("p"))
    long = F.unix_micros("now") - F.col("p.times") >= seconds * 1_000_000
    return periods.join(newest).where(F.col("p.ended") | long).select(
        "job_id", F.col("p.states").alias("previous_state"), F.lit("RECOVERY_REQUIRED").alias("state"),
        F.timestamp_micros("p.times").alias("last_event"))


# --- windows that close -------------------------------------------------------------------------------

def closed_counts(stream: DataFrame, path: str, length: str = "1 hour", slide: str | None = None,
                  bound: str = BOUND, ts: str = "ts", event: str = "event") -> Drained:
    """Events per type and window, of windows the watermark has passed; closed windows leave the state."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    counted = stream.withWatermark(ts, bound).groupBy(window.alias("w"), event).agg(F.count("*").alias("events"))
    return Drained(counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), event, "events"),
                   path, "append")


def closed_sessions(stream: DataFrame, path: str, gap: str = "30 minutes", bound: str = BOUND, ts: str = "ts",
                    key: str = "job_id") -> Drained:
    """Bursts of activity per key that the watermark has passed; open ones stay in the state."""
    bursts = stream.withWatermark(ts, bound).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return Drained(bursts.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"),
                   path, "append")
