"""Structured Streaming jobs over job event logs and worker heartbeats.

Two forms cover all of them. Counts and sessions add up whatever the order of arrival, so every
micro-batch stores its partial result and the result is their sum: no row is ever too late.
Ordered jobs (states, streaks, silent periods) hold rows back until event time has passed them
by ``bound``, apply them in order to the state so far with the operators of the batch form, and
put rows that arrive later still in a side table. No Python runs per row and no key is one task.

Everything a job keeps is below one folder, by micro-batch: a replayed micro-batch overwrites
its own tables and reads those of the one before, so results are exact after a restart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import jobs as batch_jobs
from ..operators import workers as batch_workers
from ..operators.segments import previous_value

BOUND = "10 minutes"


# --- running a stream to its end ----------------------------------------------------------

def run(stream: DataFrame, write: Callable[[DataFrame, int], None], path: str) -> None:
    """Hand all data that is there now to ``write``, micro-batch by micro-batch."""
    query = (stream.writeStream.outputMode("append").foreachBatch(write)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over the data that is there now and return what it wrote."""
    def write(batch: DataFrame, batch_id: int) -> None:
        # A replayed batch overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return _stored(stream, f"{path}/table").drop("batch_id")


def _stored(like: DataFrame, table: str) -> DataFrame:
    """All micro-batches of a table; an empty one if none was written."""
    spark = like.sparkSession
    schema = StructType([*like.schema.fields, StructField("batch_id", LongType())])
    spark.createDataFrame([], like.schema).write.mode("overwrite").parquet(f"{table}/batch_id=-1")
    return spark.read.schema(schema).parquet(table)


# --- sums: windows, sessions, duplicates ---------------------------------------------

def event_counts(stream: DataFrame, path: str, length: str = "1 hour", slide: str | None = None,
                 ts: str = "ts", event: str = "event") -> DataFrame:
    """Events per type and window, of all windows that hold an event, open ones included."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy(window.alias("w"), event).agg(F.count("*").alias("events")).select(
            F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), event, "events")

    def write(batch: DataFrame, batch_id: int) -> None:
        counted(batch).write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    run(stream, write, path)
    empty = counted(stream.sparkSession.createDataFrame([], stream.schema))
    return _stored(empty, f"{path}/table").groupBy("window_start", "window_end", event).agg(
        F.sum("events").alias("events"))


def job_sessions(stream: DataFrame, path: str, gap: str = "30 minutes", ts: str = "ts",
                 key: str = "job_id") -> DataFrame:
    """Bursts of activity per job, ended by ``gap`` without an event.

    Sessions of micro-batches are stored; those of a job that overlap are one session.
    """
    def sessions(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(
            F.count("*").alias("events")).select(
            key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")

    def write(batch: DataFrame, batch_id: int) -> None:
        sessions(batch).write.mode("overwrite").parquet(f"{path}/table/batch_id={batch_id}")

    run(stream, write, path)
    parts = _stored(sessions(stream.sparkSession.createDataFrame([], stream.schema)), f"{path}/table")
    order = Window.partitionBy(key).orderBy("session_start", "session_end")
    before = F.max("session_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(before <= F.col("session_start"), F.lit(True)).cast("int")
    island = F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return parts.withColumn("opens", opens).withColumn("island", island).groupBy(key, "island").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"),
        F.sum("events").alias("events")).drop("island")


def drop_replays(events: DataFrame, key: list[str], late: str = BOUND, ts: str = "ts") -> DataFrame:
    """Drop repeated deliveries of an event that come within ``late`` of event time.

    Ids are kept that long, so ``late`` should be the longest delay of a delivery.
    """
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


# --- jobs that need order --------------------------------------------------------------

class InOrder:
    """Applies the rows of a stream in the order of event time.

    ``step(state, rows)`` gives the new state and, or ``None``, rows to report; ``state`` is
    ``None`` at first. A row waits until the newest event time is ``bound`` ahead of it. Rows
    that come after their turn are in ``late()`` and take no part. ``state()`` and ``reports()``
    include the rows that still wait, so they describe all that has arrived in time.
    """

    def __init__(self, stream: DataFrame, path: str, step, bound: str = BOUND, ts: str = "ts"):
        self.stream, self.path, self.step, self.bound, self.ts = stream, path, step, bound, ts
        self.spark, self.last = stream.sparkSession, -1
        run(stream, self._write, path)

    def _at(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch_id={batch_id}"

    def _read(self, name: str, batch_id: int) -> DataFrame | None:
        return self.spark.read.parquet(self._at(name, batch_id)) if batch_id >= 0 else None

    def _write(self, batch: DataFrame, batch_id: int) -> None:
        before = batch_id - 1
        mark = None if before < 0 else self._read("mark", before).first()[0]
        waiting, state = self._read("waiting", before), self._read("state", before)
        rows = batch.select(*self.stream.columns)
        late = F.lit(False) if mark is None else F.coalesce(F.col(self.ts) < F.lit(mark), F.lit(False))
        rows.where(late).write.mode("overwrite").parquet(self._at("late", batch_id))
        newest = rows.agg((F.max(self.ts) - F.expr(f"INTERVAL {self.bound}")).alias("mark"))
        newest = newest.select(F.greatest("mark", F.lit(mark).cast("timestamp")).alias("mark"))
        newest.write.mode("overwrite").parquet(self._at("mark", batch_id))
        now = self._read("mark", batch_id).first()[0]
        held = rows.where(~late)
        held = held if waiting is None else held.unionByName(waiting)
        due = F.lit(False) if now is None else F.coalesce(F.col(self.ts) < F.lit(now), F.lit(True))
        held.where(~due).write.mode("overwrite").parquet(self._at("waiting", batch_id))
        new, report = self.step(state, held.where(due))
        new.write.mode("overwrite").parquet(self._at("state", batch_id))
        if report is not None:
            report.write.mode("overwrite").parquet(self._at("report", batch_id))
        self.last = batch_id

    def _to_the_end(self) -> tuple[DataFrame, DataFrame | None]:
        if self.last < 0:
            return self.step(None, self.spark.createDataFrame([], self.stream.schema))
        return self.step(self._read("state", self.last), self._read("waiting", self.last))

    def state(self) -> DataFrame:
        return self._to_the_end()[0]

    def reports(self) -> DataFrame:
        rest = self._to_the_end()[1]
        return rest if self.last < 0 else _stored(rest, f"{self.path}/report").drop("batch_id").unionByName(rest)

    def late(self) -> DataFrame:
        empty = self.spark.createDataFrame([], self.stream.schema)
        return _stored(empty, f"{self.path}/late").drop("batch_id")

    def newest(self) -> DataFrame:
        """The newest event time that has arrived, as one row ``now``."""
        if self.last < 0:
            return self.spark.sql("SELECT CAST(NULL AS timestamp) AS now")
        return self._read("mark", self.last).select((F.col("mark") + F.expr(f"INTERVAL {self.bound}")).alias("now"))


def stream_states(events: DataFrame, path: str, allowed=None, bound: str = BOUND) -> InOrder:
    """Job states of an event stream (job_id, state, ts, seq).

    State: ``job_id, state, accepted, rejected``; a step that is not allowed is rejected.
    """
    def step(state, rows):
        return batch_jobs.replay_states(rows, ["ts", "seq"], allowed, start=state), None
    return InOrder(events.select("job_id", "state", "ts", "seq"), path, step, bound)


def stream_streaks(beats: DataFrame, path: str, bound: str = BOUND) -> InOrder:
    """Failures since the last healthy heartbeat (worker_id, health, ts, seq).

    State: ``worker_id, health, consecutive_failures``.
    """
    def step(state, rows):
        runs = batch_workers.failure_streaks(rows, ["ts", "seq"])
        new = runs.groupBy("worker_id").agg(
            F.max_by(F.struct("health", "consecutive_failures"), F.struct("ts", "seq")).alias("last"),
            F.max(F.coalesce(F.col("health") == "healthy", F.lit(False))).alias("reset"))
        if state is None:
            return new.select("worker_id", "last.*"), None
        old = state.select(F.col("worker_id").alias("_id"), F.col("health").alias("_health"),
                           F.col("consecutive_failures").alias("_n"))
        both = new.join(old, F.col("worker_id").eqNullSafe(F.col("_id")), "full_outer")
        carried = F.when(F.col("reset"), F.lit(0)).otherwise(F.coalesce("_n", F.lit(0)))
        return both.select(
            F.coalesce("worker_id", "_id").alias("worker_id"),
            F.when(F.col("last").isNull(), F.col("_health")).otherwise(F.col("last.health")).alias("health"),
            F.when(F.col("last").isNull(), F.col("_n")).otherwise(
                F.col("last.consecutive_failures") + carried).alias("consecutive_failures")), None
    return InOrder(beats.select("worker_id", "health", "ts", "seq"), path, step, bound)


def stream_stale(events: DataFrame, path: str, seconds: int = 300, bound: str = BOUND,
                 in_flight: tuple[str, ...] = batch_jobs.IN_FLIGHT) -> DataFrame:
    """Silent periods of in-flight jobs that reach the limit (job_id, state, ts, seq).

    A period ends with the job's next event, or is open and reaches to the newest event time.
    """
    fields = ["job_id", "state", "ts", "seq"]

    def silent(state, start, end):
        long = F.unix_micros(end) - F.unix_micros(start) >= seconds * 1_000_000
        return state.isin(*in_flight) & long

    def step(state, rows):
        all_rows = rows.withColumn("held", F.lit(False)) if state is None else \
            rows.withColumn("held", F.lit(False)).unionByName(state.withColumn("held", F.lit(True)))
        steps = previous_value(all_rows.withColumn("here", F.struct("state", "ts")), ["job_id"], ["ts", "seq"], "here")
        ended = steps.where(~F.col("held") & silent(F.col("previous.state"), F.col("previous.ts"), F.col("ts")))
        report = ended.select("job_id", F.col("previous.state").alias("previous_state"),
                              F.lit("RECOVERY_REQUIRED").alias("state"), F.col("previous.ts").alias("last_event"))
        newest = all_rows.groupBy("job_id").agg(F.max(F.struct("ts", "seq", "state")).alias("l"))
        return newest.select("job_id", "l.state", "l.ts", "l.seq"), report

    job = InOrder(events.select(*fields), path, step, bound)
    open_ones = job.state().join(job.newest()).where(silent(F.col("state"), F.col("ts"), F.col("now")))
    return job.reports().unionByName(open_ones.select(
        "job_id", F.col("state").alias("previous_state"), F.lit("RECOVERY_REQUIRED").alias("state"),
        F.col("ts").alias("last_event")))
