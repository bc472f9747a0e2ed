"""Streaming jobs drained over the event log; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import read_table, scratch_path
from ...streaming import jobs as streams
from ...streaming import keyed
from . import query
from .operations import BEATS, HEALTH, LOG, REPLAY, STATES, TRANSITIONS, _mapped


def event_stream(spark, root, path=None):
    """The event log as a stream; a micro-batch is bounded by bytes.

    The pattern lets the log be one file or a folder of files.
    """
    schema = read_table(spark, root, "events").schema
    return (spark.readStream.schema(schema).option("maxBytesPerTrigger", str(256 << 20))
            .parquet(path or f"{root}/events.parquet*")
            .withColumn("ts", F.col("ts").cast("timestamp")))


def _jobs(stream):
    return stream.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        _mapped("event_type", STATES).alias("state"), "ts", F.col("event_id").alias("seq"))


def _beats(stream):
    return stream.select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"),
        _mapped("event_type", HEALTH).alias("health"), "ts", F.col("event_id").alias("seq"))


def unsorted_stream(spark, root):
    """The log as four files that each span all of its time, read one by one."""
    path = f"{scratch_path(spark, 'unsorted')}/in"
    log = read_table(spark, root, "events")
    for part in range(4):
        log.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == part).coalesce(1) \
            .write.mode("append").parquet(path)
    return (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", "1").parquet(path)
            .withColumn("ts", F.col("ts").cast("timestamp")))


#: Files of the unsorted log are up to a month apart in event time.
MONTH = "40 days"
STATES_SQL = f"WITH {REPLAY} SELECT * FROM replay"
STREAKS_SQL = f"""
    WITH {BEATS} SELECT worker_id, arg_max(health, seq) AS health,
        arg_max(consecutive_failures, seq) AS consecutive_failures FROM streaks GROUP BY 1"""
STALE_SQL = f"""
    WITH {LOG}, n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, seq) AS next,
        (SELECT max(ts) FROM log) AS now FROM log)
    SELECT job_id, state AS previous_state, 'RECOVERY_REQUIRED' AS state,
        epoch_us(ts) AS last_event FROM n WHERE state IN ('RUNNING', 'VALIDATING')
        AND epoch_us(coalesce(next, now)) - epoch_us(ts) >= 43200 * 1000000::BIGINT"""
COUNTS_SQL = """
    SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type AS event,
        count(*) AS events FROM events GROUP BY 1, 2"""


@query("stream_states", "R2", STATES_SQL)
def stream_states(spark, root):
    return keyed.stream_states(_jobs(event_stream(spark, root)), scratch_path(spark, "states"), TRANSITIONS).latest("job_id")


@query("stream_states_unsorted", "R2", STATES_SQL)
def stream_states_unsorted(spark, root):
    return keyed.stream_states(_jobs(unsorted_stream(spark, root)), scratch_path(spark, "states"),
                               TRANSITIONS, MONTH).latest("job_id")


@query("stream_streaks", "R4", STREAKS_SQL)
def stream_streaks(spark, root):
    return keyed.stream_streaks(_beats(event_stream(spark, root)), scratch_path(spark, "streaks")).latest("worker_id")


@query("stream_streaks_unsorted", "R4", STREAKS_SQL)
def stream_streaks_unsorted(spark, root):
    return keyed.stream_streaks(_beats(unsorted_stream(spark, root)), scratch_path(spark, "streaks"), MONTH).latest("worker_id")


def _stale(spark, root, stream, bound):
    """Jobs silent in flight for twelve hours of event time."""
    job = keyed.stream_silent(_jobs(stream), scratch_path(spark, "stale"), 43200, bound)
    newest = read_table(spark, root, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now"))
    return keyed.silent_periods(job, newest, 43200).withColumn("last_event", F.unix_micros("last_event"))


@query("stream_stale", "R3 P11", STALE_SQL)
def stream_stale(spark, root):
    return _stale(spark, root, event_stream(spark, root), streams.BOUND)


@query("stream_stale_unsorted", "R3", STALE_SQL)
def stream_stale_unsorted(spark, root):
    return _stale(spark, root, unsorted_stream(spark, root), MONTH)


def _counts(out):
    return out.select(F.unix_micros("window_start").alias("window_start"),
                      F.col("event_type").alias("event"), "events")


@query("stream_event_counts", "R5", COUNTS_SQL)
def stream_event_counts(spark, root):
    """Hourly counts per event, of open windows as well."""
    return _counts(streams.event_counts(event_stream(spark, root), scratch_path(spark, "counts"), event="event_type"))


@query("stream_event_counts_unsorted", "R5", COUNTS_SQL)
def stream_event_counts_unsorted(spark, root):
    return _counts(streams.event_counts(unsorted_stream(spark, root), scratch_path(spark, "counts"), event="event_type"))


@query("stream_sliding_counts", "R5", """
    WITH w AS (SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR
            * (CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END),
            date_trunc('day', ts) + INTERVAL 12 HOUR
            * (CASE WHEN hour(ts) >= 12 THEN 0 ELSE -1 END)]) AS start,
            event_type AS event FROM events)
    SELECT epoch_us(start) AS window_start, event, count(*) AS events FROM w GROUP BY 1, 2""")
def stream_sliding_counts(spark, root):
    return _counts(streams.event_counts(event_stream(spark, root), scratch_path(spark, "sliding"), "1 day",
                                        "12 hours", event="event_type"))


SESSIONS_SQL = """
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id
            ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS session_end,
        count(*) AS events FROM i GROUP BY user_id, island"""


def _sessions(stream, path):
    out = streams.job_sessions(stream, path, "6 hours", key="user_id")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"),
                      F.unix_micros("session_end").alias("session_end"), "events")


@query("stream_sessions", "R5", SESSIONS_SQL)
def stream_sessions(spark, root):
    return _sessions(event_stream(spark, root), scratch_path(spark, "sessions"))


@query("stream_sessions_unsorted", "R5", SESSIONS_SQL)
def stream_sessions_unsorted(spark, root):
    return _sessions(unsorted_stream(spark, root), scratch_path(spark, "sessions"))


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("stream_closed_counts", "R5", f"""
    SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type AS event, count(*) AS events FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED} GROUP BY 1, 2""")
def stream_closed_counts(spark, root):
    """Hourly counts of the windows that the watermark, ten minutes behind, has closed."""
    return _counts(keyed.closed_counts(event_stream(spark, root), scratch_path(spark, "closed"),
                                       event="event_type").changes())


@query("stream_closed_sessions", "R5", f"WITH all_of AS ({SESSIONS_SQL}) SELECT * FROM all_of WHERE session_end <= epoch_us({_CLOSED})")
def stream_closed_sessions(spark, root):
    """Sessions that nothing in time can prolong any more."""
    out = keyed.closed_sessions(event_stream(spark, root), scratch_path(spark, "bursts"), "6 hours", key="user_id").changes()
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"),
                      F.unix_micros("session_end").alias("session_end"), "events")


@query("stream_without_replays", "R6", """
    SELECT event_type AS event, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events
    GROUP BY 1""")
def stream_without_replays(spark, root):
    """The log delivered twice; repeated events are dropped."""
    path = scratch_path(spark, "twice")
    log = read_table(spark, root, "events")
    log.write.mode("append").parquet(f"{path}/in")
    log.write.mode("append").parquet(f"{path}/in")
    # the second delivery is a whole month late
    stream = streams.drop_replays(event_stream(spark, root, f"{path}/in"), ["event_id"], MONTH)
    out = streams.drain(stream.select("event_id", "event_type"), f"{path}/out")
    return out.groupBy(F.col("event_type").alias("event")).agg(
        F.count("*").alias("events"), F.sum("event_id").alias("ids"))
