"""Analytics over job tables and job event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..session import rule_rows
from .segments import SLICE, join_nullsafe, numbered, previous_value, with_slices

IN_FLIGHT = ("RUNNING", "VALIDATING")
ROWS_PER_SLICE = 10_000


# --- tables ------------------------------------------------------------------------

def latest(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Newest version of every key; combined before the shuffle, so hot keys stay cheap."""
    rest = [c for c in df.columns if c not in key]
    by = F.struct(*order)
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_row")).select(
        *key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def list_jobs(jobs: DataFrame, limit: int | None = None, **equal) -> DataFrame:
    """Newest jobs first, all or the first ``limit``; blank filters are ignored."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than zero")
    for name, value in equal.items():
        if name not in ("status", "domain", "tool", "worker"):
            raise ValueError(f"unknown filter: {name}")
        if value:
            jobs = jobs.where(F.col(name) == value)
    ordered = jobs.orderBy(F.desc("created_at"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def fifo(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Queued jobs in the order they were created, all or the first ``limit``."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be greater than zero")
    ordered = jobs.where(F.col("status") == "QUEUED").orderBy("created_at", "job_id")
    return ordered if limit is None else ordered.limit(limit)


def count_jobs(jobs: DataFrame, *by: str, **equal) -> DataFrame:
    for name, value in equal.items():
        if value:
            jobs = jobs.where(F.col(name) == value)
    return jobs.groupBy(*by).agg(F.count("*").alias("jobs"))


def change_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """New versions of the jobs named in ``changes(job_id, status, error, at)``."""
    return jobs.drop("status", "error", "updated_at").join(
        changes.select("job_id", "status", "error", F.col("at").alias("updated_at")), "job_id")


def unknown_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes of jobs that do not exist; an update with any of these is an error."""
    return changes.join(jobs.select("job_id"), "job_id", "left_anti")


# --- recovery --------------------------------------------------------------------------

def stale_jobs(jobs: DataFrame, as_of: Column, seconds: float = 300,
               include_queued: bool = False) -> DataFrame:
    """In-flight jobs silent for at least ``seconds``; adds ``stale_age_seconds``.

    ``updated_at`` is text ``yyyy-MM-dd HH:mm:ss``. A missing time is a candidate without an
    age, unreadable text counts as infinitely old. Order the result by ``updated_at``.
    """
    if seconds < 0:
        raise ValueError("seconds cannot be negative")
    states = IN_FLIGHT + (("QUEUED",) if include_queued else ())
    text = F.nullif("updated_at", F.lit(""))
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    age = F.when(text.isNull(), F.lit(None).cast("double")).otherwise(
        F.coalesce(tx.age_seconds(parsed, as_of), F.lit(float("inf"))))
    return (jobs.where(F.col("status").isin(*states))
            .withColumn("_age", age)
            .where(F.col("_age").isNull() | (F.col("_age") >= seconds))
            .withColumn("stale_age_seconds", F.when(
                F.col("_age") == float("inf"), F.col("_age")).otherwise(F.round("_age", 3)))
            .drop("_age"))


def mark_recovery(stale: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New job versions in RECOVERY_REQUIRED and one RECOVERY_DETECTED event each."""
    text = F.concat(
        F.lit(vocab.STALE_REASON),
        F.col("status"), F.lit("."))
    target = "RECOVERY_REQUIRED"
    events = stale.select(
        "job_id", F.lit("RECOVERY_DETECTED").alias("event"), as_of.alias("timestamp"),
        F.col("status").alias("previous_state"), F.lit(target).alias("state"),
        "stale_age_seconds", text.alias("reason"))
    versions = stale.withColumn("error", text).withColumn("status", F.lit(target)).withColumn(
        "updated_at", F.date_format(as_of, "yyyy-MM-dd HH:mm:ss")).drop("stale_age_seconds")
    return versions, events


# --- transitions -----------------------------------------------------------------------

def _pairs(allowed) -> list[tuple]:
    return rule_rows(vocab.TRANSITIONS if allowed is None else allowed, ("from", "to"))


def is_legal(current: Column, target: Column, allowed=None) -> Column:
    """A state may stay the same; any other step must be in the table."""
    pairs = [f"{a}>{b}" for a, b in _pairs(allowed)]
    return (current == target) | F.concat(current, F.lit(">"), target).isin(*pairs)


def transitions(events: DataFrame, order: list[str], key: str = "job_id",
                state: str = "state") -> DataFrame:
    """Adds ``previous``: the state before, per job."""
    return previous_value(events, [key], order, state, "previous")


def illegal_transitions(events: DataFrame, order: list[str], allowed=None,
                        key: str = "job_id", state: str = "state") -> DataFrame:
    """Events whose step from the job's previous event is not allowed."""
    steps = transitions(events, order, key, state)
    return steps.where(F.col("previous").isNotNull()
                       & ~is_legal(F.col("previous"), F.col(state), allowed))


def replay_states(events: DataFrame, order: list[str], allowed=None, key: str = "job_id",
                  state: str = "state", parts: int | None = None,
                  start: DataFrame | None = None) -> DataFrame:
    """Run the state machine over a log: rejected events leave the state as it is.

    Each slice of a job is reduced to a table "state before -> state after" over the states
    that job has, and the tables are applied in order. So no task replays the whole log of a
    job that owns many events. ``start`` is an earlier result to go on from. Events without a
    state are passed over. Returns ``(key, state, accepted, rejected)``.
    """
    pairs = [f"{a}>{b}" for a, b in _pairs(allowed)]
    events = events.where(F.col(state).isNotNull())
    if parts is None:
        # A slice of a job becomes one array, so slices are sized by rows.
        parts = max(16 * int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                    events.count() // ROWS_PER_SLICE)
    rows = with_slices(events, order, parts)
    sliced = rows.groupBy(key, SLICE).agg(F.array_sort(F.collect_list(
        F.struct(*[F.col(o).alias(f"o{n}") for n, o in enumerate(order)],
                 F.col(state).alias("s")))).alias("_log"))
    seen = events.select(key, F.col(state).alias("_s"))
    if start is not None:
        seen = seen.unionByName(start.select(key, F.col(state).alias("_s")))
    seen = seen.groupBy(key).agg(F.collect_set("_s").alias("_states"))

    def step(acc, event):
        ok = acc["s"].isNull() | (acc["s"] == event["s"]) | F.concat(
            acc["s"], F.lit(">"), event["s"]).isin(*pairs)
        return F.struct(F.when(ok, event["s"]).otherwise(acc["s"]).alias("s"),
                        (acc["n"] + ok.cast("long")).alias("n"))

    def run(begin):
        return F.aggregate("_log", F.struct(begin.alias("s"), F.lit(0).cast("long").alias("n")), step)

    starts = F.concat(F.array(F.lit(None).cast("string")), F.col("_states"))
    effect = join_nullsafe(sliced, seen, [key]).select(
        key, SLICE, F.size("_log").alias("_events"),
        F.transform(starts, lambda s: F.struct(s.alias("start"), run(s).alias("end"))).alias("_effect"))
    along = effect.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(SLICE, "_effect"))).alias("_slices"),
        F.sum("_events").alias("_events"))
    nothing = F.struct(F.lit(None).cast("string").alias("s"), F.lit(0).cast("long").alias("n"))
    if start is None:
        along = along.select(key, "_slices", "_events", nothing.alias("_start"), F.lit(0).cast("long").alias("_before"))
    else:
        old = start.select(F.col(key).alias("_key"), F.struct(F.col(state).alias("s"), F.col("accepted").alias("n")).alias("_old"),
                           (F.col("accepted") + F.col("rejected")).alias("_before"))
        along = along.join(old, F.col(key).eqNullSafe(F.col("_key")), "full_outer").select(
            F.coalesce(key, "_key").alias(key), "_slices", F.coalesce("_events", F.lit(0)).alias("_events"),
            F.coalesce("_old", nothing).alias("_start"), F.coalesce("_before", F.lit(0)).alias("_before"))

    def chain(acc, part):
        end = F.element_at(F.filter(
            part["_effect"], lambda e: e["start"].eqNullSafe(acc["s"])), 1)["end"]
        return F.struct(end["s"].alias("s"), (acc["n"] + end["n"]).alias("n"))

    final = F.coalesce(F.aggregate("_slices", F.col("_start"), chain), F.col("_start"))
    return along.select(key, final.alias("_f"), "_events", "_before").select(
        key, F.col("_f.s").alias(state), F.col("_f.n").alias("accepted"),
        (F.col("_before") + F.col("_events") - F.col("_f.n")).alias("rejected"))


# --- failures and retries -----------------------------------------------------------------

def classify_failures(df: DataFrame, rules=None, message: str = "message",
                      timed_out: Column | None = None) -> DataFrame:
    """Adds ``failure_type``, ``retryable`` and ``reason`` for an error message.

    The first matching rule decides; ``timed_out`` marks explicit timeouts.
    """
    rows = rule_rows(vocab.FAILURE_RULES if rules is None else rules, ("kind", "needle"))
    text = F.lower(F.coalesce(F.col(message), F.lit("")))
    first = F.coalesce(*[
        F.when(F.contains(text, F.lit(n)),
               F.struct(F.lit(k).alias("kind"),
                        F.lit(vocab.MATCHED_REASON.format(kind=k.lower(), needle=n)).alias("reason")))
        for k, n in rows], F.struct(
            F.lit("UNKNOWN").alias("kind"),
            F.lit(vocab.UNCLASSIFIED_REASON).alias("reason")))
    if timed_out is not None:
        first = F.when(timed_out, F.struct(
            F.lit("TIMEOUT").alias("kind"), F.lit(vocab.TIMEOUT_REASON).alias("reason"))
        ).otherwise(first)
    return (df.withColumn("_first", first)
            .withColumn("failure_type", F.col("_first.kind"))
            .withColumn("retryable", F.col("failure_type").isin("TRANSIENT", "TIMEOUT"))
            .withColumn("reason", F.col("_first.reason")).drop("_first"))


def classify_results(df: DataFrame, rules=None) -> DataFrame:
    """Classify tool results (status, return_code, error, stderr, stdout).

    ``failure_type`` is NULL for success. ``raised_message`` is the text a failed result
    raises: the first non-blank of error, stderr and stdout, else the reason.
    """
    status = F.lower(tx.or_empty("status"))
    parts = [F.nullif(c, F.lit("")) for c in ("error", "stderr", "stdout")]
    joined = F.nullif(F.concat_ws(" ", *parts), F.lit(""))
    fallback = F.concat(F.lit("status="), status, F.lit(", return_code="),
                        F.coalesce(F.col("return_code").cast("string"), F.lit("None")))
    ok = (status == "completed") & F.coalesce(F.col("return_code") == 0, F.lit(True))
    timeout = status == "timeout"
    out = classify_failures(df.withColumn("_text", F.coalesce(joined, fallback)), rules, "_text")
    kind = F.when(ok, F.lit(None)).when(timeout, F.lit("TIMEOUT")).otherwise(F.col("failure_type"))
    reason = (F.when(ok, F.lit(None)).when(timeout, F.lit(vocab.TOOL_TIMEOUT_REASON))
              .otherwise(F.col("reason")))
    return (out.withColumns({"failure_type": kind, "reason": reason,
                             "retryable": F.when(ok, F.lit(None)).when(timeout, F.lit(True))
                             .otherwise(F.col("retryable"))})
            .withColumn("raised_message", F.when(
                ~ok, F.when(timeout, F.col("reason")).otherwise(
                    F.coalesce(*parts, F.col("reason")))))
            .drop("_text"))


def retry_decision(df: DataFrame, max_attempts: int = 3, base: float = 1.0,
                   cap: float = 30.0) -> DataFrame:
    """Adds ``retry``, ``delay_seconds`` and ``retry_reason`` from ``retryable`` and ``attempt``."""
    if max_attempts <= 0:
        raise ValueError("max_attempts must be greater than zero")
    if base < 0 or cap < 0:
        raise ValueError("delays cannot be negative")
    retryable, attempt = F.coalesce("retryable", F.lit(False)), F.col("attempt")
    retry = retryable & (attempt < max_attempts) & (attempt > 0)
    delay = F.when(retry, F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1),
                                  F.lit(float(cap)))).otherwise(F.lit(0.0))
    reason = (
        F.when(attempt <= 0, F.lit(vocab.ATTEMPT_ERROR))
        .when(~retryable, F.lit(vocab.NOT_RETRYABLE_REASON))
        .when(attempt >= max_attempts, F.lit(vocab.MAX_ATTEMPTS_REASON.format(attempts=max_attempts)))
        .otherwise(F.replace(F.lit(vocab.RETRY_REASON), F.lit("{kind}"), F.col("failure_type"))))
    return df.withColumns({"retry": retry, "delay_seconds": delay, "retry_reason": reason})


def number_attempts(df: DataFrame, order: list[str], key: str = "job_id") -> DataFrame:
    """Adds ``attempt``: 1, 2, … per job in log order."""
    return numbered(df, [key], order, "attempt")
