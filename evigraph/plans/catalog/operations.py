"""Job logs, job tables, workers, routes and artifacts, read from the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...functions import text as tx
from ...operators import segments, artifacts, jobs, workers
from ...session import read_table, scratch_path
from ...sources import tables
from . import query
from . import sqltext as s

STATES = {"signup": "QUEUED", "click": "RUNNING", "view": "VALIDATING",
          "purchase": "COMPLETED", "error": "FAILED"}
HEALTH = {"signup": "unhealthy", "click": "healthy", "view": "unhealthy",
          "purchase": "healthy", "error": "timeout"}
# More steps are allowed here than by default, so that replays move through several states.
TRANSITIONS = vocab.TRANSITIONS + [("COMPLETED", "QUEUED"), ("FAILED", "QUEUED")]
ORDER = ["ts", "seq"]
AS_OF = "2024-01-31 00:00:00"


def _mapped(column, mapping):
    out = None
    for key, value in mapping.items():
        out = (F.when(F.col(column) == key, F.lit(value)) if out is None
               else out.when(F.col(column) == key, F.lit(value)))
    return out


def _case(column, mapping):
    return f"CASE {column} " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def job_events(spark, root):
    return read_table(spark, root, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        _mapped("event_type", STATES).alias("state"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("event"), "value")


LOG = f"""log AS (SELECT 'job-' || user_id AS job_id, {_case('event_type', STATES)} AS state, ts,
    event_id AS seq, event_type AS event, value, user_id FROM events)"""


def job_versions(spark, root):
    """One job version per event; some update times are missing, blank or unreadable."""
    e = read_table(spark, root, "events")
    u = F.col("user_id")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select(
        F.concat(F.lit("job-"), u.cast("string")).alias("job_id"),
        _mapped("event_type", STATES).alias("status"),
        F.element_at(F.array(F.lit("chem"), F.lit("cad"), F.lit("sec")),
                     (u % 3 + 1).cast("int")).alias("domain"),
        F.concat(F.lit("t"), (u % 5).cast("string")).alias("tool"),
        F.concat(F.lit("w"), (u % 4).cast("string")).alias("worker"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, user_id)")
        .alias("created_at"),
        F.when(u % 11 == 0, F.lit(None)).when(u % 13 == 0, F.lit("not a time"))
        .when(u % 17 == 0, F.lit("")).otherwise(stamp).alias("updated_at"),
        F.lit(None).cast("string").alias("error"), F.col("event_id").alias("seq"))


def job_table(spark, root):
    return jobs.latest(job_versions(spark, root), ["job_id"], "seq")


VERSIONS = f"""versions AS (SELECT 'job-' || user_id AS job_id,
        {_case('event_type', STATES)} AS status, (['chem', 'cad', 'sec'])[user_id % 3 + 1]
        AS domain, 't' || user_id % 5 AS tool, 'w' || user_id % 4 AS worker,
        TIMESTAMP '2024-01-01 00:00:00' + to_hours(user_id) AS created_at,
        CASE WHEN user_id % 11 = 0 THEN NULL WHEN user_id % 13 = 0 THEN 'not a time'
            WHEN user_id % 17 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END
        AS updated_at, event_id AS seq FROM events),
    jobs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC)
        AS n FROM versions) WHERE n = 1)"""


# --- job tables --------------------------------------------------------------------------

@query("latest_jobs", "W6 S12 M15", f"""
    WITH {VERSIONS} SELECT job_id, status, domain, tool, worker, updated_at, seq FROM jobs""")
def latest_jobs(spark, root):
    return job_table(spark, root).select(
        "job_id", "status", "domain", "tool", "worker", "updated_at", "seq")


@query("job_status_changes", "S12", f"""
    WITH {VERSIONS}, c AS (SELECT job_id, 'CANCELLED' AS status, 'stopped by ' || worker AS error
        FROM jobs WHERE status = 'QUEUED' UNION ALL SELECT 'job-none', 'FAILED', 'x')
    SELECT c.job_id, c.status, c.error, j.domain IS NOT NULL AS known FROM c
    LEFT JOIN jobs j USING (job_id)""")
def job_status_changes(spark, root):
    """Queued jobs cancelled in one batch; a change of an unknown job is reported."""
    table = job_table(spark, root)
    at = F.lit("2024-02-01 00:00:00")
    changes = table.where("status = 'QUEUED'").select(
        "job_id", F.lit("CANCELLED").alias("status"),
        F.concat(F.lit("stopped by "), "worker").alias("error"), at.alias("at")).unionAll(
        spark.createDataFrame([("job-none", "FAILED", "x", "2024-02-01 00:00:00")],
                              "job_id string, status string, error string, at string"))
    applied = jobs.change_status(table, changes)
    unknown = jobs.unknown_changes(table, changes)
    return applied.select("job_id", "status", "error", F.lit(True).alias("known")).unionAll(
        unknown.select("job_id", "status", "error", F.lit(False)))


@query("list_jobs", "P8 O1", f"""
    WITH {VERSIONS} SELECT job_id, status, domain, worker FROM jobs
    WHERE domain = 'cad' AND worker = 'w1' ORDER BY created_at DESC, job_id LIMIT 10""")
def list_jobs(spark, root):
    return jobs.list_jobs(job_table(spark, root), 10, domain="cad", worker="w1", status="") \
        .select("job_id", "status", "domain", "worker")


@query("fifo_queue", "O2", f"""
    WITH {VERSIONS} SELECT job_id, row_number() OVER (ORDER BY created_at, job_id)::INTEGER
        AS place FROM jobs WHERE status = 'QUEUED' ORDER BY created_at, job_id LIMIT 1000""")
def fifo_queue(spark, root):
    """The queue is cut to its limit before places are numbered."""
    from pyspark.sql import Window
    return jobs.fifo(job_table(spark, root), 1000).select("job_id", F.row_number().over(
        Window.orderBy("created_at", "job_id")).alias("place"))


@query("count_jobs", "A15", f"""
    WITH {VERSIONS} SELECT status, domain, count(*) AS jobs FROM jobs GROUP BY 1, 2""")
def count_jobs(spark, root):
    return jobs.count_jobs(job_table(spark, root), "status", "domain")


_AGE = f"""aged AS (SELECT *, CASE WHEN coalesce(updated_at, '') = '' THEN NULL ELSE coalesce(
        epoch(TIMESTAMP '{AS_OF}') - epoch(try_strptime(updated_at, '%Y-%m-%d %H:%M:%S')),
        'infinity'::DOUBLE) END AS age FROM jobs
        WHERE status IN ('RUNNING', 'VALIDATING', 'QUEUED')),
    stale AS (SELECT * FROM aged WHERE age IS NULL OR age >= 14400)"""


def _stale(spark, root):
    return jobs.stale_jobs(job_table(spark, root), F.lit(AS_OF).cast("timestamp"), 14400, True)


@query("stale_jobs", "P11 H7", f"""
    WITH {VERSIONS}, {_AGE} SELECT job_id, status, round(age, 3) AS stale_age_seconds
    FROM stale""")
def stale_jobs(spark, root):
    return _stale(spark, root).select("job_id", "status", "stale_age_seconds")


@query("mark_recovery", "P16", f"""
    WITH {VERSIONS}, {_AGE}, t AS (SELECT *, '{vocab.STALE_REASON}' || status || '.' AS text FROM stale)
    SELECT 'version' AS kind, job_id, 'RECOVERY_REQUIRED' AS state, text FROM t
    UNION ALL SELECT 'RECOVERY_DETECTED', job_id, 'RECOVERY_REQUIRED', text FROM t""")
def mark_recovery(spark, root):
    versions, events = jobs.mark_recovery(_stale(spark, root), F.lit(AS_OF).cast("timestamp"))
    return versions.select(F.lit("version").alias("kind"), "job_id",
                           F.col("status").alias("state"), F.col("error").alias("text")).unionAll(
        events.select("event", "job_id", "state", "reason"))


# --- event logs -----------------------------------------------------------------------------

@query("event_log_round_trip", "S10 M16", f"""
    WITH {LOG} SELECT event, state, count(*) AS events, count(DISTINCT job_id) AS jobs FROM log
    GROUP BY 1, 2""")
def event_log_round_trip(spark, root):
    """Events appended as JSON lines in two batches and read back."""
    path = scratch_path(spark, "events")
    log = job_events(spark, root).select(
        "job_id", "event", F.col("ts").alias("timestamp"), "state",
        F.lit(1).alias("attempt"), F.col("value").cast("string").alias("details"))
    as_of = F.lit(AS_OF).cast("timestamp")
    tables.append_events(log.where("state = 'FAILED'"), path, as_of)
    tables.append_events(log.where("state <> 'FAILED'"), path, as_of)
    return tables.read_events(spark, path).groupBy("event", "state").agg(
        F.count("*").alias("events"), F.countDistinct("job_id").alias("jobs"))


@query("previous_states", "W4", f"""
    WITH {LOG} SELECT seq, job_id, state,
        lag(state) OVER (PARTITION BY job_id ORDER BY ts, seq) AS previous FROM log""")
def previous_states(spark, root):
    return jobs.transitions(job_events(spark, root), ORDER).select(
        "seq", "job_id", "state", "previous")


_PAIRS = s.values(TRANSITIONS, "a, b")


@query("illegal_transitions", "J14 W4", f"""
    WITH {LOG}, p AS (SELECT *, lag(state) OVER (PARTITION BY job_id ORDER BY ts, seq)
        AS previous FROM log)
    SELECT seq, job_id, previous, state FROM p WHERE previous <> state
        AND (previous, state) NOT IN (SELECT a, b FROM {_PAIRS})""")
def illegal_transitions(spark, root):
    return jobs.illegal_transitions(job_events(spark, root), ORDER, TRANSITIONS).select(
        "seq", "job_id", "previous", "state")


REPLAY = f"""{LOG}, numbered AS (SELECT *, row_number() OVER (PARTITION BY job_id
        ORDER BY ts, seq) AS n FROM log),
    replay AS (WITH RECURSIVE r(job_id, n, state, accepted, rejected) AS (
        SELECT job_id, n, state, 1::BIGINT, 0::BIGINT FROM numbered WHERE n = 1 UNION ALL
        SELECT r.job_id, e.n, CASE WHEN e.state = r.state OR t.a IS NOT NULL THEN e.state
                ELSE r.state END,
            r.accepted + (e.state = r.state OR t.a IS NOT NULL)::INT,
            r.rejected + (NOT (e.state = r.state OR t.a IS NOT NULL))::INT
        FROM r JOIN numbered e ON e.job_id = r.job_id AND e.n = r.n + 1
            LEFT JOIN {_PAIRS} ON t.a = r.state AND t.b = e.state)
        SELECT job_id, arg_max(state, n) AS state, max(accepted) AS accepted,
            max(rejected) AS rejected FROM r GROUP BY 1)"""


_HOLES = """holes AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'job-' || user_id END AS job_id,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('day', ts) END AS day, event_id AS seq,
    event_type AS kind FROM events)"""


@query("previous_states_with_nulls", "W4 W8", f"""
    WITH {_HOLES} SELECT seq, lag(kind) OVER w AS previous, row_number() OVER w AS attempt FROM holes
    WINDOW w AS (PARTITION BY job_id ORDER BY day NULLS FIRST, seq)""")
def previous_states_with_nulls(spark, root):
    """Events without a job or a time, and days that many events of a job share."""
    n = F.col("event_id")
    holes = read_table(spark, root, "events").select(
        F.when(n % 7 != 0, F.concat(F.lit("job-"), F.col("user_id").cast("string"))).alias("job_id"),
        F.when(n % 5 != 0, F.date_trunc("day", "ts")).alias("day"), n.alias("seq"),
        F.col("event_type").alias("kind"))
    order = ["day", "seq"]
    steps = segments.previous_value(holes, ["job_id"], order, "kind")
    return segments.numbered(steps, ["job_id"], order, "attempt").select("seq", "previous", "attempt")


@query("replay_states", "J14 R2", f"WITH {REPLAY} SELECT * FROM replay")
def replay_states(spark, root):
    return jobs.replay_states(job_events(spark, root), ORDER, TRANSITIONS)


@query("attempt_numbers", "W8", f"""
    WITH {LOG} SELECT seq, job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq)
        AS attempt FROM log WHERE state = 'RUNNING'""")
def attempt_numbers(spark, root):
    started = job_events(spark, root).where("state = 'RUNNING'")
    return jobs.number_attempts(started, ORDER).select("seq", "job_id", "attempt")


# --- failures ----------------------------------------------------------------------------------

_TEXTS = ([f"Run 7: {n.upper()} (code 3)" for _, n in vocab.FAILURE_RULES]
          + ["everything is odd", "Broken Pipe, then file not found", ""])


def _messages(spark, root):
    texts = F.array(*[F.lit(t) for t in _TEXTS])
    k = F.get_json_object("props", "$.k").cast("int")
    return read_table(spark, root, "events").select(
        "event_id", F.element_at(texts, (F.col("event_id") % len(_TEXTS) + 1).cast("int"))
        .alias("message"), k.alias("k"), "event_type")


_MESSAGES = ("messages AS (SELECT event_id, (["
             + ", ".join(s.quoted(t) for t in _TEXTS)
             + f"])[event_id % {len(_TEXTS)} + 1] AS message, "
             "json_extract_string(props, '$.k')::INT AS k, event_type FROM events)")


def _classify_sql(text):
    kind = " ".join(f"WHEN contains(lower({text}), {s.quoted(n)}) THEN '{k}'"
                    for k, n in vocab.FAILURE_RULES)
    why = " ".join(f"WHEN contains(lower({text}), {s.quoted(n)}) THEN "
                   f"'{vocab.MATCHED_REASON.format(kind=k.lower(), needle=n)}'" for k, n in vocab.FAILURE_RULES)
    return (f"CASE {kind} ELSE 'UNKNOWN' END",
            f"CASE {why} ELSE '{vocab.UNCLASSIFIED_REASON}' END")


_KIND, _WHY = _classify_sql("message")


@query("classify_failures", "T9", f"""
    WITH {_MESSAGES} SELECT event_id, CASE WHEN event_type = 'view' THEN 'TIMEOUT' ELSE {_KIND}
        END AS failure_type, CASE WHEN event_type = 'view' THEN '{vocab.TIMEOUT_REASON}'
        ELSE {_WHY} END AS reason FROM messages""")
def classify_failures(spark, root):
    return jobs.classify_failures(
        _messages(spark, root), timed_out=F.col("event_type") == "view").select(
        "event_id", "failure_type", "reason")


def _results(spark, root):
    m = _messages(spark, root)
    kind, k = F.col("event_type"), F.col("k")
    return m.select(
        "event_id", F.when(kind == "view", F.lit(" Timeout")).when(
            kind == "error", F.lit("failed")).when(kind == "signup", F.lit("FAILED "))
        .otherwise(F.lit("Completed")).alias("status"),
        F.when(kind == "purchase", k % 2).when(kind == "error", F.lit(2)).alias("return_code"),
        F.when(k % 3 == 0, F.col("message")).alias("error"),
        F.when(k % 3 == 1, F.col("message")).otherwise(F.lit("")).alias("stderr"),
        F.when(k % 5 == 2, F.lit("output")).alias("stdout"), k)


_RESULTS = f"""{_MESSAGES}, results AS (SELECT event_id, k, CASE event_type WHEN 'view'
        THEN 'timeout' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'failed'
        ELSE 'completed' END AS status,
        CASE event_type WHEN 'purchase' THEN k % 2 WHEN 'error' THEN 2 END AS return_code,
        nullif(CASE WHEN k % 3 = 0 THEN message END, '') AS error,
        nullif(CASE WHEN k % 3 = 1 THEN message END, '') AS stderr,
        CASE WHEN k % 5 = 2 THEN 'output' END AS stdout FROM messages),
    texts AS (SELECT *, coalesce(nullif(concat_ws(' ', error, stderr, stdout), ''),
        'status=' || status || ', return_code=' || coalesce(return_code::VARCHAR, 'None'))
        AS message FROM results),
    classed AS (SELECT *, CASE WHEN status = 'completed' AND coalesce(return_code, 0) = 0 THEN NULL
        WHEN status = 'timeout' THEN 'TIMEOUT' ELSE {_KIND} END AS failure_type,
        CASE WHEN status = 'completed' AND coalesce(return_code, 0) = 0 THEN NULL
        WHEN status = 'timeout' THEN '{vocab.TOOL_TIMEOUT_REASON}' ELSE {_WHY} END AS reason
        FROM texts)"""


@query("classify_results", "T10", f"""
    WITH {_RESULTS} SELECT event_id, failure_type, reason, CASE WHEN failure_type IS NULL THEN NULL
        WHEN status = 'timeout' THEN reason ELSE coalesce(error, stderr, stdout, reason) END
        AS raised_message FROM classed""")
def classify_results(spark, root):
    return jobs.classify_results(_results(spark, root)).select(
        "event_id", "failure_type", "reason", "raised_message")


@query("retry_decisions", "T11 H8", f"""
    WITH {_RESULTS}, d AS (SELECT *, k % 5 AS attempt,
        coalesce(failure_type IN ('TRANSIENT', 'TIMEOUT'), FALSE) AS ok FROM classed)
    SELECT event_id, ok AND attempt BETWEEN 1 AND 2 AS retry,
        CASE WHEN ok AND attempt BETWEEN 1 AND 2 THEN least(2.5 * 2 ** (attempt - 1), 4)
            ELSE 0 END::DOUBLE AS delay_seconds,
        CASE WHEN attempt <= 0 THEN '{vocab.ATTEMPT_ERROR}'
            WHEN NOT ok THEN '{vocab.NOT_RETRYABLE_REASON}'
            WHEN attempt >= 3 THEN '{vocab.MAX_ATTEMPTS_REASON.format(attempts=3)}'
            ELSE replace('{vocab.RETRY_REASON}', '{{kind}}', failure_type) END
        AS retry_reason FROM d""")
def retry_decisions(spark, root):
    classed = jobs.classify_results(_results(spark, root)).withColumn("attempt", F.col("k") % 5)
    return jobs.retry_decision(classed, 3, 2.5, 4.0).select(
        "event_id", "retry", "delay_seconds", "retry_reason")


# --- workers ------------------------------------------------------------------------------------

def heartbeats(spark, root):
    return read_table(spark, root, "events").select(
        F.concat(F.lit("w"), F.col("user_id").cast("string")).alias("worker_id"),
        _mapped("event_type", HEALTH).alias("health"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("latency_seconds"))


BEATS = f"""beats AS (SELECT 'w' || user_id AS worker_id, {_case('event_type', HEALTH)} AS health,
        ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN value END AS latency_seconds
        FROM events),
    islands AS (SELECT *, sum((health = 'healthy')::INT) OVER (PARTITION BY worker_id
        ORDER BY ts, seq) AS island FROM beats),
    streaks AS (SELECT *, sum((health <> 'healthy')::INT) OVER (PARTITION BY worker_id, island
        ORDER BY ts, seq)::BIGINT AS consecutive_failures FROM islands)"""


@query("failure_streaks", "W5 M18", f"""
    WITH {BEATS} SELECT seq, worker_id, health, consecutive_failures FROM streaks""")
def failure_streaks(spark, root):
    return workers.failure_streaks(heartbeats(spark, root), ORDER).select(
        "seq", "worker_id", "health", "consecutive_failures")


@query("current_health", "W6 W5", f"""
    WITH {BEATS} SELECT worker_id, arg_max(health, seq) AS health,
        arg_max(consecutive_failures, seq) AS consecutive_failures, max(seq) AS seq
    FROM streaks GROUP BY 1""")
def current_health(spark, root):
    return workers.current_health(heartbeats(spark, root), ORDER).select(
        "worker_id", "health", "consecutive_failures", "seq")


@query("health_status", "T12", f"""
    WITH p AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' ELSE 'done' END
            AS status, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1
            WHEN 'error' THEN 0 END AS code,
            CASE WHEN value > 10 THEN ' host-' || user_id || ' ' ELSE '' END AS stdout,
            CASE WHEN value > 20 THEN 'slow link' END AS stderr FROM events)
    SELECT event_id, CASE WHEN status = 'timeout' THEN 'timeout' WHEN code = 0 THEN 'healthy'
            ELSE 'unhealthy' END AS health,
        CASE WHEN status = 'timeout' THEN coalesce(stderr, '{vocab.BEAT_TIMEOUT}')
            WHEN code = 0 THEN '{vocab.BEAT_SUCCESS}'
            ELSE coalesce(stderr, nullif(stdout, ''), '{vocab.BEAT_FAILURE}'
                || coalesce(code::VARCHAR, 'None') || '.') END AS message,
        CASE WHEN status <> 'timeout' AND code = 0 THEN nullif(trim(stdout), '') END AS hostname
    FROM p""")
def health_status(spark, root):
    kind = F.col("event_type")
    pings = read_table(spark, root, "events").select(
        "event_id", F.when(kind == "error", F.lit("timeout")).otherwise(F.lit("done"))
        .alias("status"),
        F.when(kind == "click", 0).when(kind == "view", 1).when(kind == "error", 0)
        .alias("return_code"),
        F.when(F.col("value") > 10, F.concat(
            F.lit(" host-"), F.col("user_id").cast("string"), F.lit(" "))).otherwise(F.lit(""))
        .alias("stdout"), F.when(F.col("value") > 20, F.lit("slow link")).alias("stderr"))
    return workers.health_status(pings).select("event_id", "health", "message", "hostname")


# --- routes and capabilities -------------------------------------------------------------------

AGENTS = [
    ("urgent", ["O:1-URGENT", "f:1-urgent", "p:1 urgent"], 10),
    ("open_orders", ["o:*"], 50), ("closed_orders", ["F:*", "f:*"], 40),
    ("low_priority", ["O:5-low", "F:5-LOW"], 40), ("fallback", ["*:*"], 100),
    ("unused", ["x:y"], 1), (" by_name ", ["p:4-NOT SPECIFIED", "P:3-medium"], 20),
]


def _requests(spark, root):
    return read_table(spark, root, "orders").select(
        F.col("o_orderstatus").alias("domain"), F.col("o_orderpriority").alias("tool"),
        "o_orderkey")


_KEY = "replace(replace(lower({}), '-', '_'), ' ', '_')"
_MATCHED = f"""agents AS (SELECT DISTINCT trim(agent_id) AS agent_id,
        {_KEY.format('route')} AS route, priority FROM {s.values(
            [(a, r, p) for a, rs, p in AGENTS for r in rs], 'agent_id, route, priority')}),
    requests AS (SELECT DISTINCT o_orderstatus AS domain, o_orderpriority AS tool,
        {_KEY.format("o_orderstatus || ':' || o_orderpriority")} AS full_route FROM orders),
    matched AS (SELECT DISTINCT r.domain, r.tool, a.agent_id, a.priority FROM requests r
        JOIN agents a ON a.route = r.full_route OR a.route = '*:*'
            OR a.route = split_part(r.full_route, ':', 1) || ':*')"""


def _agents(spark):
    return spark.createDataFrame(AGENTS, "agent_id string, routes array<string>, priority int")


@query("matching_routes", "J11 M20 O6", f"WITH {_MATCHED} SELECT * FROM matched")
def matching_routes(spark, root):
    return workers.match_routes(_requests(spark, root), _agents(spark))


@query("selected_agents", "J11", f"""
    WITH {_MATCHED}, best AS (SELECT *, row_number() OVER (PARTITION BY domain, tool
        ORDER BY priority, agent_id) AS n FROM matched)
    SELECT o.o_orderkey, b.agent_id FROM orders o JOIN best b ON b.n = 1
        AND b.domain = o.o_orderstatus AND b.tool = o.o_orderpriority""")
def selected_agents(spark, root):
    """The agent of every order, looked up through the distinct requests."""
    asked = _requests(spark, root)
    return asked.join(workers.select_agent(asked, _agents(spark)), ["domain", "tool"]).select(
        "o_orderkey", "agent_id")


def _offers(spark, root):
    """Customers as workers: the order priorities they have placed are their capabilities."""
    return read_table(spark, root, "orders").groupBy("o_custkey").agg(
        F.collect_set("o_orderpriority").alias("capabilities")).select(
        F.col("o_custkey").alias("worker_id"), "capabilities")


def _needs(spark, root):
    """Days as requests: the priorities of the finished orders of a day."""
    return read_table(spark, root, "orders").groupBy("o_orderdate").agg(F.collect_set(
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("required"))


def _worker_health(spark, root):
    segment = F.col("c_mktsegment")
    return read_table(spark, root, "customer").select(
        F.col("c_custkey").alias("worker_id"),
        F.when(F.col("c_acctbal") < 0, F.lit("unhealthy")).when(
            segment == "BUILDING", F.lit("unknown")).otherwise(F.lit("healthy")).alias("status"),
        F.when(segment != "MACHINERY", F.abs(F.col("c_acctbal")) / 1000)
        .alias("latency_seconds"))


_SETS = f"""offers AS (SELECT o_custkey AS worker_id, list_sort(list_distinct(list(
        {_KEY.format('o_orderpriority')}))) AS offered FROM orders GROUP BY 1),
    needs AS (SELECT DISTINCT list_sort(list_distinct(coalesce(list({_KEY.format(
        'o_orderpriority')}) FILTER (WHERE o_orderstatus = 'F'), []))) AS needed
        FROM orders GROUP BY o_orderdate),
    fits AS (SELECT n.needed, o.worker_id FROM needs n JOIN offers o
        ON list_has_all(o.offered, n.needed))"""


@query("capability_matches", "J12 M19 O6", f"""
    WITH {_SETS} SELECT array_to_string(needed, ' ') AS needed, count(*) AS workers,
        min(worker_id) AS first_worker, sum(worker_id)::BIGINT AS ids FROM fits GROUP BY 1""")
def capability_matches(spark, root):
    out = workers.match_counts(
        _needs(spark, root), _offers(spark, root),
        ("first_worker", F.min("worker_id"), F.min("first_worker")), ("ids", F.sum("worker_id"), F.sum("ids")))
    return out.withColumn("needed", F.array_join("needed", " "))


def _best_sql(unknown):
    return f"""WITH {_SETS}, h AS (SELECT c_custkey AS worker_id, CASE WHEN c_acctbal < 0 THEN NULL
            WHEN c_mktsegment = 'BUILDING' THEN {1 if unknown else 'NULL'} ELSE 0 END AS p,
            CASE WHEN c_mktsegment <> 'MACHINERY' THEN abs(c_acctbal) / 1000 END AS latency
        FROM customer),
    ranked AS (SELECT f.needed, f.worker_id, row_number() OVER (PARTITION BY f.needed
        ORDER BY h.p, h.latency NULLS LAST, f.worker_id) AS n
        FROM fits f JOIN h USING (worker_id) WHERE h.p IS NOT NULL)
    SELECT array_to_string(n.needed, ' ') AS needed, r.worker_id FROM needs n
    LEFT JOIN ranked r ON r.needed = n.needed AND r.n = 1"""


def _best(spark, root, unknown):
    out = workers.best_candidate(_needs(spark, root), _offers(spark, root),
                                 _worker_health(spark, root), unknown)
    return out.select(F.array_join("needed", " ").alias("needed"), "worker_id")


@query("best_workers", "J13", _best_sql(False))
def best_workers(spark, root):
    return _best(spark, root, False)


@query("best_workers_allow_unknown", "J13", _best_sql(True))
def best_workers_allow_unknown(spark, root):
    return _best(spark, root, True)


# --- artifacts -----------------------------------------------------------------------------------

def registrations(spark, root):
    k = F.get_json_object("props", "$.k").cast("int")
    digest = F.sha2((k % 9).cast("string"), 256)
    return read_table(spark, root, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.when(k % 2 == 0, F.concat(F.lit("C:\\out\\f"), k.cast("string"), F.lit(".TXT")))
        .when(k % 10 == 7, F.lit("///")).otherwise(F.concat(
            F.lit("/data/f"), k.cast("string"), F.lit(".csv/"))).alias("path"),
        F.when(k % 10 == 9, F.lit("xyz")).when(k % 10 == 8, F.concat(
            F.lit("g"), F.substr(digest, F.lit(2), F.lit(63)))).when(
            k % 3 == 0, F.concat(F.lit(" "), F.upper(digest))).otherwise(digest).alias("sha256"),
        F.when(F.col("event_type") == "error", F.lit("0")).when(k == 50, F.lit("many"))
        .otherwise(F.floor(F.col("value") + 1).cast("string")).alias("size_bytes"),
        F.col("event_id").alias("registered_at"))


REGS = """raw_regs AS (SELECT 'job-' || user_id AS job_id, json_extract_string(props, '$.k')::INT
        AS k, event_type, value, event_id AS registered_at FROM events),
    regs AS (SELECT *, sha256((k % 9)::VARCHAR) AS digest, CASE WHEN k % 2 = 0
        THEN 'f' || k || '.TXT' WHEN k % 10 = 7 THEN '' ELSE 'f' || k || '.csv' END AS filename
        FROM raw_regs),
    checked AS (SELECT *, CASE WHEN event_type = 'error' THEN 'artifact is empty'
        WHEN k = 50 THEN 'size_bytes is invalid'
        WHEN k % 10 = 9 THEN 'sha256 must have 64 hexadecimal characters'
        WHEN k % 10 = 8 THEN 'sha256 has non-hexadecimal characters'
        WHEN filename = '' THEN 'filename cannot be determined' END AS error FROM regs),
    good AS (SELECT *, row_number() OVER (PARTITION BY job_id, digest ORDER BY registered_at)
        AS n, count(*) OVER (PARTITION BY job_id, digest) AS c FROM checked
        WHERE error IS NULL)"""


@query("artifact_checks", "A17 H10 M17", f"""
    WITH {REGS} SELECT registered_at, filename, error FROM checked""")
def artifact_checks(spark, root):
    return artifacts.clean_registrations(registrations(spark, root)).select(
        "registered_at", "filename", "error")


@query("artifact_first", "A17", f"""
    WITH {REGS} SELECT job_id, 'sha256:' || digest AS artifact_id, filename, registered_at,
        c - 1 AS duplicates FROM good WHERE n = 1""")
def artifact_first(spark, root):
    return artifacts.dedupe_artifacts(registrations(spark, root), "registered_at").select(
        "job_id", "artifact_id", "filename", "registered_at", "duplicates")


@query("artifact_duplicates", "A17", f"""
    WITH {REGS} SELECT registered_at, n = 1 AS created, n > 1 AS duplicate FROM good""")
def artifact_duplicates(spark, root):
    return artifacts.flag_duplicates(registrations(spark, root), "registered_at").select(
        "registered_at", "created", "duplicate")


@query("validate_files", "T13 H10", f"""
    SELECT event_id, CASE WHEN value <= 1 THEN '{vocab.ARTIFACT_MISSING}'
        WHEN event_type = 'view' THEN '{vocab.ARTIFACT_NO_FILE}'
        WHEN event_type = 'error' THEN '{vocab.ARTIFACT_EMPTY}'
        WHEN user_id % 3 = 0 THEN '{vocab.ARTIFACT_EXTENSION}.Log'
        WHEN user_id % 3 = 1 AND user_id % 2 = 0 THEN '{vocab.ARTIFACT_EXTENSION}' END
        AS error, NOT (value > 1 AND event_type NOT IN ('view', 'error')
        AND (user_id % 3 = 0 OR (user_id % 3 = 1 AND user_id % 2 = 0))) AS extension_valid
    FROM events""")
def validate_files(spark, root):
    u = F.col("user_id")
    listing = read_table(spark, root, "events").select(
        "event_id", F.when(u % 3 == 0, F.lit("/a/run.1/out.Log")).when(
            u % 3 == 2, F.lit("b.tar.PDB")).when(u % 2 == 0, F.lit("/x.y/.pdb"))
        .otherwise(F.lit("c.gro")).alias("path"),
        (F.col("value") > 1).alias("exists"), (F.col("event_type") != "view").alias("is_file"),
        F.when(F.col("event_type") == "error", 0).otherwise(10).alias("size_bytes"))
    return artifacts.validate_files(listing, ("pdb", ".GRO")).select(
        "event_id", "error", "extension_valid")


@query("normalized_lists", "O6 H2", f"""
    SELECT user_id, array_to_string(list_sort(list_distinct(list({_KEY.format(
        "trim(event_type || ' X-' || (user_id % 3))")}))), ',') AS names FROM events GROUP BY 1""")
def normalized_lists(spark, root):
    name = F.concat(F.lit("  "), F.initcap("event_type"), F.lit(" x-"),
                    (F.col("user_id") % 3).cast("string"), F.lit("\t"))
    sets = read_table(spark, root, "events").groupBy("user_id").agg(
        F.collect_set(name).alias("names"))
    return sets.select("user_id", F.array_join(tx.normalize_list(F.col("names")), ",")
                       .alias("names"))
