import random

import pytest
from pyspark.sql import functions as F

from evigraph import vocab
from evigraph.operators import artifacts, jobs, workers


def test_transition_table():
    assert len(vocab.TRANSITIONS) == 23
    assert not {a for a, _ in vocab.TRANSITIONS} & set(vocab.TERMINAL_STATES)


@pytest.mark.parametrize("parts", [1, 5])
def test_replay_rejects_illegal_steps(spark, parts):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else f"j{rng.randint(0, 5)}", i // 2, i,
             rng.choice(vocab.JOB_STATES[:5] * 3 + vocab.JOB_STATES[5:])) for i in range(300)]
    allowed = set(vocab.TRANSITIONS)
    want = {}
    for job, _, _, target in rows:
        state, ok, bad = want.get(job, (None, 0, 0))
        legal = state is None or state == target or (state, target) in allowed
        want[job] = (target, ok + 1, bad) if legal else (state, ok, bad + 1)
    df = spark.createDataFrame(rows, "job_id string, ts long, seq long, state string")
    got = jobs.replay_states(df, ["ts", "seq"], parts=parts)
    assert {r["job_id"]: (r["state"], r["accepted"], r["rejected"]) for r in got.collect()} == want
    bad = jobs.illegal_transitions(df, ["ts", "seq"])
    assert all((r["previous"], r["state"]) not in allowed for r in bad.collect())


@pytest.mark.parametrize("text,kind", [
    ("No Such File or directory", "PERMANENT"), ("Connection refused by host", "TRANSIENT"),
    ("broken pipe: file not found", "PERMANENT"), ("strange", "UNKNOWN"), (None, "UNKNOWN")])
def test_failure_kinds(spark, text, kind):
    row = jobs.classify_failures(spark.createDataFrame([(text,)], "message string")).first()
    assert row["failure_type"] == kind and row["retryable"] == (kind == "TRANSIENT")


def test_results_and_retries(spark):
    df = spark.createDataFrame([
        (1, "completed", 0, None, None, None, 1), (2, " COMPLETED ", None, None, None, None, 1),
        (3, "timeout", None, None, None, None, 1), (4, "failed", 2, None, "Connection reset", "x", 2),
        (5, "completed", 1, "", "", "", 1), (6, "timeout", 1, None, None, None, 3),
        (7, "timeout", 1, None, None, None, 0)],
        "id int, status string, return_code int, error string, stderr string, stdout string, attempt int")
    out = {r["id"]: r for r in jobs.retry_decision(jobs.classify_results(df), 3, 1.0, 30.0).collect()}
    assert [out[i]["failure_type"] for i in range(1, 8)] == [
        None, None, "TIMEOUT", "TRANSIENT", "UNKNOWN", "TIMEOUT", "TIMEOUT"]
    assert [(out[i]["retry"], out[i]["delay_seconds"]) for i in (3, 4, 5, 6)] == [
        (True, 1.0), (True, 2.0), (False, 0.0), (False, 0.0)]
    assert out[4]["raised_message"] == "Connection reset"
    assert out[5]["raised_message"] == "Failure could not be classified safely."
    assert "greater than zero" in out[7]["retry_reason"]
    with pytest.raises(ValueError):
        jobs.retry_decision(df, max_attempts=0)


def test_stale_and_recovery(spark):
    df = spark.createDataFrame([
        ("a", "RUNNING", "2024-01-01 00:00:00"), ("b", "RUNNING", "2024-01-01 00:05:01"),
        ("c", "VALIDATING", None), ("d", "RUNNING", "junk"), ("e", "QUEUED", "2023-01-01 00:00:00"),
        ("f", "COMPLETED", "2023-01-01 00:00:00")], "job_id string, status string, updated_at string")
    as_of = F.lit("2024-01-01 00:05:00").cast("timestamp")
    stale = jobs.stale_jobs(df, as_of)
    assert {r["job_id"]: r["stale_age_seconds"] for r in stale.collect()} == {
        "a": 300.0, "c": None, "d": float("inf")}
    assert jobs.stale_jobs(df, as_of, 0, True).count() == 4
    versions, events = jobs.mark_recovery(stale, as_of)
    assert {r["status"] for r in versions.collect()} == {"RECOVERY_REQUIRED"}
    assert events.where("previous_state = 'VALIDATING' AND event = 'RECOVERY_DETECTED'").count() == 1


def test_listing(spark):
    df = spark.createDataFrame([(f"j{i}", "QUEUED" if i % 2 else "FAILED", "d", i) for i in range(6)],
                               "job_id string, status string, domain string, created_at int")
    assert [r["job_id"] for r in jobs.list_jobs(df, 2, status="", domain="d").collect()] == ["j5", "j4"]
    assert [r["job_id"] for r in jobs.fifo(df).collect()] == ["j1", "j3", "j5"]
    assert jobs.count_jobs(df, status="FAILED").first()["jobs"] == 3
    for bad in (lambda: jobs.list_jobs(df, 0), lambda: jobs.fifo(df, 0), lambda: jobs.list_jobs(df, colour="x")):
        with pytest.raises(ValueError):
            bad()


def test_routes(spark):
    agents = spark.createDataFrame([
        ("b", ["Chem:RD-Kit", "chem:rd kit"], 10), ("a", ["chem:*"], 10), ("z", ["*:*"], 90)],
        "agent_id string, routes array<string>, priority int")
    asked = spark.createDataFrame([("chem", "rd_kit"), ("chem", "x"), ("cad", "y")], "domain string, tool string")
    chosen = {(r["domain"], r["tool"]): r["agent_id"] for r in workers.select_agent(asked, agents).collect()}
    assert chosen == {("chem", "rd_kit"): "a", ("chem", "x"): "a", ("cad", "y"): "z"}
    assert workers.match_routes(asked, agents).count() == 6


def test_capabilities_and_best_worker(spark):
    offers = spark.createDataFrame([
        ("w1", ["GROMACS", "remote-command"]), ("w2", ["gromacs"]), ("w3", ["gromacs", "blender"]), ("w4", [])],
        "worker_id string, capabilities array<string>")
    health = spark.createDataFrame([("w1", "healthy", 0.5), ("w2", "healthy", None), ("w3", "unknown", 0.1),
                                    ("w4", "timeout", 0.1)],
                                   "worker_id string, status string, latency_seconds double")
    asked = spark.createDataFrame([(["gromacs"],), (["Remote Command", "gromacs"],), (["blender"],), ([],),
                                   (["nothing"],), (["gromacs"],)], "required array<string>")
    pairs = {}
    for r in workers.match_sets(asked, offers).collect():
        pairs.setdefault(tuple(r["needed"]), set()).add(r["worker_id"])
    assert pairs == {("gromacs",): {"w1", "w2", "w3"}, ("gromacs", "remote_command"): {"w1"},
                     ("blender",): {"w3"}, (): {"w1", "w2", "w3", "w4"}}
    def best(unknown):
        out = workers.best_candidate(asked, offers, health, unknown).collect()
        return {tuple(r["needed"]): r["worker_id"] for r in out}
    assert best(False) == {("gromacs",): "w1", ("gromacs", "remote_command"): "w1", ("blender",): None,
                           (): "w1", ("nothing",): None}
    assert best(True)[("blender",)] == "w3"


def test_artifacts(spark):
    good = "ab" * 32
    df = spark.createDataFrame([
        ("j", "C:\\r\\a.txt", good.upper(), "5", 1), ("j", "/r/b.txt", " " + good, "5", 2),
        ("j", "/r/c.txt", "12", "5", 3), ("j", "/r/d.txt", good[:-1] + "g", "5", 4), ("j", "/", good, "5", 5),
        ("j", "/r/e", good, "0", 6), ("j", "/r/e", good, "x", 7), ("k", "/r/b.txt", good, "5", 8)],
        "job_id string, path string, sha256 string, size_bytes string, at int")
    first = {r["job_id"]: (r["filename"], r["duplicates"]) for r in artifacts.dedupe_artifacts(df, "at").collect()}
    assert first == {"j": ("a.txt", 1), "k": ("b.txt", 0)}
    flags = {r["at"]: r["created"] for r in artifacts.flag_duplicates(df, "at").collect()}
    assert flags == {1: True, 2: False, 8: True}
    assert artifacts.clean_registrations(df).where("error IS NOT NULL").count() == 5
