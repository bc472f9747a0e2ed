"""Matching of requests with routes and capabilities, and worker health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..session import cut_lineage
from .jobs import latest
from .segments import running_streak


# --- routes -----------------------------------------------------------------------

def route_rows(agents: DataFrame) -> DataFrame:
    """Normalised routes of agents (agent_id, routes, priority), one row per route."""
    return agents.select(
        tx.strip("agent_id").alias("agent_id"), "priority",
        F.explode(tx.normalize_list(F.col("routes"))).alias("route"))


def _request_keys(requests: DataFrame) -> DataFrame:
    """Distinct (domain, tool) requests with the three routes that can serve them."""
    full = tx.name_key(F.concat("domain", F.lit(":"), "tool"))
    distinct = requests.select("domain", "tool").distinct().withColumn("_full", full)
    patterns = F.array(F.col("_full"),
                       F.concat(F.substring_index("_full", ":", 1), F.lit(":*")),
                       F.lit("*:*"))
    return distinct.select("domain", "tool", F.explode(F.array_distinct(patterns)).alias("route"))


def match_routes(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """All agents of every distinct (domain, tool): exact, domain-wide or general routes.

    Three equality lookups instead of a pattern join.
    """
    found = _request_keys(requests).join(route_rows(agents), "route")
    return found.groupBy("domain", "tool", "agent_id").agg(F.min("priority").alias("priority"))


def select_agent(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """The best agent of every distinct (domain, tool): lowest priority, then lowest id.

    Routes are reduced to their best agent before the lookup.
    """
    best = route_rows(agents).groupBy("route").agg(
        F.min(F.struct("priority", "agent_id")).alias("best"))
    return (_request_keys(requests).join(best, "route")
            .groupBy("domain", "tool").agg(F.min("best").alias("best"))
            .select("domain", "tool", "best.agent_id", "best.priority"))


# --- capabilities ------------------------------------------------------------------

def _offer_sets(offers: DataFrame) -> DataFrame:
    return offers.select("worker_id", tx.normalize_list(F.col("capabilities")).alias("offered"))


def _needed_sets(requests: DataFrame) -> DataFrame:
    return requests.select(tx.normalize_list(F.col("required")).alias("needed")).distinct()


def covering_sets(needed: DataFrame, offered: DataFrame) -> DataFrame:
    """Pairs of a needed set and an offered set that contains it.

    Both inputs are distinct sets. Each needed set is looked up by its rarest capability
    only, so a capability that nearly everyone has never drives the join.
    """
    singles = offered.select("offered", F.explode("offered").alias("cap"))
    frequency = singles.groupBy("cap").agg(F.count("*").alias("n"))
    rarest = (
        needed.select("needed", F.explode("needed").alias("cap"))
        .join(frequency, "cap", "left")
        .groupBy("needed").agg(F.min_by("cap", F.struct(
            F.coalesce("n", F.lit(0)), "cap")).alias("cap")))
    some = rarest.join(singles, "cap").where(
        F.size(F.array_except("needed", "offered")) == 0).select("needed", "offered")
    # The empty requirement is one row at most, and it matches every offered set.
    if needed.where(F.size("needed") == 0).isEmpty():
        return some
    return some.unionAll(offered.select(F.array().cast("array<string>").alias("needed"), "offered"))


def match_sets(requests: DataFrame, offers: DataFrame) -> DataFrame:
    """Workers that have every required capability, per distinct requirement."""
    sets = cut_lineage(_offer_sets(offers), "offers")
    pairs = covering_sets(cut_lineage(_needed_sets(requests), "needs"), sets.select("offered").distinct())
    return pairs.join(sets, "offered").select("needed", "worker_id")


def match_counts(requests: DataFrame, offers: DataFrame, *measures) -> DataFrame:
    """Per distinct requirement how many workers fit, and more aggregates over partial ones.

    Workers are counted per offered set before sets are compared, so no row is made for a pair
    of a requirement and a worker. ``measures`` are ``(name, aggregate per set, aggregate)``.
    """
    sets = _offer_sets(offers).groupBy("offered").agg(
        F.count("*").alias("workers"), *[inner.alias(name) for name, inner, _ in measures])
    sets = cut_lineage(sets, "offers")
    pairs = covering_sets(cut_lineage(_needed_sets(requests), "needs"), sets.select("offered"))
    return pairs.join(sets, "offered").groupBy("needed").agg(
        F.sum("workers").alias("workers"), *[outer.alias(name) for name, _, outer in measures])


def best_candidate(requests: DataFrame, offers: DataFrame, health: DataFrame,
                   allow_unknown: bool = False) -> DataFrame:
    """The worker chosen for every distinct requirement; NULL when none is eligible.

    Healthy before unknown, then lower latency (missing last), then id. Workers with equal
    capability sets are reduced to their best one before sets are compared.
    """
    status = F.when(F.col("status") == "healthy", 0)
    if allow_unknown:
        status = status.when(F.col("status") == "unknown", 1)
    order = F.struct(
        F.col("_status"),
        F.coalesce(F.col("latency_seconds").cast("double"), F.lit(float("inf"))).alias("latency"),
        "worker_id")
    best = (
        _offer_sets(offers).join(
            health.select("worker_id", "latency_seconds", status.alias("_status"))
            .where(F.col("_status").isNotNull()), "worker_id")
        .groupBy("offered").agg(F.min(order).alias("best")))
    best = cut_lineage(best, "offers")
    needed = cut_lineage(_needed_sets(requests), "needs")
    chosen = (covering_sets(needed, best.select("offered")).join(best, "offered")
              .groupBy("needed").agg(F.min("best").alias("best")))
    return needed.join(chosen, "needed", "left").select("needed", "best.worker_id")


# --- health ---------------------------------------------------------------------------

def health_status(pings: DataFrame) -> DataFrame:
    """Adds ``health`` and ``message`` from ping results (status, return_code, stdout, stderr)."""
    err, out = (F.nullif(c, F.lit("")) for c in ("stderr", "stdout"))
    timeout = F.coalesce(F.col("status") == "timeout", F.lit(False))
    good = F.coalesce(F.col("return_code") == 0, F.lit(False))
    code = F.coalesce(F.col("return_code").cast("string"), F.lit("None"))
    return pings.withColumns({
        "health": F.when(timeout, F.lit("timeout")).when(good, F.lit("healthy"))
        .otherwise(F.lit("unhealthy")),
        "message": F.when(timeout, F.coalesce(err, F.lit(vocab.BEAT_TIMEOUT)))
        .when(good, F.lit(vocab.BEAT_SUCCESS))
        .otherwise(F.coalesce(err, out, F.concat(
            F.lit(vocab.BEAT_FAILURE), code, F.lit(".")))),
        "hostname": F.when(~timeout & good, F.nullif(tx.or_empty("stdout"), F.lit(""))),
    })


def failure_streaks(beats: DataFrame, order: list[str], key: str = "worker_id") -> DataFrame:
    """Adds ``consecutive_failures`` to every heartbeat; a healthy one resets it to 0."""
    return running_streak(beats, [key], order, F.col("health") == "healthy",
                          "consecutive_failures")


def current_health(beats: DataFrame, order: list[str], key: str = "worker_id") -> DataFrame:
    """Latest heartbeat of every worker with its failure streak."""
    rounded = F.round(F.col("latency_seconds").cast("double"), 6)
    return latest(failure_streaks(beats, order, key), [key], *order).withColumn(
        "latency_seconds", rounded)
