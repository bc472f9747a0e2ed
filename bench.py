"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` how many
times each query is timed after one warm-up run; the median counts.
"""

import json
import os
import platform
import statistics
import sys
import time

from evigraph.plans import catalog
from evigraph.session import build_session

HEADLINE = (
    "evidence_search", "nearest_all", "rerank_evidence", "chunk_simple", "chunk_paged",
    "ingest_outcome", "html_text", "pattern_scan", "extract_relations", "route_default_rules",
    "graph_edges", "traverse_outgoing", "graph_context", "score_answers", "previous_states",
    "failure_streaks", "replay_states", "best_workers", "artifact_first",
)


def timed(spark, run, root) -> float:
    started = time.perf_counter()
    run(spark, root).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = catalog.load()
    seconds = {}
    for name in names:
        run = registry[name].run
        timed(spark, run, root)
        seconds[name] = round(statistics.median(timed(spark, run, root) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "spark": spark.version, "python": platform.python_version()}))
    spark.stop()


if __name__ == "__main__":
    main()
