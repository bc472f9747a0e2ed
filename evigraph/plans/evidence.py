"""A batch of questions, from routing to context, as one DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..operators import graph, knn, rerank, route
from ..session import cut_lineage


def retrieve(questions: DataFrame, vectors: DataFrame, payload: DataFrame, k: int = 5,
             max_distance: float = 0.85, metric: str = "l2_squared", approx: bool = False,
             **filters) -> DataFrame:
    """Nearest evidence of every question: hits joined with their text and metadata.

    ``questions(query_id, embedding)``, ``vectors(id, embedding, filter fields)`` and
    ``payload(id, …)``. The filter runs before the search, the distance limit after it, so a
    question may get fewer than ``k`` hits. Text is fetched for the hits only.
    """
    allowed = knn.metadata_filter(vectors, **filters)
    # At most k short rows per question: stored, so that the search runs once however often hits are used.
    hits = cut_lineage(knn.threshold(knn.knn(questions, allowed, k, metric, approx), max_distance), "found")
    return hits.join(payload, "id")


def answer_context(questions: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame,
                   aliases=None, patterns=None, tool_map=None, source_map=None,
                   domain: str | None = None, max_depth: int = 3,
                   mode: str = "auto") -> DataFrame:
    """One row per question: decision, seeds, edges and the assembled context.

    Graph work is done only for questions routed to the graph. Questions without hits keep
    their routing decision and get a NULL context.
    """
    decided = route.route(questions, aliases, patterns, mode)
    # At most k rows per question, used twice below; their texts are read once, for the contexts.
    found = cut_lineage(hits.drop("text"), "hits")
    answered = found.select("query_id").distinct()
    to_graph = decided.where(F.col("selected_mode") == "graph").select(
        "query_id", "question").join(answered, "query_id", "left_semi")
    graph_hits = found.join(to_graph.select("query_id"), "query_id", "left_semi")
    seeds = cut_lineage(graph.seed_nodes(
        to_graph, graph_hits, nodes,
        vocab.ALIASES if aliases is None else aliases,
        vocab.TOOL_NODES if tool_map is None else tool_map,
        vocab.SOURCE_NODES if source_map is None else source_map, domain), "seeds")
    # The graph part of a context is long and the same for all questions with the same seeds: made once
    # for each set of seeds, and joined last, so that whole contexts are not shuffled.
    members, sets = graph.seed_sets(seeds)
    lines = cut_lineage(rerank.graph_text(graph.graph_context(sets, nodes, edges, domain, max_depth)), "lines") \
        .withColumnRenamed("query_id", "seed_set")
    asked = decided.join(members, "query_id", "left").join(rerank.assemble_context(hits), "query_id", "left")
    # questions without seeds have a key of their own, which no set has
    asked = asked.withColumn("seed_set", F.coalesce("seed_set", F.concat(F.lit("none "), F.col("query_id").cast("string"))))
    return asked.join(lines, "seed_set", "left").select(
        *decided.columns, "seeds", F.coalesce("graph_edges", F.lit(0)).alias("graph_edges"),
        F.concat("context", F.coalesce("_g", F.lit(""))).alias("context"))


def reranked_context(questions: DataFrame, hits: DataFrame, keep: int = 4) -> DataFrame:
    """Numbered evidence blocks of the best reranked hits of every question."""
    best = rerank.rerank(questions, hits, keep=keep)
    return rerank.assemble_context(best, style="evidence", order="rerank")
