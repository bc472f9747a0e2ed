"""Rule-driven entities and relations of text chunks, and the curated workflow graphs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..session import cut_lineage, rule_rows
from .graph import merge_edges, merge_nodes

_ENTITY = "array<struct<node_id:string,type:string>>"
_RELATION = "array<struct<source:string,relation:string,target:string>>"


def extract_entities(chunks: DataFrame, rules=None, text_col: str = "text",
                     words: bool = False) -> DataFrame:
    """Adds ``entities``: rules (needle, node_id, type) whose needle is in the lower text.

    One automaton reads each text once, so extraction is a scan: no join and no shuffle.
    Needles match as substrings, or with ``words`` as whole words only.
    """
    rows = rule_rows(vocab.ENTITY_RULES if rules is None else rules,
                     ("needle", "node_id", "type"))
    if not rows:
        return chunks.withColumn("entities", F.array().cast(_ENTITY))
    table = F.from_json(F.lit(json.dumps([{"node_id": i, "type": t} for _, i, t in rows])), _ENTITY)
    found = tx.matching_rules(F.lower(F.col(text_col)), [n for n, _, _ in rows], words)
    return chunks.withColumn("entities", F.array_distinct(F.transform(found, lambda n: F.get(table, n))))


def extract_relations(chunks: DataFrame, rules=None) -> DataFrame:
    """Adds ``relations``: rules (source, relation, target) whose two ends are in the chunk."""
    rows = rule_rows(vocab.RELATION_RULES if rules is None else rules,
                     ("source", "relation", "target"))
    if not rows:
        return chunks.withColumn("relations", F.array().cast(_RELATION))
    ids = F.transform("entities", lambda e: e["node_id"])
    table = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(r).alias("relation"),
                               F.lit(t).alias("target")) for s, r, t in rows])
    return chunks.withColumn("relations", tx.bind(ids, lambda i: F.filter(
        table, lambda r: F.array_contains(i, r["source"]) & F.array_contains(i, r["target"]))))


def node_writes(chunks: DataFrame, seq: str = "seq") -> DataFrame:
    """Node writes of extracted entities; the chunk's domain and source become properties."""
    return chunks.select(
        F.explode("entities").alias("e"), "domain", "source", F.col(seq).alias("seq")
    ).select(
        F.col("e.node_id").alias("id"), F.col("e.type").alias("type"),
        F.create_map(F.lit("domain"), F.col("domain"), F.lit("source"), F.col("source"))
        .alias("properties"), "seq")


def edge_writes(chunks: DataFrame, seq: str = "seq") -> DataFrame:
    """Edge writes of extracted relations; they carry no properties."""
    return chunks.select(
        F.explode("relations").alias("r"), F.col(seq).alias("seq")
    ).select("r.*", F.create_map().cast("map<string,string>").alias("properties"), "seq")


def curated_graph(spark: SparkSession, *domains: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge writes of the curated workflows (all of them by default)."""
    nodes, edges = [], []
    for domain in domains or tuple(vocab.CURATED):
        spec = vocab.CURATED[domain]
        props = {"domain": domain, "source": spec["source"], "curated": "true"}
        if spec["authorized_only"]:
            props["authorized_only"] = "true"
        nodes += [(i, t, props, len(nodes) + n) for n, (i, t) in enumerate(spec["nodes"])]
        edges += [(s, r, t, props, len(edges) + n) for n, (s, r, t) in enumerate(spec["edges"])]
    return (
        spark.createDataFrame(
            nodes, "id string, type string, properties map<string,string>, seq long"),
        spark.createDataFrame(
            edges, "source string, relation string, target string, "
                   "properties map<string,string>, seq long"))


def load_graph(nodes: DataFrame, edges: DataFrame, more_nodes: DataFrame,
               more_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge new writes into stored tables; loading the same writes again changes nothing.

    New writes come after everything stored, so the stored tables are read once for their
    last position.
    """

    def after(old, new):
        top = old.agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("_top")).first()[0]
        return old.unionByName(new.withColumn("seq", F.col("seq") + F.lit(top)))

    return (cut_lineage(merge_nodes(after(nodes, more_nodes)), "nodes"),
            cut_lineage(merge_edges(after(edges, more_edges)), "edges"))
