"""Tables the engine keeps: vectors, graph, jobs, event logs, manifests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "job_id string, event string, timestamp timestamp, state string, attempt int, details string"
)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


ROWS_PER_DOCUMENT = 1000


def _bucket(key: str, rows: int):
    return F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows // ROWS_PER_DOCUMENT)))).alias("bucket")


def json_arrays(records: DataFrame, key: str, record: str, rows: int) -> DataFrame:
    """JSON texts of ``rows`` rows in all put together into arrays of about a thousand, by a hash of the key."""
    return records.groupBy(_bucket(key, rows)).agg(F.concat(
        F.lit("["), F.concat_ws(", ", F.collect_list(record)), F.lit("]")).alias("value"))


def write_documents(documents: DataFrame, path: str) -> None:
    """Rows ``(bucket, value)`` as one file for each; they are written and read in parallel."""
    documents.write.mode("append").partitionBy("bucket").text(path)


def graph_documents(nodes: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """``(bucket, value)``: graph documents of about a thousand elements, each with its nodes and edges."""
    node = F.struct("id", F.struct("id", "type", "properties").alias("n"))
    some_nodes = nodes.groupBy(_bucket("id", rows)).agg(F.map_from_entries(F.collect_list(node)).alias("nodes"))
    edge = F.struct("source", "relation", "target", "properties")
    name = F.concat_ws("\u0001", "source", "relation", "target")
    some_edges = edges.withColumn("_name", name).groupBy(_bucket("_name", rows)).agg(F.collect_list(edge).alias("edges"))
    return some_nodes.join(some_edges, "bucket", "full_outer").select(
        "bucket", F.to_json(F.struct("nodes", "edges")).alias("value"))


# --- keyed tables -------------------------------------------------------------------

def append(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def reset(df: DataFrame, path: str) -> None:
    """Replace a table by an empty one with the same columns."""
    df.limit(0).write.mode("overwrite").parquet(path)


def upsert_by_key(old: DataFrame, new: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Replace or add rows by key: the highest ``seq`` among the new rows wins.

    Only the key of the new rows is compared with the old table, so its payload is not
    sorted or grouped.
    """
    rest = [c for c in new.columns if c not in key]
    newest = new.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(
        *key, *[F.col(f"_r.{c}").alias(c) for c in rest])
    kept = old.join(newest.select(*key), key, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)


def add_missing(df: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Add absent columns and fill NULLs: ``{name: (type, default)}``."""
    for name, (kind, value) in defaults.items():
        default = F.lit(value).cast(kind)
        df = df.withColumn(
            name, F.coalesce(F.col(name).cast(kind), default) if name in df.columns else default)
    return df


JOB_DEFAULTS = {
    "attempt": ("int", 0), "max_attempts": ("int", 3), "last_failure_type": ("string", None),
}


# --- event logs and results ------------------------------------------------------------

def append_events(df: DataFrame, path: str, as_of=None) -> None:
    """Append events as JSON lines; a missing time is set to ``as_of``."""
    if as_of is not None:
        stamp = (F.coalesce(F.col("timestamp"), as_of) if "timestamp" in df.columns else as_of)
        df = df.withColumn("timestamp", stamp)
    df.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_results(details: DataFrame, summary: DataFrame, path: str) -> None:
    """Nested results as JSON and the flat summary as CSV with a header."""
    details.write.mode("overwrite").json(f"{path}/details")
    summary.write.mode("overwrite").option("header", "true").csv(f"{path}/summary")


# --- graph files ----------------------------------------------------------------------

_NODE = "map<string,struct<id:string,type:string,properties:map<string,string>>>"
_EDGE = ("array<struct<source:string,relation:string,target:string,"
         "properties:map<string,string>>>")


def graph_from_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of an exported graph file."""
    doc = (spark.read.schema(f"nodes {_NODE}, edges {_EDGE}")
           .option("multiLine", "true").json(path))
    nodes = doc.select(F.posexplode("nodes").alias("seq", "id", "n")).select(
        "id", "n.type", "n.properties", F.col("seq").cast("long").alias("seq"))
    edges = doc.select(F.posexplode("edges").alias("seq", "e")).select(
        "e.*", F.col("seq").cast("long").alias("seq"))
    return nodes, edges


def graph_to_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Export as JSON lines, one element per line, below ``nodes`` and ``edges``.

    A graph of any size can be written, because no single document has to hold all of it.
    """
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def graph_from_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    props = "properties map<string,string>, seq long"
    return (spark.read.schema(f"id string, type string, {props}").json(f"{path}/nodes"),
            spark.read.schema(f"source string, relation string, target string, {props}")
            .json(f"{path}/edges"))
