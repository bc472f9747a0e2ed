"""Ingestion end to end: files to checked chunks to vectors, as one function for batch and stream.

The vector table is partitioned by the first two hexadecimal digits of the document's SHA-256,
so a batch reads only the folders its own documents can be in, not all ids of the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as tx
from ..operators import ingest
from ..operators.chunking import content_chunks
from ..operators.embed import embed
from ..session import cut_lineage

PREFIX = "prefix"
_DOCUMENT = ["document_sha256", "source"]
_KEPT = ("chunk_id", "document_sha256", "source", "domain", "page", "chunk_index", "character_count",
         "chunk_text", "embedding")


@dataclass(frozen=True)
class Ingested:
    """Tables of one run: status per document, rejected documents with their reason, and whether
    the stored ids of a document are the expected ones."""
    outcome: DataFrame
    rejects: DataFrame
    verified: DataFrame


def stored_chunks(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The vector table, or an empty one; a first empty batch makes the folder exist."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/{PREFIX}=__")
    return spark.read.schema(StructType([*schema.fields]).add(PREFIX, "string")).parquet(target)


def chunked(docs: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Content-identified chunks of (source, domain, text) documents, one row per id."""
    pages = docs.withColumn("document_sha256", tx.sha256(F.col("text"))).withColumn("page", F.lit(1))
    return content_chunks(pages, size, overlap).dropDuplicates(["chunk_id"])


def ingest_documents(docs: DataFrame, target: str, model: Callable | None = None, size: int = 1200,
                     overlap: int = 200, checks=None) -> Ingested:
    """Store the chunks and vectors of ``docs`` (source, domain, text) that are not stored yet.

    Documents that fail a check, or of which another layout is stored, are rejected as a whole;
    only chunks that are missing are embedded. Running it again adds nothing. A document is a
    content under a source: stored chunks of other documents, also of the same content from
    another source, say nothing about it.
    """
    spark = docs.sparkSession
    checks = [("text is blank", tx.is_blank("text")), ("domain is blank", tx.is_blank("domain")),
              ("source is blank", tx.is_blank("source"))] if checks is None else checks
    good, bad = ingest.split_rejects(docs, checks)
    expected = cut_lineage(chunked(good, size, overlap), "expected")
    schema = embed(expected.limit(0), "chunk_text", model).select(*_KEPT).schema
    prefix = F.substring("document_sha256", 1, 2)
    touched = [r[0] for r in expected.select(prefix.alias("p")).distinct().collect()]    # 256 at most

    def stored(of: DataFrame) -> DataFrame:
        rows = stored_chunks(spark, target, schema).where(F.col(PREFIX).isin(*touched))
        # ids are a small share of many files, which a task opens one after the other; a semi-join of
        # the distinct documents, in a form that is not planned below the coalesce
        rows = rows.select(*_DOCUMENT, "chunk_id").coalesce(spark.sparkContext.defaultParallelism)
        return rows.join(of.select(*_DOCUMENT).distinct(), _DOCUMENT)

    before = cut_lineage(stored(expected).select(*_DOCUMENT, "chunk_id").distinct(), "stored")
    conflicts = cut_lineage(ingest.layout_conflicts(expected, before).select(*_DOCUMENT).distinct(), "conflicts")
    accepted = expected.join(conflicts, _DOCUMENT, "left_anti")
    outcome = cut_lineage(ingest.ingest_outcome(expected, before), "outcome")
    # a folder gets one file, as every later batch opens the files of the folders it touches
    missing = ingest.missing_chunks(accepted, before).withColumn(PREFIX, prefix).repartition(PREFIX)
    embed(missing, "chunk_text", model).select(*_KEPT, PREFIX).write.mode("append").partitionBy(PREFIX).parquet(target)
    stopped = expected.join(conflicts, _DOCUMENT, "left_semi").select("source", "domain", "document_sha256") \
        .distinct().withColumn("reject_reason", F.lit("another layout of the document is stored"))
    rejects = bad.select("source", "domain", tx.sha256(F.col("text")).alias("document_sha256"), "reject_reason") \
        .unionByName(stopped)
    return Ingested(outcome, rejects, ingest.verify_ids(accepted, stored(accepted)))


def ingest_stream(stream: DataFrame, target: str, checkpoint: str, model: Callable | None = None,
                  size: int = 1200, overlap: int = 200):
    """The same for every micro-batch of a stream; rejects are kept beside the checkpoint.

    A replayed batch finds its own chunks stored, so delivering a file or a batch twice adds
    nothing. A batch whose stored ids are not the expected ones stops the stream.

    A batch is planned with the adaptive execution of the caller's session, which streams turn off in
    theirs: there is no state here whose partitions must stay as they are, and a small batch
    would otherwise have every step of it in as many tasks as the largest.
    """
    adaptive = "spark.sql.adaptive.enabled"
    wanted = stream.sparkSession.conf.get(adaptive)

    def write(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession.conf
        before = own.get(adaptive)
        own.set(adaptive, wanted)
        try:
            store(batch, batch_id)
        finally:
            own.set(adaptive, before)

    def store(batch: DataFrame, batch_id: int) -> None:
        done = ingest_documents(batch, target, model, size, overlap)
        done.rejects.write.mode("overwrite").parquet(f"{checkpoint}-rejects/batch_id={batch_id}")
        wrong = done.verified.where(~F.col("verified")).limit(1).collect()
        if wrong:
            raise RuntimeError(f"stored chunks differ from the expected ones: {wrong[0]['document_sha256']}")

    return (stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
