"""Validation, metadata, identity and outcome of document ingestion."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..session import rule_rows

TEXT_FIELDS = ("source", "domain", "subdomain", "tool", "version", "visibility",
               "document_type", "document_sha256")


# --- validation and metadata ----------------------------------------------------

def standard_checks() -> list[tuple[str, Column]]:
    """(reason, condition under which a row is rejected), tried in this order."""
    return [
        ("text is blank", tx.is_blank("text")),
        ("domain is blank", tx.is_blank("domain")),
        ("source is blank", tx.is_blank("source")),
        ("subdomain is blank", tx.is_blank("subdomain")),
        ("visibility is not private or public",
         ~F.lower(tx.or_empty("visibility")).isin(*vocab.VISIBILITIES)),
        ("document_type is blank", tx.is_blank("document_type")),
    ]


def with_reject_reason(df: DataFrame, checks=None) -> DataFrame:
    """Adds ``reject_reason``: the first failing check, or NULL."""
    checks = standard_checks() if checks is None else checks
    return df.withColumn("reject_reason", F.coalesce(
        *[F.when(condition, F.lit(reason)) for reason, condition in checks]))


def split_rejects(df: DataFrame, checks=None) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected rows with their reason."""
    tagged = with_reject_reason(df, checks)
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.where(F.col("reject_reason").isNotNull()))


def index_metadata(chunks: DataFrame) -> DataFrame:
    """Plain index metadata: missing text becomes '', missing numbers become 0."""
    return chunks.select(
        "chunk_id", "chunk_text",
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("source", "domain")],
        *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c)
          for c in ("page", "chunk_index", "character_count")])


def ingest_metadata(chunks: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """The typed metadata columns stored beside every vector.

    Text fields are trimmed, visibility is lower-cased, a missing tool or version is ''.
    ``character_count`` falls back to the length of the text.
    """
    def number(c):
        return F.coalesce(F.col(c).cast("int"), F.lit(0))
    stored = number("character_count")
    return chunks.select(
        "chunk_id", "chunk_text",
        *[tx.or_empty(c).alias(c) for c in TEXT_FIELDS if c not in ("visibility",)],
        F.lower(tx.or_empty("visibility")).alias("visibility"),
        number("page").alias("page"), number("chunk_index").alias("chunk_index"),
        F.when(stored != 0, stored).otherwise(F.char_length("chunk_text")).alias(
            "character_count"),
        F.lit(size).alias("chunk_size_setting"), F.lit(overlap).alias("chunk_overlap_setting"))


# --- identity -------------------------------------------------------------------------

def _tagged(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """One row per (document, chunk) with flags for the side it occurs on.

    The union is grouped by chunk id, so a document with very many chunks stays spread out.
    """
    key = ["document_sha256", "chunk_id"]
    both = (expected.select(*key, F.lit(1).alias("e"), F.lit(0).alias("x"))
            .unionAll(existing.select(*key, F.lit(0), F.lit(1))))
    return both.groupBy(*key).agg(F.max("e").alias("e"), F.max("x").alias("x"))


def missing_chunks(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Expected chunks that are not stored yet; only these need embedding."""
    return expected.join(existing.select("document_sha256", "chunk_id"),
                         ["document_sha256", "chunk_id"], "left_anti")


def layout_conflicts(expected: DataFrame, existing: DataFrame) -> DataFrame:
    """Stored chunks of an expected document that the current layout does not produce."""
    return (existing.join(expected.select("document_sha256").distinct(),
                          "document_sha256", "left_semi")
            .join(expected.select("document_sha256", "chunk_id"),
                  ["document_sha256", "chunk_id"], "left_anti"))


def verify_ids(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Per document whether the stored id set equals the expected one."""
    return _tagged(expected, stored).groupBy("document_sha256").agg(
        F.sum("e").alias("expected"), F.sum("x").alias("stored"),
        F.sum(F.when(F.col("e") != F.col("x"), 1).otherwise(0)).alias("unmatched"),
        (F.min(F.col("e") + F.col("x")) == 2).alias("verified"))


def ingest_outcome(expected: DataFrame, existing: DataFrame, batch: int = 32) -> DataFrame:
    """Per document: created, resumed or duplicate, and the chunk counts."""
    counts = _tagged(expected, existing).groupBy("document_sha256").agg(
        F.sum("e").alias("chunks_total"),
        F.sum("x").alias("chunks_preexisting"),
        F.sum(F.when((F.col("e") == 1) & (F.col("x") == 0), 1).otherwise(0))
        .alias("chunks_indexed"),
        F.sum(F.when((F.col("e") == 0) & (F.col("x") == 1), 1).otherwise(0)).alias("_other"))
    return (
        counts.where(F.col("chunks_total") > 0)
        .withColumn("status", F.when(F.col("_other") > 0, F.lit("conflict"))
                    .when(F.col("chunks_indexed") == 0, F.lit("duplicate"))
                    .when(F.col("chunks_preexisting") > 0, F.lit("resumed"))
                    .otherwise(F.lit("created")))
        .withColumn("batches", F.ceil(F.col("chunks_indexed") / F.lit(batch)))
        .drop("_other")
    )


# --- totals and profiles ----------------------------------------------------------------

def ingest_totals(chunks: DataFrame) -> DataFrame:
    """Chunks per file, files and chunks per domain, and the grand total in one pass."""
    per_file = chunks.groupBy("domain", "source").agg(F.count("*").alias("chunks"))
    return per_file.rollup("domain", "source").agg(
        F.count("*").alias("files"), F.sum("chunks").alias("chunks"),
        F.grouping_id().alias("level"))


def metadata_profile(df: DataFrame, *fields: str) -> DataFrame:
    """Distinct values of every field, one row per (field, value) with its row count."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        for f in fields]))
    return (df.select(pairs.alias("p")).select("p.*")
            .groupBy("field", "value").agg(F.count("*").alias("rows")))


def indexing_rate(log: DataFrame, batch: int = 16) -> DataFrame:
    """Batches and chunks per second of a run log (chunks, seconds)."""
    seconds = F.round("seconds", 3)
    return (log.withColumn("batches", F.ceil(F.col("chunks") / F.lit(batch)))
            .withColumn("chunks_per_second", F.when(
                seconds > 0, F.round(F.col("chunks") / seconds, 3)).otherwise(F.lit(0.0))))


# --- metadata migration ---------------------------------------------------------------------

def enrich(df: DataFrame, updates, fields: tuple[str, ...]) -> DataFrame:
    """Set ``fields`` for rows of the listed sources; adds ``needs_update``.

    ``updates`` rows are (source, expected_count, value of each field), a source at most once.
    They are parameters and become one constant map in the scan: nothing is joined and no
    source can be a hot key.
    """
    rows = rule_rows(updates, ("source", "expected_count", *fields))
    record = ", ".join(f"`{n}`: string" for n in range(len(fields)))
    known = F.from_json(F.lit(json.dumps({r[0]: {str(n): r[n + 2] for n in range(len(fields))} for r in rows})),
                        f"map<string, struct<{record}>>")
    hit = F.coalesce(F.map_contains_key(known, F.col("source")), F.lit(False))
    new = {field: F.when(hit, known[F.col("source")][str(n)]).otherwise(F.col(field))
           for n, field in enumerate(fields)}
    changed = reduce(lambda a, b: a | b, [~F.col(f).eqNullSafe(new[f]) for f in fields])
    return df.withColumn("needs_update", changed).withColumns(new)


def enrich_report(df: DataFrame, updates, fields: tuple[str, ...],
                  apply: bool = False) -> DataFrame:
    """Preflight per source: rows found against expected, and rows that would change."""
    spark = df.sparkSession
    rows = rule_rows(updates, ("source", "expected_count", *fields))
    wanted = spark.createDataFrame([(r[0], int(r[1])) for r in rows],
                                   "source string, expected_count long")
    found = (enrich(df, rows, fields).where(F.col("source").isin(*[r[0] for r in rows]))
             .groupBy("source").agg(
                 F.count("*").alias("records_found"),
                 F.sum(F.col("needs_update").cast("int")).alias("records_requiring_update")))
    out = wanted.join(found, "source", "left").na.fill(0)
    need = F.col("records_requiring_update")
    return (out.withColumn("preflight_ok", F.col("records_found") == F.col("expected_count"))
            .withColumn("already_current", need == 0)
            .withColumn("records_updated", need if apply else F.lit(0).cast("long")))


def apply_enrichment(df: DataFrame, updates, fields: tuple[str, ...]) -> DataFrame:
    """Enriched rows; stops before any change when a source has an unexpected row count."""
    bad = enrich_report(df, updates, fields).where(~F.col("preflight_ok")).collect()
    if bad:
        raise RuntimeError(
            "record count differs from the expected one: " + ", ".join(
                f"{r['source']} expected {r['expected_count']} found {r['records_found']}"
                for r in bad))
    return enrich(df, updates, fields).drop("needs_update")
