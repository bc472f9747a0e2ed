"""Reading document corpora from a directory tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx


def read_corpus(spark: SparkSession, root: str, exts=vocab.SUFFIXES,
                domains=vocab.DOMAINS) -> DataFrame:
    """Files below ``root`` with a wanted suffix; see ``corpus_listing``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "content"))
    return corpus_listing(files, root, exts, domains)


def corpus_listing(files: DataFrame, root: str, exts=vocab.SUFFIXES,
                   domains=vocab.DOMAINS) -> DataFrame:
    """Files (path, content) as path, source, domain, extension, sha256, length, content.

    Suffixes are compared in lower case. The first folder below ``root`` is the domain.
    Content stays binary, so the hash is the hash of the bytes. Sort by ``path`` for the
    listing order.
    """
    base = root.rstrip("/")
    tail = F.substring_index("path", base, -1)
    suffix = tx.extension(F.col("path"))
    return files.where(suffix.isin(*["." + e.lower() for e in exts])).select(
        "path", tx.file_name(F.col("path")).alias("source"),
        F.regexp_extract(tail, r"^/+([^/]+)/", 1).alias("domain"),
        suffix.alias("extension"), tx.sha256(F.col("content")).alias("document_sha256"),
        F.octet_length("content").cast("long").alias("length"), "content",
    ).withColumn("known_domain", F.col("domain").isin(*domains))


def ingest_domain(corpus: DataFrame, domain: str, domains=vocab.DOMAINS) -> DataFrame:
    """Files of one domain; an unknown domain is an error."""
    if domain not in domains:
        raise ValueError(f"unsupported domain: {domain}; expected one of {sorted(domains)}")
    return corpus.where(F.col("domain") == domain)


def load_pages(files: DataFrame) -> DataFrame:
    """Text files as one-page documents: page 1, stripped text, character count.

    Bytes that are not UTF-8 become replacement characters.
    """
    text = tx.strip(F.make_valid_utf8(F.col("content").cast("string")))
    return (files.withColumns({"page": F.lit(1), "text": text}).drop("content")
            .withColumn("character_count", F.char_length("text")))


def load_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strict loading: blank files and invalid UTF-8 go to the second, rejected, table."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    tagged = files.withColumn("text", text).withColumn(
        "reject_reason",
        F.when(~valid, F.lit("not valid UTF-8"))
        .when(tx.is_blank("text"), F.lit("document is empty"))).drop("content")
    return (tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.where(F.col("reject_reason").isNotNull()).drop("text"))


def document_table(files: DataFrame) -> DataFrame:
    """Loaded documents with their pages nested: one row per file."""
    pages = load_pages(files)
    return pages.select(
        "path", "source", "extension", "domain", "document_sha256",
        F.lit(1).alias("page_count"),
        F.array(F.struct("page", "text", "character_count")).alias("pages"))
