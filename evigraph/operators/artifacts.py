"""Artifact registrations and file checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx


def clean_registrations(regs: DataFrame) -> DataFrame:
    """Normalised registrations; adds ``error`` for rows that cannot be registered.

    A hash must be 64 hexadecimal characters, the size positive, the file name not empty.
    """
    digest = F.lower(tx.or_empty("sha256"))
    name = tx.file_name(F.col("path"))
    size = F.col("size_bytes").try_cast("long")
    return regs.withColumns({
        "sha256": digest,
        "artifact_id": F.concat(F.lit("sha256:"), digest),
        "filename": name,
        "error": F.when((size > 0) & digest.rlike("^[0-9a-f]{64}$") & (name != ""), F.lit(None))
        .when(size.isNull(), F.lit("size_bytes is invalid"))
        .when(size <= 0, F.lit("artifact is empty"))
        .when(F.length(digest) != 64, F.lit("sha256 must have 64 hexadecimal characters"))
        .when(~digest.rlike("^[0-9a-f]{64}$"), F.lit("sha256 has non-hexadecimal characters"))
        .when(F.coalesce(name, F.lit("")) == "", F.lit("filename cannot be determined")),
    })


def dedupe_artifacts(regs: DataFrame, *order: str) -> DataFrame:
    """One artifact per (job, content): the first registration, and how many followed it.

    Combined before the shuffle, so many copies of one file under one job cost one row per
    task. ``duplicates`` counts the later registrations.
    """
    good = clean_registrations(regs).where(F.col("error").isNull()).drop("error")
    key = ["job_id", "sha256"]
    rest = [c for c in good.columns if c not in key]
    return good.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"),
        (F.count("*") - 1).alias("duplicates"),
    ).select(*key, *[F.col(f"_first.{c}").alias(c) for c in rest], "duplicates")


def flag_duplicates(regs: DataFrame, *order: str) -> DataFrame:
    """Every valid registration with ``created``: true only for the first of its content."""
    good = clean_registrations(regs).where(F.col("error").isNull()).drop("error")
    key = ["job_id", "sha256"]
    first = good.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    return (good.join(first, key)
            .withColumn("created", F.struct(*order) == F.col("_first"))
            .withColumn("duplicate", ~F.col("created")).drop("_first"))


def validate_files(listing: DataFrame, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """Check a file listing (path, exists, is_file, size_bytes); the first failure is reported."""
    suffix = tx.extension(F.col("path"))
    wanted = [e.lower() if e.startswith(".") else "." + e.lower() for e in extensions or ()]
    good_suffix = suffix.isin(*wanted) if wanted else F.lit(True)
    shown = F.regexp_extract(tx.file_name(F.col("path")), r"^.+(\.[^./]+)$", 1)
    error = (
        F.when(~F.col("exists"), F.lit(vocab.ARTIFACT_MISSING))
        .when(~F.col("is_file"), F.lit(vocab.ARTIFACT_NO_FILE))
        .when(F.col("size_bytes") <= 0, F.lit(vocab.ARTIFACT_EMPTY))
        .when(~good_suffix, F.concat(F.lit(vocab.ARTIFACT_EXTENSION), shown)))
    return (listing.withColumn("error", error)
            .withColumn("extension_valid",
                ~F.startswith(F.coalesce("error", F.lit("")), F.lit("Unexpected")))
            .withColumn("valid", F.col("error").isNull()))
