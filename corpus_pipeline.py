"""A training corpus from the documents table: filtered, deduplicated, redacted and packed.

``STAGES`` lists name and function of each stage. A function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written as Parquet and read again as the next stage's ``docs``.
All stages but the last return the columns of ``docs``. Each stage calls one operator of
``evigraph.llm``, and how it treats nulls, empty texts,
repeated rows, empty tables and extra columns is stated there.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import exact_dedup, near_copies, packing, pii, quality
from evigraph.session import cut_lineage, drop_scratch_path, read_table, scratch_made

VOCABULARY = "byte_bpe_50k.json"

#: Scores of the quality classifier and ids of the tokenizer have no SQL form; see tests/llm.
ORACLE_SQL = None


_USED: list[str] = []         # scratch tables of stages that have run


def _stage(work):
    """A stage that first removes the scratch tables of the stages before it.

    Their results are stored by then, as a stage's ``docs`` are read from what was written.
    """
    @functools.wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles()
        for path in list(_USED):
            if not any(path.rsplit("/", 1)[1] in f for f in files):
                drop_scratch_path(spark, path)
                _USED.remove(path)
        before = set(scratch_made())
        out = work(spark, docs, sf_dir)
        _USED.extend(p for p in scratch_made() if p not in before)
        return out
    return stage


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from the labelled ones among ``docs``."""
    return quality.accept(docs, read_table(spark, sf_dir, "labels"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.survivors(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a shingle similarity of 0.8 the document with the smallest id."""
    return near_copies.representatives(docs)


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    redacted = pii.redact(docs)
    if "n_chars" not in redacted.columns:
        return redacted
    return redacted.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows of 2048."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stored before the next begins."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
