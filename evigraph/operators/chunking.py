"""Overlapping text windows, content identity and the chunk tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx

# Windows cut from one slice of the text. ``substring`` walks the string from its start,
# so slicing first keeps a text of n characters near n * sqrt(n) work instead of n * n.
_SLICE = 64


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("size must be greater than zero")
    if overlap < 0:
        raise ValueError("overlap cannot be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")


def windows(text: Column, size: int, overlap: int) -> Column:
    """``array<struct<number:int,text:string>>`` of stripped windows, blanks included."""
    check_window(size, overlap)
    step = size - overlap

    def last_number(t):
        return F.greatest(F.lit(0), F.ceil(
            (F.char_length(t) - F.lit(size)) / F.lit(step)).cast("int"))

    def slices(t):
        return tx.bind(last_number(t), lambda last: F.transform(
            F.sequence(F.lit(0), F.floor(last / _SLICE).cast("int")),
            lambda b: F.struct(
                b.alias("b"), last.alias("last"),
                F.substring(t, b * (_SLICE * step) + 1, (_SLICE - 1) * step + size).alias("t"))))

    return F.flatten(F.transform(tx.bind(text, slices), lambda s: F.transform(
        F.sequence(F.lit(0), F.least(F.lit(_SLICE - 1), s["last"] - s["b"] * _SLICE)),
        lambda j: F.struct(
            (s["b"] * _SLICE + j).alias("number"),
            tx.strip(F.substring(s["t"], j * step + 1, size)).alias("text"),
        ),
    )))


def chunk(df: DataFrame, size: int = 500, overlap: int = 50,
          numbering: str = "gapped", text_col: str = "text") -> DataFrame:
    """One row per non-blank window; all other columns are kept.

    ``gapped``: a skipped blank window still uses up its 0-based number.
    ``dense``: the text is stripped first and kept windows are numbered 1, 2, ...
    Adds ``chunk_number``, ``position`` (0-based among kept windows) and ``chunk_text``.
    Numbering happens inside the row, so there is no shuffle however uneven documents are.
    """
    if numbering not in ("gapped", "dense"):
        raise ValueError("numbering must be 'gapped' or 'dense'")
    text = F.col(text_col) if numbering == "gapped" else tx.strip(F.col(text_col))
    kept = F.filter(windows(text, size, overlap), lambda w: w["text"] != "")
    others = [c for c in df.columns if c != text_col]
    out = df.select(*others, F.posexplode(kept).alias("position", "window"))
    number = F.col("window.number") if numbering == "gapped" else F.col("position") + 1
    return out.select(*others, "position", number.alias("chunk_number"),
                      F.col("window.text").alias("chunk_text"))


def simple_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Chunks of documents (source, domain, text, …) with file-system friendly ids.

    ``metadata_number`` is the dense 0-based position that the stored metadata carries,
    while the id keeps the gapped number.
    """
    out = chunk(docs, size, overlap, "gapped")
    number = F.col("chunk_number").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return (
        out.withColumn("chunk_id", F.concat(tx.source_stem(F.col("source")),
                                            F.lit("_chunk_"), padded))
        .withColumn("chunk_size", F.char_length("chunk_text"))
        .withColumnRenamed("position", "metadata_number")
    )


def paged_chunks(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of pages (source, domain, page, text, …), numbered from 1 on each page."""
    out = chunk(pages, size, overlap, "dense").drop("position")
    return (
        out.withColumnRenamed("chunk_number", "chunk_index")
        .withColumn("chunk_id", F.concat(
            F.col("source"), F.lit("::p"), F.col("page").cast("string"),
            F.lit("::c"), F.col("chunk_index").cast("string")))
        .withColumn("character_count", F.char_length("chunk_text"))
    )


def content_chunks(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Paged chunks whose id starts with the SHA-256 of the document content.

    ``pages`` carries ``document_sha256``; two files with equal bytes under one name share ids.
    """
    out = paged_chunks(pages, size, overlap)
    return out.withColumn("chunk_id", F.concat(
        F.lit("sha256:"), F.col("document_sha256"), F.lit("::"), F.col("chunk_id")))


def duplicate_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that occur more than once; an ingest with any of them must not be written."""
    return chunks.groupBy(key).agg(F.count("*").alias("copies")).where("copies > 1")


def register_chunk_function(spark: SparkSession, name: str = "chunk_text") -> None:
    """A SQL table function ``chunk_text(text, size, overlap)`` usable with LATERAL.

    It is plain SQL of one generator, so Catalyst inlines it as an explode of the calling row:
    nested selects would be joined back to the caller by the text. A text is cut into parts of 64
    windows first, as a substring is counted from the start of its text; an array of one element
    stands for a value that is used several times.
    """
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {name}(body STRING, size INT, overlap INT)
        RETURNS TABLE (chunk_number INT, chunk_text STRING)
        RETURN
          SELECT number, piece FROM (SELECT inline(filter(
            flatten(transform(array(greatest(0, CAST(ceil((char_length(body) - size) / (size - overlap)) AS INT))), last ->
              flatten(transform(sequence(0, CAST(last DIV {_SLICE} AS INT)), b ->
                flatten(transform(array(substring(body, b * {_SLICE} * (size - overlap) + 1,
                                                  ({_SLICE} - 1) * (size - overlap) + size)), part ->
                  transform(sequence(0, least({_SLICE} - 1, last - b * {_SLICE})), j -> struct(
                    b * {_SLICE} + j AS number,
                    btrim(substring(part, j * (size - overlap) + 1, size), {_sql_space()}) AS piece)))))))),
            w -> w.piece <> '')) AS (number, piece))
    """)


def _sql_space() -> str:
    return "decode(unhex('" + tx.WHITESPACE.encode("utf-8").hex() + "'), 'UTF-8')"
