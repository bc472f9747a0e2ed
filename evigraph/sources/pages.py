"""Readable text of stored web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def html_to_text(pages: DataFrame, min_chars: int = 500, html_col: str = "html") -> DataFrame:
    """Adds ``text``, ``sha256``, ``characters`` and ``sufficient`` (at least ``min_chars``)."""
    return (pages.withColumn("text", tx.strip(tx.html_main_text(F.col(html_col))))
            .withColumn("sha256", tx.sha256(F.col("text")))
            .withColumn("characters", F.char_length("text"))
            .withColumn("sufficient", F.col("characters") >= min_chars))
