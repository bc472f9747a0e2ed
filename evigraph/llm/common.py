"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(name: str = "text") -> Column:
    """The column as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fold(id_col: str, folds: int) -> Column:
    """The fold of a row: CRC-32 of its id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds))


def in_fold(id_col: str, folds: int, which: int) -> Column:
    return F.coalesce(fold(id_col, folds) == which, F.lit(False))


def worker_cache() -> types.ModuleType:
    """A module in which a Python worker keeps what several tasks use, such as tables and memos."""
    return sys.modules.setdefault("_evigraph_worker", types.ModuleType("_evigraph_worker"))


def cached(key, make):
    """``make()`` once per Python worker and key."""
    store = worker_cache().__dict__.setdefault("store", {})
    if key not in store:
        store[key] = make()
    return store[key]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    keep: Column, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_class`` labelled ids for each of the labels 0 and 1, the same in every run.

    Ids are taken in the order of a hash, so the sample is spread over the table.
    """
    rows = labels.select(F.col(id_col).alias(id_col), F.col(label).cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1) & F.col(id_col).isNotNull() & keep)
    order = [F.xxhash64(F.col(id_col), F.lit(17)), F.col(id_col)]
    picked = [rows.filter(F.col("label") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1])
