"""Which terms and which other sources set a source apart, within each language.

Every (language, source) group and every language is a smoothed distribution over the terms kept
for the language, in billionths and whole numbers throughout. How far ``p`` is from ``q`` is
``f = floor((p - q)^2 / q)``.

Terms are not scored one by one. Terms with the same (group count, language count) are one cell:
``f`` is evaluated once a cell, cells of a group with equal values are merged, and merged values
are ranked by their cumulative number of terms. Only the cells that reach the ranks wanted are
expanded to their terms, in UTF-8 order. For the comparison of sources a cell is a profile, the
counts of a term in all sources of its language, with the number of terms that have it.

Hot languages and sources cost no hot task: tasks count what they read before the shuffle, ranking
keeps the best rows of each task first, and profiles of a language are dealt into blocks. The
groups of one language come together in each block, as the result has a row for each pair of them.

Defined cases: null text, lang and source count as empty strings; a group without terms has only
smoothing; a language without kept terms gives pairs of value 0 and no terms; repeated rows are
documents of their own; a very long text is one row, held by one task; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_of

LEAST_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
_HELD = 200_000                 # counts a task holds before it hands them on
_BLOCK = 20_000                 # profiles of a language compared in one task
_CELLS = 1 << 21                # profiles times sources compared at once
#: Letters A to Z become small, all other ASCII separates terms.
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _count(batches):
    """Occurrences and documents by group and term, added up before they leave the task."""
    held, size = {}, 0

    def out():
        parts = []
        for (lang, source), (found, docs) in held.items():
            # a group without terms is a group nevertheless
            parts.append(pd.DataFrame({"lang": lang, "source": source,
                                       "term": [None, *[t.decode("utf-8", "surrogatepass") for t in found]],
                                       "n": [0, *found.values()], "docs": [0, *map(docs.__getitem__, found)]}))
        return pd.concat(parts)

    for pdf in batches:
        for lang, source, text in zip(pdf["lang"], pdf["source"], pdf["text"]):
            found, docs = held.setdefault((lang, source), (Counter(), Counter()))
            words = terms(text)
            size -= len(found)
            found.update(words)
            docs.update(set(words))
            size += len(found)
            if size > _HELD:
                yield out()
                held, size = {}, 0
    if held:
        yield out()


def counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``; every group also has a row without a term."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))
    return (rows.mapInPandas(_count, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def share(n: Column, total: Column, kept: Column) -> Column:
    """Billionths of a distribution with one added to each count, plus one."""
    return F.lit(1).cast("long") + _div(F.lit(UNIT).cast("long") * (n + 1), total + kept)


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of non-negative long numbers, exactly."""
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _compare(key, profiles: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Sums of ``f`` over the terms of one block, for all ordered pairs of sources of its language."""
    groups = groups.sort_values("source", ignore_index=True)
    names, total = groups["source"].to_numpy(), groups["total"].to_numpy(dtype=np.int64)
    kept, column = int(groups["kept"].iloc[0]) if len(groups) else 0, {s: k for k, s in enumerate(names)}
    sums = np.zeros((len(names), len(names)), dtype=np.int64)
    step = max(1, _CELLS // max(1, len(names)))
    for lo in range(0, len(profiles), step):
        part = profiles.iloc[lo:lo + step]
        n = np.zeros((len(part), len(names)), dtype=np.int64)
        for i, cells in enumerate(part["profile"]):
            for cell in cells:
                n[i, column[cell["source"]]] = cell["n"]
        p = 1 + UNIT * (n + 1) // (total + kept)
        times = part["terms"].to_numpy(dtype=np.int64)[:, None]
        for k in range(len(names)):
            sums[k] += ((p[:, k:k + 1] - p) ** 2 // p * times).sum(axis=0)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    return pd.DataFrame({"lang": key[0], "source": names[a], "item": names[b], "value": sums[a, b]})


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, lang_col: str = "lang",
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank``; see the module's text."""
    counted = cut_lineage(counts(docs, lang_col, source_col, text_col), "counts")
    whole = counted.filter("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    rows = cut_lineage(counted.select("lang", "source", "term", "n").join(whole, ["lang", "term"]), "kept")

    langs = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n_lang").alias("total_lang"))
    sizes = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = cut_lineage(
        counted.filter("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left").select("lang", "source", F.coalesce("total", zero).alias("total"),
                                            F.coalesce("kept", zero).alias("kept"), "total_lang"), "groups")
    return _terms(rows, groups, top).unionByName(_pairs(rows, groups))


def _terms(rows: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    cells = rows.groupBy("lang", "source", "n", "n_lang").agg(F.count(F.lit(1)).alias("terms")).join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("n_lang"), F.col("total_lang"), F.col("kept"))
    valued = cut_lineage(cells.select("lang", "source", "n", "n_lang", "terms", p.alias("p"), q.alias("q"))
                         .filter("n > 0 AND p > q").withColumn("value", distance(F.col("p"), F.col("q")))
                         .drop("p", "q"), "cells")
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc())
    # every value has a term, so no more than ``top`` values can matter
    first = merged.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
    before = F.sum("terms").over(best.rowsBetween(Window.unboundedPreceding, -1))
    chosen = first.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top) \
        .select("lang", "source", "value")
    wanted = valued.join(chosen, ["lang", "source", "value"]).select("lang", "source", "n", "n_lang", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return rows.join(wanted, ["lang", "source", "n", "n_lang"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value") \
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    profiles = cut_lineage(
        rows.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("profile"))
        .groupBy("lang", "profile").agg(F.count(F.lit(1)).alias("terms")), "profiles")
    blocks = profiles.groupBy("lang").agg(F.count(F.lit(1)).alias("profiles")).select(
        "lang", F.ceil(F.col("profiles") / _BLOCK).cast("long").alias("blocks"))
    dealt = profiles.join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("profile"), F.col("blocks")).alias("block"), "profile", "terms")
    each = groups.select("lang", "source", "total", "kept").join(blocks, "lang", "left").select(
        "lang", "source", "total", "kept",
        F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    sums = dealt.groupBy("lang", "block").cogroup(each.groupBy("lang", "block")).applyInPandas(
        _compare, "lang string, source string, item string, value long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value",
                       F.row_number().over(order).alias("rank"))
