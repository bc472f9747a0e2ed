"""Exact deduplication of texts against immutable snapshots.

A delivery of documents is grouped by digest on its own. Its distinct digests are screened by
the static binary-fuse filters of the snapshot before it, one filter per digest bucket; only
positives go on to the exact buckets, where the texts themselves are compared. What the filter
rules out is new for certain.

Defined cases: a null text counts as empty; null ids sort below all others, so a row with an id
stays before one without; of rows repeated with the same id and text exactly one is kept; an
empty table gives an empty result; extra columns are never looked at, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import fuse

KEY = ["digest", "size", "mix"]
KEYS_PER_FILTER = 1 << 16
DELIVERIES = 2


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          deliveries: int = DELIVERIES) -> DataFrame:
    """Numbered rows with their digests, the text and all other columns as ``rest``, as a table.

    ``row`` numbers the rows; as the table is written once, every later step sees the same
    numbers. ``delivery`` deals a table that came in one piece into a snapshot and increments.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("body"),
                       F.col(f"`{text_col}`").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    return cut_lineage(rows.select(
        F.monotonically_increasing_id().alias("row"), "id", "text", "rest",
        F.pmod(F.xxhash64("id"), F.lit(deliveries)).cast("int").alias("delivery"),
        F.unhex(F.sha2("body", 256)).alias("digest"),
        F.octet_length("body").alias("size"), F.xxhash64("body").alias("mix")), "staged")


def group(staged: DataFrame) -> DataFrame:
    """One row per delivery and digest: size of the group and the row that would stay."""
    return staged.groupBy("delivery", *KEY).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("last"))


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


def _screen_key(pdf: pd.DataFrame):
    return pdf["mix"].to_numpy().view("uint64") ^ pdf["head"].to_numpy().view("uint64")


def _head():
    return F.xxhash64("digest").alias("head")


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """The binary-fuse filter of every digest bucket of a snapshot."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, segments, table = fuse.build(_screen_key(pdf))
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "seed": seed, "length": length,
                             "segments": segments, "table": [table]})

    return groups.select(_bucket(buckets), "mix", _head()).groupBy("bucket").applyInPandas(
        one, "bucket long, seed long, length long, segments long, table binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """``groups`` with ``maybe``: whether the snapshot's filters may hold the digest."""
    fields = ["delivery", *KEY, "n", "last"]

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = left[["digest", "size", "mix"]].copy()
        out["maybe"] = (fuse.may_contain(_screen_key(left), *right.iloc[0][
            ["seed", "length", "segments", "table"]]) if len(right) else False)
        return out

    seen = (groups.select(_bucket(buckets), *KEY, _head()).groupBy("bucket")
            .cogroup(filters.groupBy("bucket"))
            .applyInPandas(one, "digest binary, size int, mix long, maybe boolean"))
    return groups.select(*fields).join(seen, KEY)


def resolve(staged: DataFrame, keys_per_filter: int = KEYS_PER_FILTER) -> DataFrame:
    """One row per digest of all deliveries: the groups with equal bytes, merged.

    ``parts`` lists what stays and how many there are for each set of equal bytes. It has one
    entry but in the case that two different texts share SHA-256, length and XXH64; then the
    deliveries that hold each text say which entry is theirs.
    """
    groups = cut_lineage(group(staged), "groups")
    deliveries = [r[0] for r in groups.select("delivery").distinct().orderBy("delivery").collect()]
    total = groups.count()
    buckets = max(1, -(-total // keys_per_filter))
    entry = F.struct(F.array("delivery").alias("deliveries"), "n", "last")
    known = groups.filter(F.col("delivery") == (deliveries[0] if deliveries else 0)).select(
        *KEY, F.array(entry).alias("parts"))
    for delivery in deliveries[1:]:
        fresh = groups.filter(F.col("delivery") == delivery)
        filters = build_filters(known, buckets)
        fresh = cut_lineage(screen(fresh, filters, buckets), "screened")
        known = cut_lineage(_merge(staged, known, fresh), "snapshot")
    return known


def _merge(staged: DataFrame, known: DataFrame, fresh: DataFrame) -> DataFrame:
    entry = F.struct(F.array("delivery").alias("deliveries"), "n", "last")
    positive = fresh.filter("maybe").select(*KEY, entry.alias("part"))
    both = known.join(positive, KEY)
    wanted = both.select(
        "digest", F.explode(F.concat(F.transform("parts", lambda p: p["last"]["row"]),
                                     F.array("part.last.row"))).alias("row"))
    bytes_of = staged.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .join(wanted, "row").select("digest", "row", "text")
    new = positive.join(bytes_of, (positive["digest"] == bytes_of["digest"])
                        & (positive["part.last.row"] == bytes_of["row"])) \
        .select(positive["digest"], "size", "mix", "part", F.col("text").alias("new_text"))
    old = bytes_of.withColumnRenamed("text", "old_text").withColumnRenamed("row", "old_row")
    equal = new.join(old, "digest").filter(
        (F.col("old_row") != F.col("part.last.row")) & (F.col("old_text") == F.col("new_text"))) \
        .select(*KEY, F.col("old_row"))
    joined = known.join(positive, KEY, "full_outer").join(equal, KEY, "left")
    part = F.col("part")

    def add(p):
        hit = part.isNotNull() & (p["last"]["row"] == F.col("old_row"))
        return F.when(hit, F.struct(
            F.concat(p["deliveries"], part["deliveries"]).alias("deliveries"),
            (p["n"] + part["n"]).alias("n"),
            F.greatest(p["last"], part["last"]).alias("last"))).otherwise(p)

    parts = F.coalesce(F.transform("parts", add), F.array().cast(known.schema["parts"].dataType))
    lone = part.isNotNull() & F.col("old_row").isNull()
    merged = joined.select(*KEY, F.when(lone, F.concat(parts, F.array(part)))
                           .otherwise(parts).alias("parts"))
    return merged.unionByName(fresh.filter(~F.col("maybe")).select(*KEY, F.array(entry).alias("parts")))


def decide(staged: DataFrame, resolved: DataFrame) -> DataFrame:
    """Every staged row with ``keep_id``, ``group_size`` and ``kept``.

    A join by digest that AQE may split: a group that holds a third of all rows is one row on
    the other side.
    """
    mine = F.filter("parts", lambda p: F.array_contains(p["deliveries"], F.col("delivery")))[0]
    return staged.join(resolved, KEY).withColumn("mine", mine).select(
        "text", "rest", F.col("id").alias("doc_id"), F.col("mine.last.id").alias("keep_id"),
        F.col("mine.n").alias("group_size"), (F.col("mine.last.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    staged = stage(docs.select(f"`{id_col}`", f"`{text_col}`"), id_col, text_col)
    return decide(staged, resolve(staged)).drop("text", "rest")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows that stay, with all their columns in their order."""
    staged = stage(docs, id_col, text_col)
    kept = decide(staged, resolve(staged)).filter("kept")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`")
                         for c in docs.columns])
