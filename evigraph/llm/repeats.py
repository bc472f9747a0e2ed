"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every window of ``LENGTH`` bytes has one anchor (see ``anchors``), and equal windows have equal
anchors, so windows can only be repeated within a group of equal anchor hashes. A text is cut
into ranges of windows with one anchor. Ranges that are equal as a whole are repeated, and one
of them goes on; ranges whose anchor is the only one of its kind are not repeated. The others
are dealt into shards by anchor, a suffix array is induced for each shard, and where a suffix
has a common prefix of ``LENGTH`` bytes with a neighbour at another place, its window is
repeated. All this is judged on the input; the covered bytes are then cut out at once.

A group with too many different ranges for one shard is halved again and again: a half of its
windows is grouped by the bytes all of them share, which are more each time, equal ranges fall
together, and lone ones drop out. This ends, as a range of one window has no two different forms.

Defined cases: a null or empty text has no bytes; texts shorter than ``LENGTH`` lose none; equal
texts lose all bytes if long enough, each of them; rows with a null or repeated id are separate
documents; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .anchors import ranges
from .common import text_of
from .suffixes import permuted_lcp, suffix_array

LENGTH = 400
GRAM = 100
SHARD_BYTES = 1_500_000
FORMS = 512             # different ranges of one anchor that a shard takes as they are


def stage(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Numbered documents, their bytes (packed, as they are shuffled twice) and their ranges."""
    @F.pandas_udf("struct<packed: binary, ranges: array<struct<first: int, last: int, at: int, anchor: long, form: long>>>")
    def cut(texts: pd.Series) -> pd.DataFrame:
        pack, rows = zstandard.ZstdCompressor(level=1), []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            first, last, at, anchor = ranges(np.frombuffer(raw, dtype=np.uint8), length, gram)
            form = [xxhash.xxh3_64_intdigest(raw[i:j + length], p - i)
                    for i, j, p in zip(first.tolist(), last.tolist(), at.tolist())]
            form = np.array(form, dtype=np.uint64).view(np.int64)
            rows.append((pack.compress(raw), list(zip(
                first.tolist(), last.tolist(), at.tolist(), anchor.view(np.int64).tolist(), form.tolist()))))
        return pd.DataFrame(rows, columns=["packed", "ranges"])

    return cut_lineage(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
        cut(text_of(text_col)).alias("x")).select("row", "doc_id", "x.*"), "ranges")


def _repeats_in_shard(pieces: list[bytes], places: np.ndarray, spans: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Covered stretches ``(piece, lo, hi)`` of the pieces of one shard.

    ``places`` names document and position of a piece's first byte; ``spans`` is how many of its
    bytes may start a window.
    """
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    text = np.append(np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8).astype(np.uint16) + 2, 0)
    text[starts + sizes - 1] = 1                            # between pieces; 0 ends the string
    text = text.astype(np.uint16)
    sa = suffix_array(text, 258)
    common, _ = permuted_lcp(text, sa)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    piece = np.append(piece, len(pieces) - 1)
    within = np.arange(len(text)) - starts[piece]
    opens = common[sa] < length                             # a suffix unlike the one before it
    opens[0] = True
    place = (places[piece] + within)[sa]
    at = np.flatnonzero(opens)
    varied = np.minimum.reduceat(place, at) != np.maximum.reduceat(place, at)
    repeated = np.zeros(len(text), dtype=bool)
    repeated[sa] = np.repeat(varied, np.diff(np.append(at, len(text))))
    repeated &= (within < spans[piece]) & (within + length <= sizes[piece] - 1)
    hits = np.flatnonzero(repeated)
    if not len(hits):
        return []
    step = np.zeros(len(text) + length + 1, dtype=np.int32)
    step[hits] += 1
    step[hits + length] -= 1
    covered = np.append(np.cumsum(step)[:len(text)] > 0, False)
    edge = np.flatnonzero(np.diff(np.append(False, covered).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    return list(zip(piece[lo].tolist(), within[lo].tolist(), (within[lo] + hi - lo).tolist()))


def _shards(pieces: DataFrame, length: int) -> DataFrame:
    """``row, lo, hi`` of the repeats found in shards; ``pieces`` has ``anchor, row, first, last, body``."""
    total = pieces.agg(F.sum(F.length("body"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # documents of the shard are numbered, so that a place is one number
        number = np.unique(pdf["row"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        first = pdf["first"].to_numpy(dtype=np.int64)
        spans = pdf["last"].to_numpy(dtype=np.int64) - first + 1
        found = _repeats_in_shard(list(map(bytes, pdf["body"])), (number << 32) + first, spans, length)
        out = pd.DataFrame(found, columns=["k", "lo", "hi"], dtype=np.int64)
        rows = pdf["row"].to_numpy()[out["k"]]
        return pd.DataFrame({"row": rows, "lo": first[out["k"]] + out["lo"], "hi": first[out["k"]] + out["hi"]})

    return (pieces.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard")
            .applyInPandas(run, "row long, lo long, hi long"))


def _halve(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """Each range cut at fixed offsets from its anchor, with the hash of what its windows share.

    ``low`` and ``high`` bound the offsets of a part from the anchor, whatever a text's ends
    leave of it, so that parts of different texts match.
    """
    @F.pandas_udf("array<struct<anchor: long, form: long, low: int, high: int, first: long, last: long, body: binary>>")
    def cut(anchor: pd.Series, at: pd.Series, low: pd.Series, high: pd.Series, first: pd.Series,
            last: pd.Series, body: pd.Series) -> pd.Series:
        out = []
        for group, p, a, z, i, j, raw in zip(anchor, at, low, high, first, last, body):
            parts, middle = [], (a + z) // 2
            for lo, hi in ((a, middle), (middle + 1, z)):
                start, end = max(i, p + lo), min(j, p + hi)
                if lo > hi or start > end:
                    continue
                shared = raw[p + hi - i:p + lo + length - i]
                if len(shared) < lo + length - hi:          # a text's end: its windows share more
                    shared = b""
                key = xxhash.xxh3_64_intdigest(bytes(shared), (group ^ (lo + 1000) * 1_000_003) & (1 << 64) - 1)
                mine = bytes(raw[start - i:end - i + length])
                form = xxhash.xxh3_64_intdigest(mine, (start - p) & (1 << 64) - 1)
                parts.append({"anchor": key - (1 << 64) if key >> 63 else key,
                              "form": form - (1 << 64) if form >> 63 else form,
                              "low": lo, "high": hi, "first": start, "last": end, "body": mine})
            out.append(parts)
        return pd.Series(out, dtype=object)

    return pieces.select("row", "at", F.explode(cut("anchor", "at", "low", "high", "first", "last", "body")).alias("p")) \
        .select("row", "at", "p.*")


def _forms(parts: DataFrame, *more: str) -> DataFrame:
    """One row per anchor and form: how often it occurs and the place of one of them."""
    return parts.groupBy("anchor", "form").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last", "at", *more)).alias("one"))


def _rivals(forms: DataFrame) -> DataFrame:
    """Forms that share their anchor with others, and with how many."""
    several = forms.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1")
    return forms.join(several, "anchor").select("anchor", "form", "n", "one.*", "forms")


def _whole(parts: DataFrame, forms: DataFrame, length: int) -> DataFrame:
    """Ranges that occur as a whole more than once."""
    twice = forms.filter("n > 1").select("anchor", "form")
    return parts.join(twice, ["anchor", "form"]).select(
        "row", F.col("first").cast("long").alias("lo"), (F.col("last") + length).cast("long").alias("hi"))


def repeated_stretches(staged: DataFrame, length: int = LENGTH, gram: int = GRAM,
                       forms_per_shard: int = FORMS) -> list[DataFrame]:
    """Tables ``row, lo, hi`` of covered bytes; together they cover all that is repeated."""
    parts = staged.select("row", F.explode("ranges").alias("r")).select("row", "r.*")
    forms = cut_lineage(_forms(parts), "forms")
    out = [_whole(parts, forms, length)]
    rivals = cut_lineage(_rivals(forms), "rivals")
    at_row = rivals.groupBy("row").agg(F.collect_list(F.struct(
        "anchor", "form", "first", "last", "at", "forms")).alias("wanted"))

    @F.pandas_udf("array<binary>")
    def bodies(packed: pd.Series, wanted: pd.Series) -> pd.Series:
        unpack, rows = zstandard.ZstdDecompressor(), []
        for z, want in zip(packed, wanted):
            raw = unpack.decompress(z)
            rows.append([raw[w["first"]:w["last"] + length] for w in want])
        return pd.Series(rows, dtype=object)

    with_text = staged.select("row", "packed").join(at_row, "row") \
        .withColumn("bodies", bodies("packed", "wanted")) \
        .select("row", F.explode(F.arrays_zip("wanted", "bodies")).alias("p"))
    pieces = cut_lineage(with_text.select(
        "row", F.col("p.wanted.anchor").alias("anchor"), F.col("p.wanted.form").alias("form"),
        F.col("p.wanted.first").cast("long").alias("first"), F.col("p.wanted.last").cast("long").alias("last"),
        F.col("p.wanted.at").cast("long").alias("at"), F.lit(gram - length).alias("low"), F.lit(0).alias("high"),
        F.col("p.wanted.forms").alias("forms"), F.col("p.bodies").alias("body")), "pieces")
    while True:
        out.append(_shards(pieces.filter(F.col("forms") <= forms_per_shard), length))
        crowded = pieces.filter(F.col("forms") > forms_per_shard)
        if not crowded.limit(1).count():
            return out
        halves = cut_lineage(_halve(crowded, length, gram), "halves")
        forms = cut_lineage(_forms(halves, "low", "high", "body"), "forms")
        out.append(_whole(halves, forms, length))
        pieces = cut_lineage(_rivals(forms), "pieces")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, forms_per_shard: int = FORMS) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_removed, n_spans`` and the kept bytes as ``kept``."""
    staged = stage(docs, length, gram)
    tables = repeated_stretches(staged, length, gram, forms_per_shard)
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    @F.pandas_udf("struct<n_bytes: long, n_removed: long, n_spans: long, kept: binary>")
    def cut(packed: pd.Series, spans: pd.Series) -> pd.DataFrame:
        unpack, rows = zstandard.ZstdDecompressor(), []
        for z, found in zip(packed, spans):
            raw = unpack.decompress(z)
            kept, at, runs = [], 0, 0
            for s in sorted((s["lo"], s["hi"]) for s in found) if found is not None else ():
                if s[0] > at or not runs:
                    kept.append(raw[at:s[0]])
                    runs += 1
                at = max(at, s[1])
            kept.append(raw[at:])
            kept = b"".join(kept)
            rows.append((len(raw), len(raw) - len(kept), runs, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return staged.select("row", "doc_id", "packed").join(spans, "row", "left").select(
        "doc_id", cut("packed", "spans").alias("x")).select("doc_id", "x.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """The result of ``remove_repeats`` with a digest in place of the kept bytes."""
    return remove_repeats(docs, **options).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeats"))
