"""Removal of word passages that occur more than once, by difference-cover anchors.

A difference cover of period ``m`` is a set of residues in which every difference modulo ``m``
occurs. Runs of ``window - m + 1`` words are hashed only where a position modulo ``m`` is in the
cover: these are the anchors, five of every 21 positions. Two equal windows, wherever they start,
have a common offset below ``m`` at which both have a cover position, so they share an aligned
anchor. An anchor that occurs once in all texts rules out every window that rests on it.

Anchors that occur again are extended. The context of an anchor is all that windows around it can
reach, ``m - 1`` words to the left and ``window - 1`` to the right, less at the ends of a text. If
a context occurs again as a whole, all its windows do. Of every context of an anchor that has
several, one place goes on; its windows are hashed one by one and counted, so a match that ends
inside a context is found as well. Nothing is compared in pairs, and an anchor that millions of
texts share costs one count and one place for each of its contexts. Hashes are 128 bits wide where
they decide.

Equal texts take part once: all words of a copied text of ``window`` words or more go.

Defined cases: a null or empty text has no words; texts shorter than ``window`` words lose none;
rows with a null or repeated id are separate documents; a very long text is one row, held by one
task; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.buckets import bucketed
from .common import cached, text_of

WINDOW = 35
PERIOD = 21
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_YIELD = 1 << 18


def difference_cover(period: int) -> tuple[int, ...]:
    """A smallest set of residues whose differences are all residues modulo ``period``."""
    return cached(("difference_cover", period), lambda: _smallest_cover(period))


def _smallest_cover(period: int) -> tuple[int, ...]:
    for size in range(1, period + 1):
        for rest in itertools.combinations(range(1, period), size - 1):
            found = (0, *rest)
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
    raise ValueError("a period is at least one")


def cover_positions(n: int, window: int, period: int) -> np.ndarray:
    """Positions of the anchors of a text of ``n`` words, rising."""
    if n < window:
        return np.zeros(0, dtype=np.int64)
    last = n - (window - period + 1)
    at = (np.arange(0, last + 1, period)[:, None] + np.array(difference_cover(period))).ravel()
    return at[at <= last]


def _powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    tables = cached("passage_powers", dict)
    if lane not in tables or len(tables[lane][0]) < n:
        made = []
        for base in (_BASES[lane], pow(_BASES[lane], -1, 1 << 64)):
            steps = np.full(max(n, 1 << 15), base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > 1 << 20:
            return made[0], made[1]
        tables[lane] = tuple(made)
    return tables[lane]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sums(values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    return total


def _run_hashes(total: np.ndarray, down: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return _mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


class Runs:
    """Hashes of any runs of words of one text, from sums over its beginning; words from its bytes."""

    def __init__(self, raw: bytes, lanes: int = 2):
        data = np.frombuffer(raw, dtype=np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
        self.n, self.sums, self.down = len(edges) // 2, [], []
        up, down = _powers(0, len(data) + 1)
        h = _run_hashes(_sums((data + np.uint64(1)) * up[:len(data)]), down, edges[::2], edges[1::2])
        for lane in range(lanes):
            up, down = _powers(lane, self.n + 1)
            self.sums.append(_sums((h if lane == 0 else _mix(h)) * up[:self.n]))
            self.down.append(down)

    def hashes(self, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
        """A signed 64-bit hash of the words from ``lo`` to before ``hi`` of each run."""
        return _run_hashes(self.sums[lane], self.down[lane], lo, hi).view(np.int64)


def unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def stage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Numbered documents, packed, bucketed by their number: no later step shuffles texts."""
    @F.pandas_udf("struct<packed: binary, digest: binary>")
    def pack(texts: pd.Series) -> pd.DataFrame:
        packer, rows = zstandard.ZstdCompressor(level=1), []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            rows.append((packer.compress(raw), hashlib.sha256(raw).digest()))
        return pd.DataFrame(rows, columns=["packed", "digest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
                       pack(text_of(text_col)).alias("x")).select("row", "doc_id", "x.*")
    return bucketed(rows, ["row"], "texts")


def copied(staged: DataFrame) -> DataFrame:
    """``row, first`` of all texts that occur more than once; ``first`` marks one of each."""
    groups = cut_lineage(staged.groupBy("digest").agg(F.min("row").alias("one"), F.count(F.lit(1)).alias("n"))
                         .filter("n > 1"), "groups")     # stored, so that the join can split a hot digest
    return staged.select("row", "digest").join(groups, "digest").select("row", (F.col("row") == F.col("one")).alias("first"))


def _flat(parts: list[dict], names: tuple[str, ...]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in names})


def _per_text(texts: DataFrame, work, schema: str) -> DataFrame:
    """Rows that ``work(row, bytes, wanted)`` gives for each text, as arrays by column."""
    names = tuple(part.split()[0] for part in schema.split(", "))

    def run(batches):
        for pdf in batches:
            parts, size = [], 0
            wanted = pdf["wanted"] if "wanted" in pdf else itertools.repeat(None)
            for row, packed, want in zip(pdf["row"], pdf["packed"], wanted):
                part = work(row, unpack(packed), want)
                if not len(part[names[0]]):
                    continue
                parts.append(part)
                size += len(part[names[0]])
                if size > _YIELD:
                    yield _flat(parts, names)
                    parts, size = [], 0
            if parts:
                yield _flat(parts, names)

    return texts.mapInPandas(run, schema)


def anchors(live: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """``anchor, row, at`` of every cover position."""
    gram = window - period + 1

    def work(row, raw, _):
        runs = Runs(raw, 1)
        at = cover_positions(runs.n, window, period)
        return {"anchor": runs.hashes(at, at + gram), "row": np.full(len(at), row), "at": at}

    return _per_text(live.select("row", "packed"), work, "anchor long, row long, at long")


def contexts(live: DataFrame, hits: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """``anchor, c1, c2, row, first, last``: context hash of each hit and the windows in it."""
    gram = window - period + 1

    def work(row, raw, want):
        at = np.sort(np.array(want, dtype=np.int64))
        runs = Runs(raw)
        lo, hi = np.maximum(at - period + 1, 0), np.minimum(at + window, runs.n)
        # where the anchor lies in its context counts, so that one place is never two
        return {"anchor": runs.hashes(at, at + gram), "c1": runs.hashes(lo, hi) ^ (at - lo), "c2": runs.hashes(lo, hi, 1),
                "row": np.full(len(at), row), "first": lo, "last": hi - window}

    rows = hits.groupBy("row").agg(F.collect_list("at").alias("wanted"))
    return _per_text(live.select("row", "packed").join(rows, "row"), work,
                     "anchor long, c1 long, c2 long, row long, first long, last long").filter("first <= last")


def windows(live: DataFrame, ranges: DataFrame, window: int = WINDOW) -> DataFrame:
    """``w1, w2, row, start`` of the windows that start in the given ranges, each place once."""
    def work(row, raw, want):
        runs = Runs(raw)
        steps = np.zeros(runs.n + 2, dtype=np.int64)
        for r in want:
            steps[r["first"]] += 1
            steps[r["last"] + 1] -= 1
        start = np.flatnonzero(np.cumsum(steps) > 0)
        return {"w1": runs.hashes(start, start + window), "w2": runs.hashes(start, start + window, 1),
                "row": np.full(len(start), row), "start": start}

    rows = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("wanted"))
    return _per_text(live.select("row", "packed").join(rows, "row"), work, "w1 long, w2 long, row long, start long")


def repeated_windows(live: DataFrame, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """``row, first, last``: windows that start there occur again; together these are all such."""
    common = cut_lineage(anchors(live, window, period).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
                         .filter("n > 1").select("anchor"), "common")
    hits = anchors(live, window, period).join(common, "anchor").select("row", "at")
    found = cut_lineage(contexts(live, hits, window, period), "contexts")
    key = ["anchor", "c1", "c2"]
    forms = cut_lineage(found.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last")).alias("one")), "forms")
    whole = found.join(forms.filter("n > 1").select(*key), key).select("row", "first", "last")
    several = forms.groupBy("anchor").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("anchor")
    rivals = forms.join(several, "anchor").select("one.*")
    single = cut_lineage(windows(live, rivals, window), "windows")
    twice = single.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2")
    parts = single.join(twice, ["w1", "w2"]).select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(parts)


def remove_passages(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed`` and ``kept``, the other words joined by spaces."""
    staged = stage(docs, id_col, text_col)
    same = cut_lineage(copied(staged), "copied")
    live = staged.join(same.filter("NOT first").select("row"), "row", "left_anti")
    found = repeated_windows(live, window, period)
    spans = found.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("spans"))

    @F.pandas_udf("struct<n_words: long, n_removed: long, kept: string>")
    def cut(packed: pd.Series, spans: pd.Series, twice: pd.Series) -> pd.DataFrame:
        rows = []
        for z, found, whole in zip(packed, spans, twice):
            words = unpack(z).split()
            n = len(words)
            gone = np.zeros(n + 1, dtype=np.int64)
            if whole and n >= window:
                gone[0], gone[n] = 1, -1
            elif found is not None:
                first = np.array([s["first"] for s in found], dtype=np.int64)
                last = np.array([s["last"] for s in found], dtype=np.int64)
                np.add.at(gone, first, 1)
                np.add.at(gone, last + window, -1)
            keep = np.cumsum(gone[:n]) == 0
            kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
            rows.append((n, n - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept"])

    twice = same.select("row", F.lit(True).alias("twice"))
    return staged.select("row", "doc_id", "packed").join(spans, "row", "left").join(twice, "row", "left").select(
        "doc_id", cut("packed", "spans", F.coalesce("twice", F.lit(False))).alias("x")).select("doc_id", "x.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """The result of ``remove_passages`` with a digest in place of the kept words."""
    return remove_passages(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
                                                  (F.col("n_removed") > 0).alias("has_repeats"))
