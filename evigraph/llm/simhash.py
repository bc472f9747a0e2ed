"""Near-duplicate detection by SimHash and covering locality-sensitive hashing.

Fingerprints are majorities over the XXH64 values of word shingles. Links are found with
structured bit masks: bit ``i`` of a fingerprint carries a non-zero code ``c(i)`` of
``radius + 1`` bits, and mask ``v`` keeps the bits whose code has an odd scalar product with
``v``. For any ``radius`` bits there is a ``v`` orthogonal to all their codes, so two
fingerprints that differ in at most ``radius`` bits are equal under that mask and meet in its
table: no pair is missed.

Equal fingerprints are one entry from the start. A bucket hands on a spanning forest of its
links, at most one link less than it has members, never all pairs. A bucket too large for one
task is dealt again by a second family of masks over the bits the first one dropped, and by a
third over what is left then; that bounds it by the number of bit patterns, without a cap.

Defined cases: a null text counts as empty; texts without words have fingerprint 0, which links
like any other; a row with a null id takes part, and components are named by the smallest
non-null id (null if there is none); extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import text_of
from .components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
BUCKET = 4096
_BLOCK = 1 << 15


def fingerprint(text: str, words_per_shingle: int = SHINGLE) -> int:
    """The majority of each bit over all shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(words_per_shingle, len(words))
    shift = [words[i:len(words) - k + 1 + i] for i in range(k)]
    ones, total = np.zeros(BITS, dtype=np.int64), len(shift[0])
    for lo in range(0, total, _BLOCK):
        part = [xxhash.xxh64_digest(b" ".join(s), SEED) for s in zip(*[x[lo:lo + _BLOCK] for x in shift])]
        bits = np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit integer."""
    udf = fingerprint_udf(words_per_shingle)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), udf(text_of(text_col)).alias("fp"))


def fingerprint_udf(words_per_shingle: int = SHINGLE):
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        values = np.array([fingerprint(t, words_per_shingle) for t in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))
    return of


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Covering masks over the given bit positions; codes are dealt evenly."""
    codes = (1 << (radius + 1)) - 1
    code = {bit: 1 + k % codes for k, bit in enumerate(bits)}
    return [sum(1 << bit for bit in bits if (code[bit] & v).bit_count() & 1) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def deal(points: DataFrame, kept: list[str], family: dict[int, list[int]], level: int) -> DataFrame:
    """One row per fingerprint and mask. ``family`` maps the mask used before to the masks now."""
    cases = [F.when(F.col("mask") == before, F.array(*[
        F.struct(F.lit(_signed(m)).alias("m"), F.lit(k).alias("k")) for k, m in enumerate(now)]))
        for before, now in family.items()]
    table = F.coalesce(*cases)
    return (points.select("fp", *kept, F.explode(table).alias("t"))
            .select("fp", F.xxhash64(*kept, F.lit(level), "t.k", F.col("fp").bitwiseAND(F.col("t.m")))
                    .alias("bucket"), F.col("t.m").alias("mask")))


def _forest(points: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest over points at most ``radius`` bits apart, by breadth-first search."""
    left, links = np.arange(len(points)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            at, left = front[0], left
            near = np.bitwise_count(points[left] ^ points[at]) <= radius
            found = left[near]
            if len(found):
                links.append(np.stack([np.full(len(found), points[at]), points[found]], axis=1))
                left = left[~near]
            front = np.concatenate([front[1:], found])
    return np.concatenate(links) if links else np.zeros((0, 2), dtype=np.uint64)


def link_buckets(dealt: DataFrame, radius: int = RADIUS, limit: int | None = BUCKET) -> DataFrame:
    """Links within the buckets as ``a, b``; members of buckets over ``limit`` come back with ``mask``.

    Partitions are sorted by bucket and read as a stream; a bucket is compared when it is
    complete, or passed on as soon as it has outgrown ``limit``.
    """
    def run(batches):
        held: list[pd.DataFrame] = []       # the open bucket
        size, open_bucket, over = 0, None, False

        def close(parts: list[pd.DataFrame]):
            points = np.unique(np.concatenate([p["fp"].to_numpy() for p in parts])).view(np.uint64)
            links = _forest(points, radius).view(np.int64)
            return pd.DataFrame({"a": links[:, 0], "b": links[:, 1], "bucket": None, "mask": None})

        def passed(pdf: pd.DataFrame):
            return pd.DataFrame({"a": pdf["fp"], "b": None, "bucket": pdf["bucket"], "mask": pdf["mask"]})

        def small(pdf: pd.DataFrame):
            """Links of all complete buckets of two or three: pairs of neighbours, no loop."""
            fp, bucket = pdf["fp"].to_numpy().view(np.uint64), pdf["bucket"].to_numpy()
            out = []
            for step in (1, 2):
                same = bucket[step:] == bucket[:-step]
                near = np.bitwise_count(fp[step:] ^ fp[:-step]) <= radius
                hit = np.flatnonzero(same & near & (fp[step:] != fp[:-step]))
                out.append(pd.DataFrame({"a": fp[hit].view(np.int64), "b": fp[hit + step].view(np.int64)}))
            return pd.concat(out).assign(bucket=None, mask=None)

        for pdf in batches:
            if not len(pdf):
                continue
            edges = np.flatnonzero(np.diff(pdf["bucket"].to_numpy())) + 1
            starts = np.concatenate([[0], edges])
            ends = np.append(edges, len(pdf))
            ids = pdf["bucket"].to_numpy()[starts]
            if len(starts) > 2:             # buckets in the middle are complete
                lengths = (ends - starts)[1:-1]
                few = np.repeat(lengths <= 3, lengths) & np.repeat(lengths > 1, lengths)
                middle = pdf.iloc[starts[1]:ends[-2]]
                if few.any():
                    yield small(middle[few])
            for k, (lo, hi) in enumerate(zip(starts, ends)):
                if 0 < k < len(starts) - 1 and hi - lo <= 3:
                    continue
                if ids[k] != open_bucket:
                    if size > 1 and not over:
                        yield close(held)
                    held, size, open_bucket, over = [], 0, ids[k], False
                part = pdf.iloc[lo:hi]
                size += hi - lo
                if over:
                    yield passed(part)
                    continue
                held.append(part)
                if limit and size > limit:
                    yield passed(pd.concat(held))
                    held, over = [], True
        if size > 1 and not over:
            yield close(held)

    return (dealt.repartition("bucket").sortWithinPartitions("bucket", "fp")
            .mapInPandas(run, "a long, b long, bucket long, mask long"))


def links(points: DataFrame, radius: int = RADIUS, limit: int = BUCKET) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that connect all within ``radius``."""
    every = list(range(BITS))
    family = {0: masks(every, radius)}
    dealt = deal(points.select("fp", F.lit(0).cast("long").alias("mask")), [], family, 1)
    found = None
    for level in (2, 3, 4):
        now = cut_lineage(link_buckets(dealt, radius, limit if level < 4 else None), "links")
        new = now.filter("b IS NOT NULL").select("a", "b")
        found = new if found is None else found.unionByName(new)
        rest = now.filter("b IS NULL").select(F.col("a").alias("fp"), "bucket", "mask")
        if level == 4 or not rest.limit(1).count():
            return found
        used = {r[0] & (1 << 64) - 1 for r in rest.select("mask").distinct().collect()}
        family = {_signed(m): [m | x for x in masks([i for i in every if not m >> i & 1], radius)] for m in used}
        dealt = deal(rest, ["bucket"], family, level)
    return found


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE, radius: int = RADIUS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, fingerprint, component_id``."""
    prints = cut_lineage(fingerprints(docs, words_per_shingle, id_col, text_col), "prints")
    points = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points, radius))
    named = points.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut_lineage(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one with the smallest id, with all its columns.

    Rows without an id cannot be told apart by one; of a component made of such rows only, and
    of rows that repeat the smallest id, one row stays.
    """
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns]).alias("rec")), "numbered")
    keyed = numbered.select(F.struct(F.col(f"rec.`{id_col}`").isNull().alias("last"),
                                     F.col(f"rec.`{id_col}`").alias("id"), "row").alias("doc_id"),
                            F.col(f"rec.`{text_col}`").alias("text"))
    chosen = near_duplicates(keyed).select(F.col("component_id.row").alias("row")).distinct()
    return numbered.join(chosen, "row", "left_semi").select(
        *[F.col(f"rec.`{c}`") for c in docs.columns])
