"""Near copies by similarity: Jaccard of five-word shingle sets of at least 0.8.

Texts whose SimHash fingerprints over the shingles link (at most ``simhash.RADIUS`` bits apart, found
by covering masks) are candidates. Texts of that similarity often differ in more bits, so min-hashes
of the shingle sets are cut into bands as well; texts that share a band are candidates too. With
``BANDS`` bands of ``ROWS`` a pair of similarity 0.8 is missed with probability 0.004, one of 0.9
with less than 1e-7. Candidates only say what is compared: within each component of candidates
texts are linked by the similarity of their whole shingle sets.

Texts with the same shingles are one entry from the start. A component of candidates is compared
in blocks of about ``BLOCK_BYTES`` of text, so a task holds one block, or two of them, however many
copies there are. First every block is linked within itself, then one text of each group found so;
a component that is one group by then is done, and one that is not is compared block by block,
between different groups only. Nothing is capped. Defined cases: a null text counts as empty; a text of fewer than five words is one shingle,
texts without words are copies of each other; letters A to Z count as lower case.
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
from .simhash import fingerprint_udf
from .simhash import links as fingerprint_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 30, 8
BLOCK_BYTES = 16 << 20
_BLOCK = 4096
_RNG = np.random.default_rng(11)
_A = _RNG.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, size=BANDS * ROWS, dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    k = min(SHINGLE, len(words))
    found = {xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*[words[i:len(words) - k + 1 + i] for i in range(k)])}
    return np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))


def bands(text: str) -> list[int]:
    """One signed hash for each band, and two of the whole set of shingles."""
    hashes = shingles(text)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(hashes), _BLOCK):
        least = np.minimum(least, (_A[:, None] * hashes[None, lo:lo + _BLOCK] + _B[:, None]).min(axis=1))
    raw, step = least.tobytes(), 8 * ROWS
    found = [xxhash.xxh64_intdigest(raw[k * step:(k + 1) * step], k) - (1 << 63) for k in range(BANDS)]
    return [*found, *(xxhash.xxh64_intdigest(hashes.tobytes(), seed) - (1 << 63) for seed in (BANDS, BANDS + 1))]


def groups(sets: list[np.ndarray], least: float = SIMILARITY) -> np.ndarray:
    """For every set the position of the first one linked to it, by breadth-first search."""
    size = np.array([len(s) for s in sets])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.any() else np.zeros(0, dtype=np.int64)
    owner, start = np.repeat(np.arange(len(sets)), size), np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(at.max() + 1 if len(at) else 0, dtype=bool)
    group, left = np.full(len(sets), -1), np.ones(len(sets), dtype=bool)
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], group[first], front = False, first, [first]
        while front and left.any():
            x = front.pop()
            marked[at[start[x]:start[x + 1]]] = True
            common = np.bincount(owner[marked[at]], minlength=len(sets))
            marked[at[start[x]:start[x + 1]]] = False
            whole = size + size[x] - common
            near = np.flatnonzero(left & (common >= least * whole))
            left[near], group[near] = False, first
            front.extend(near.tolist())
    return group


def _sets(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [shingles(t) for t in pdf["text"]]


def _compare(pdf: pd.DataFrame) -> pd.DataFrame:
    """Every text of a block with the first one of its group."""
    pdf = pdf.sort_values("row")
    rows = pdf["row"].to_numpy()
    return pd.DataFrame({"a": rows, "b": rows[groups(_sets(pdf))]})


def _compare_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between texts of different groups; one link for two groups is enough.

    A link between groups has an end outside the largest one, so its texts ask for no partners.
    """
    pdf = pdf.sort_values("row")
    sets, rows, group = _sets(pdf), pdf["row"].to_numpy(), pdf["group"].to_numpy()
    size = np.array([len(x) for x in sets])
    at = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner, start = np.repeat(np.arange(len(sets)), size), np.concatenate([[0], np.cumsum(size)])
    marked, found = np.zeros(at.max(initial=-1) + 1, dtype=bool), set()
    kinds, n = np.unique(group, return_counts=True)
    for x in np.flatnonzero(group != kinds[n.argmax()]):
        marked[at[start[x]:start[x + 1]]] = True
        common = np.bincount(owner[marked[at]], minlength=len(sets))
        marked[at[start[x]:start[x + 1]]] = False
        near = np.flatnonzero((group != group[x]) & (common >= SIMILARITY * (size + size[x] - common)))
        found.update((int(group[x]), int(g)) for g in np.unique(group[near]))
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _with_blocks(texts: DataFrame, seed: int) -> DataFrame:
    """``block`` and the number of ``blocks`` of the row's ``root``, by its bytes of text."""
    need = texts.groupBy("root").agg(
        F.ceil(F.sum(F.octet_length("text")) / F.lit(BLOCK_BYTES)).alias("n")) \
        .select("root", F.greatest("n", F.lit(1)).alias("blocks"))
    return texts.join(need, "root").withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.col("blocks")))


def _linked(texts: DataFrame) -> DataFrame:
    """``row, copy_of`` for texts (``row, root, text``) of the components of candidates."""
    dealt = cut_lineage(_with_blocks(texts, 1), "blocks")
    links = cut_lineage(dealt.groupBy("root", "block").applyInPandas(_compare, "a long, b long"), "within")
    split = dealt.filter("blocks > 1").select("row", "root", "text")
    if not split.limit(1).count():
        return links.select(F.col("a").alias("row"), F.col("b").alias("copy_of"))
    firsts = split.join(links.select(F.col("b").alias("row")).distinct(), "row", "left_semi")
    between = _with_blocks(firsts, 2).groupBy("root", "block").applyInPandas(_compare, "a long, b long")
    links = links.unionByName(cut_lineage(between, "between"))

    def grouped(rows: DataFrame, found: DataFrame) -> DataFrame:
        roots = components(found).withColumnsRenamed({"node": "row", "root": "group"})
        return rows.join(roots, "row", "left").withColumn("group", F.coalesce("group", "row"))

    known = cut_lineage(grouped(dealt.select("row", "root", "block", "blocks"), links), "groups")
    open_roots = known.filter("blocks > 1").groupBy("root").agg(
        F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo <> hi").select("root")
    rest = known.join(open_roots, "root", "left_semi").join(dealt.select("row", "text"), "row")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    pairs = rest.select("root", "row", "group", "text", "block", other.alias("other")).filter("block <> other").select(
        "root", "row", "group", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    across = pairs.groupBy("root", "i", "j").applyInPandas(_compare_blocks, "a long, b long")
    links = links.unionByName(cut_lineage(across, "across"))
    return grouped(dealt.select("row"), links).select("row", F.col("group").alias("copy_of"))


def _bands_udf():
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([bands(t) for t in texts], dtype=object)
    return of


def _simhash_candidates(entries: DataFrame) -> DataFrame:
    """Candidates ``a, b``: rows to the first one of their fingerprint, and firsts of linked fingerprints."""
    points = cut_lineage(entries.groupBy("fp").agg(F.min("row").alias("first")), "points")
    same = entries.join(points, "fp").filter("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    end = lambda name: points.select(F.col("fp").alias(f"_{name}"), F.col("first").alias(name))
    linked = fingerprint_links(points).select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    return same.unionByName(linked.join(end("a"), "_a").join(end("b"), "_b").select("a", "b"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, with all its columns.

    Rows with a null id come last; of equal ids one row stays.
    """
    numbered = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(
        *[F.col(f"`{c}`") for c in docs.columns]).alias("rec")), "numbered")
    texts = numbered.select("row", F.col(f"rec.`{id_col}`").alias("id"), F.col(f"rec.`{text_col}`").alias("text")) \
        .select("row", "id", text_of().alias("text"))
    signed = cut_lineage(texts.select("row", _bands_udf()("text").alias("bands"),
                                      fingerprint_udf(SHINGLE)("text").alias("fp")), "bands")
    one = F.slice("bands", BANDS + 1, 2)
    alike = signed.groupBy(one.alias("same")).agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("n"))
    equal = cut_lineage(signed.select("row", one.alias("same")).join(alike.filter("n > 1"), "same")
                        .select("row", F.col("b").alias("entry")), "equal")
    entries = signed.join(equal.filter("row <> entry").select("row"), "row", "left_anti")
    dealt = entries.select("row", F.explode(F.slice("bands", 1, BANDS)).alias("bucket"))
    first = dealt.groupBy("bucket").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = dealt.join(first, "bucket").filter("row <> b").select(F.col("row").alias("a"), "b")
    roots = components(stars.unionByName(_simhash_candidates(entries.select("row", "fp"))))
    linked = cut_lineage(_linked(texts.select("row", "text").join(roots.withColumnRenamed("node", "row"), "row")), "linked")
    copies = equal.join(linked.withColumnRenamed("row", "entry"), "entry", "left") \
        .select("row", F.coalesce("copy_of", "entry").alias("copy_of"))
    found = cut_lineage(linked.join(equal.select("row"), "row", "left_anti").unionByName(copies), "compared")
    rank = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("row"))
    ranked = found.join(texts.select("row", "id"), "row").select("row", "copy_of", rank.alias("rank"))
    kept = ranked.groupBy("copy_of").agg(F.min("rank").alias("kept")).select("kept.row")
    dropped = found.select("row").join(kept, "row", "left_anti")
    return numbered.join(dropped, "row", "left_anti").select(*[F.col(f"rec.`{c}`") for c in docs.columns])
