"""Packing of token sequences into windows by non-negative least squares.

A document's ids and an end id are cut into whole windows and a rest. How many rests there are
of each length is a histogram of at most ``window - 1`` numbers. Combinations of two or three
lengths that fill a window exactly are the columns of a matrix; non-negative least squares finds
how often each is to be repeated, the counts are rounded to what the histogram holds, and rests
are dealt to the combinations by their number within their length. What is left is laid end to
end and cut at window ends, greedily; the last, incomplete window is cut into powers of two,
which need no padding. So only left-over rests are ever cut, and no window is padded.

Defined cases: a null or empty text is just its end id; texts are encoded to their end; rows
with a null id or a repeated id are packed like others and keep their id; an empty table gives
no pieces; extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .bpe import WORDS, Vocabulary, load
from .common import cached, text_of

WINDOW = 2048
END = 1
COMMON = 48             # lengths that may be the middle part of a combination of three
ROUNDS = 400            # gradient steps of the least-squares solver
SLICE = 50_000          # rows that are numbered by one task


def fast_encoder(content: bytes):
    """Ids of a text by tiktoken on the tokenizer file's vocabulary, the same ids at higher speed.

    A text that its regular expressions give up on goes through our own encoder.
    """
    import tiktoken

    vocabulary = Vocabulary(content)
    ranks = {b: i for i, b in enumerate(vocabulary.bytes_of) if b and i not in set(vocabulary.added.values())}
    fast = tiktoken.Encoding("packing", pat_str=WORDS, mergeable_ranks=ranks, special_tokens=vocabulary.added)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except BaseException as error:      # the library's panics are no ordinary exceptions
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.frombuffer(vocabulary.encode(text), dtype="<u4")
    return encode


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, path: str, window: int = WINDOW, end: int = END,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its length in ids, checksums of its whole windows, and its rest.

    Documents are encoded once; the rests are stored, as a rest may yet have to be cut.
    """
    shared = load(docs.sparkSession, path)

    @F.pandas_udf("struct<doc_tokens: long, crcs: array<long>, rest: int, rest_crc: long, rest_ids: binary>")
    def parts(texts: pd.Series) -> pd.DataFrame:
        encode = cached(("packing", zlib.crc32(shared.value)), lambda: fast_encoder(shared.value))
        rows = []
        for text in texts:
            ids = np.append(encode(text), np.uint32(end)).astype("<u4")
            cut = len(ids) - len(ids) % window
            rest = ids[cut:]
            small = rest.astype("<u2") if not len(rest) or rest.max() < 1 << 16 else rest
            rows.append((len(ids), [_crc(ids[k:k + window]) for k in range(0, cut, window)],
                         len(rest), _crc(rest), small.tobytes()))
        return pd.DataFrame(rows, columns=["doc_tokens", "crcs", "rest", "rest_crc", "rest_ids"])

    return cut_lineage(docs.select(F.col(f"`{id_col}`").alias("doc_id"), parts(text_of(text_col)).alias("x"))
                       .select("doc_id", "x.*").withColumn("row", F.monotonically_increasing_id()), "tokenized")


def combinations(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of two or three lengths (0: none) that fill the window and occur in the histogram."""
    lengths = np.flatnonzero(histogram)
    pairs = lengths[(lengths <= window - lengths) & (histogram[window - lengths] > 0)]
    out = [np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1)]
    common = lengths[np.argsort(-histogram[lengths], kind="stable")[:COMMON]]
    for b in common:
        a = window - b - lengths
        ok = (a > 0) & (a <= lengths) & (histogram[np.maximum(a, 0)] > 0)
        out.append(np.sort(np.stack([a[ok], np.full(ok.sum(), b), lengths[ok]], axis=1), axis=1))
    return np.unique(np.concatenate(out), axis=0)


def nnls(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``x >= 0`` with small ``|A x - target|``; column ``j`` of ``A`` counts the lengths in row ``j``.

    Accelerated projected gradient; the products with ``A`` are gathers and counts, as a column
    has three entries at most. Residuals of a length are weighed by its count, so that rare and
    frequent lengths are met equally well.
    """
    scale = 1 / np.sqrt(np.maximum(1, target))
    used = columns > 0

    def times(x):
        total = np.bincount(columns.ravel(), weights=np.repeat(x, columns.shape[1]), minlength=len(target))
        total[0] = 0
        return total

    def transposed(r):
        return np.where(used, r[columns], 0).sum(axis=1)

    v = np.ones(len(columns))
    for _ in range(30):                                     # largest eigenvalue, by power iteration
        w = transposed(scale ** 2 * times(v))
        v = w / max(1e-300, np.linalg.norm(w))
    step = 1 / max(1e-12, 1.05 * v @ transposed(scale ** 2 * times(v)))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(ROUNDS):
        new = np.maximum(0, y - step * transposed(scale ** 2 * (times(y) - target)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[pd.DataFrame, int]:
    """Which rests of each length go where: rows ``length, lo, hi, sequence, offset``.

    The rest with number ``n`` (``lo <= n < hi``) of its length goes to window
    ``sequence + n - lo`` at ``offset``. Also the number of windows.
    """
    columns = combinations(histogram, window)
    left, taken = histogram.astype(np.int64).copy(), np.zeros(len(histogram), dtype=np.int64)
    left[0] = 0
    rows, sequences = [], 0
    if len(columns):
        wanted = nnls(columns, np.where(np.arange(len(left)) > 0, histogram, 0).astype(float))
        repeats = np.zeros(len(columns), dtype=np.int64)
        for limit in (np.round(wanted).astype(np.int64), None):     # as solved, then what still fits
            for j in np.argsort(-wanted, kind="stable"):
                lengths, often = np.unique(columns[j][columns[j] > 0], return_counts=True)
                room = int((left[lengths] // often).min())
                n = room if limit is None else min(room, int(limit[j]))
                left[lengths] -= n * often
                repeats[j] += n
        for j in np.flatnonzero(repeats):
            offset, n = 0, int(repeats[j])
            for length in columns[j][columns[j] > 0][::-1]:
                rows.append((int(length), int(taken[length]), int(taken[length]) + n, sequences, offset))
                taken[length] += n
                offset += int(length)
            sequences += n
    table = pd.DataFrame(rows, columns=["length", "lo", "hi", "sequence", "offset"])
    return table.sort_values(["length", "lo"], ignore_index=True).astype(np.int64), sequences


def _place_udf(table: pd.DataFrame):
    """Length and number of a rest to its window and offset; null for what is left over."""
    starts = table["length"].to_numpy() * (1 << 48) + table["lo"].to_numpy()

    @F.pandas_udf("struct<sequence: long, offset: int>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"sequence": pd.array([pd.NA] * len(length), dtype="Int64"),
                            "offset": pd.array([pd.NA] * len(length), dtype="Int64")})
        if len(table) and len(length):
            key = length.to_numpy(dtype=np.int64) * (1 << 48) + number.to_numpy(dtype=np.int64)
            at = np.maximum(np.searchsorted(starts, key, side="right") - 1, 0)
            hit = table.iloc[at].reset_index(drop=True)
            ok = (hit["length"] == length.to_numpy()) & (hit["lo"] <= number.to_numpy()) & (number.to_numpy() < hit["hi"])
            out.loc[ok, "sequence"] = (hit["sequence"] + number.to_numpy() - hit["lo"])[ok]
            out.loc[ok, "offset"] = hit["offset"][ok]
        return out
    return place


def _numbered(rests: DataFrame, slices: int) -> DataFrame:
    """``number`` of each rest among those of its length, without one task per length."""
    sliced = rests.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)))
    counts = sliced.groupBy("slice", "rest").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("rest").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("slice", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("slice", "rest").orderBy("row")) - 1
    return sliced.withColumn("own", own).join(offsets, ["slice", "rest"]) \
        .select("row", "slice", "rest", (F.col("own") + F.col("base")).alias("number"))


def _ends(total: int, window: int) -> list[tuple[int, int]]:
    """Start and length of the sequences of the last, incomplete window: powers of two."""
    at, out = total - total % window, []
    for power in range(window.bit_length() - 1, -1, -1):
        if total - at >= 1 << power:
            out.append((at, 1 << power))
            at += 1 << power
    return out


def _cut_udf(total: int, window: int):
    """Position and length of a left-over rest to its pieces."""
    tail = _ends(total, window)
    whole = total // window

    def cuts(at: int, length: int) -> list[tuple[int, int, int, int]]:
        out, start = [], 0
        while start < length:
            here = at + start
            if here < whole * window:
                first, size, which = here - here % window, window, here // window
            else:
                k = max(i for i, (first, _) in enumerate(tail) if first <= here)
                (first, size), which = tail[k], whole + k
            n = min(length - start, first + size - here)
            out.append((start, n, which, here - first))
            start += n
        return out

    @F.pandas_udf("array<struct<start: long, length: long, sequence: long, offset: long, crc: long>>")
    def pieces(at: pd.Series, length: pd.Series, crc: pd.Series, ids: pd.Series) -> pd.Series:
        rows = []
        for a, n, whole_crc, raw in zip(at, length, crc, ids):
            parts = cuts(int(a), int(n))
            tokens = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4") if len(parts) > 1 else None
            rows.append([{"start": s, "length": m, "sequence": q, "offset": o,
                          "crc": int(whole_crc) if tokens is None else _crc(tokens[s:s + m])}
                         for s, m, q, o in parts])
        return pd.Series(rows, dtype=object)
    return pieces


def pack_tokens(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pieces of the documents in a table made by ``tokenized``."""
    spark = tokens.sparkSession
    rests = tokens.filter("rest > 0")
    counts = {r["rest"]: r["count"] for r in rests.groupBy("rest").count().collect()}
    histogram = np.zeros(window, dtype=np.int64)
    for length, n in counts.items():
        histogram[length] = n
    table, planned = plan(histogram, window)
    slices = max(1, -(-int(histogram.sum()) // SLICE))
    place = _place_udf(table)(F.col("rest"), F.col("number"))
    placed = cut_lineage(_numbered(rests.select("row", "rest"), slices)
                         .withColumn("to", place).select("row", "rest", "to.sequence", "to.offset"), "placed")

    # left-over rests and whole windows are numbered by running sums, slice by slice
    joined = tokens.select("row", "doc_id", "doc_tokens", "crcs", "rest", "rest_crc").join(
        placed.select("row", "sequence", "offset"), "row", "left")
    sliced = joined.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))) \
        .withColumn("loose", F.when(F.col("sequence").isNull(), F.col("rest")).otherwise(0)) \
        .withColumn("full", F.size("crcs"))
    sliced = cut_lineage(sliced, "sliced")
    totals = sorted(sliced.groupBy("slice").agg(F.sum("loose").alias("loose"), F.sum("full").alias("full")).collect())
    bases, loose, full = [], 0, 0
    for r in totals:
        bases.append((r["slice"], loose, full))
        loose, full = loose + r["loose"], full + r["full"]
    base = spark.createDataFrame(bases, "slice long, loose_base long, full_base long")
    run = Window.partitionBy("slice").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ready = sliced.join(base, "slice") \
        .withColumn("at", F.col("loose_base") + F.coalesce(F.sum("loose").over(run), F.lit(0))) \
        .withColumn("first", F.col("full_base") + F.coalesce(F.sum("full").over(run), F.lit(0)))
    ready = cut_lineage(ready, "ready")

    loose_first = planned
    full_first = planned + loose // window + len(_ends(loose, window))
    whole = ready.filter("full > 0").select(
        "doc_id", "doc_tokens", "first", F.posexplode("crcs").alias("k", "crc")).select(
        "doc_id", (F.col("k") * window).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"), "doc_tokens",
        (F.col("first") + F.col("k") + full_first).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest_start = F.col("doc_tokens") - F.col("rest")
    fitted = ready.filter("sequence IS NOT NULL").select(
        "doc_id", rest_start.alias("start"), F.col("rest").cast("long").alias("length"),
        F.col("rest_crc").alias("ids_crc32"), "doc_tokens", F.col("sequence").alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"))
    left = ready.filter("loose > 0").select("row", "doc_id", "doc_tokens", "rest", "rest_crc", "at") \
        .join(tokens.select("row", "rest_ids"), "row")
    cut = left.select("doc_id", "doc_tokens", "rest", F.explode(
        _cut_udf(loose, window)("at", "rest", "rest_crc", "rest_ids")).alias("p")).select(
        "doc_id", (rest_start + F.col("p.start")).alias("start"), "p.length",
        F.col("p.crc").alias("ids_crc32"), "doc_tokens",
        (F.col("p.sequence") + loose_first).alias("sequence_id"), "p.offset")
    return whole.unionByName(fitted).unionByName(cut)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    return pack_tokens(tokenized(docs, path, window, end), window)
