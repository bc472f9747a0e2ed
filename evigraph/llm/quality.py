"""Quality scores: ridge regression on random Fourier features of document statistics.

Each text becomes a short vector of statistics. The features ``cos(w·x + b)`` approximate a
Gaussian kernel over them; every partition sums its share of the normal equations, Spark adds
the shares up, and one solve gives the ridge weights. Isotonic regression over binned scores
turns the ridge score into the share of good documents.

Defined cases: null and empty texts have the statistics of an empty text and get a score like
any other; label rows with a null id or a label other than 0 and 1 are not learnt from; an id
labelled twice counts twice; without usable labels every score is 0.5; extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import in_fold, text_of

FEATURES = 256
RIDGE = 1e-3
BINS = 2000
SEED = 20
_SENTENCE_END = (".", "!", "?", ":", ";", "…", '"')
_STATS = 19


def statistics(text: str) -> list[float]:
    """Scale-free statistics of a whole text; the first is its length on a log scale."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    at = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = at[65:91].sum(), at[97:123].sum(), at[48:58].sum()
    letters = max(1, upper + lower)
    blank, high = at[32] + at[9:14].sum(), at[128:].sum()
    stops, bangs = at[46] + at[44], at[33]
    symbols = n - (upper + lower + digits + blank + high + stops) if raw else 0
    words = text.split()
    count = max(1, len(words))
    seen = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    kinds = Counter(lines)
    n_lines = max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=len(words)) if words else np.zeros(1)
    packed = len(zlib.compress(raw, 1)) / n if raw else 1.0
    return [
        math.log1p(len(text)), math.log1p(count), lengths.mean(), lengths.std(),
        upper / letters, symbols / n, bangs / n, digits / n, blank / n, high / n, stops / n,
        at[124] / n, len(seen) / count, math.log1p(len(seen)) / math.log1p(count),
        max(seen.values(), default=0) / count,
        1 - len(kinds) / n_lines, max(kinds.values(), default=0) / n_lines if len(lines) > 1 else 0.0,
        sum(line.rstrip().endswith(_SENTENCE_END) for line in lines) / n_lines, packed]


def stats_udf():
    """Text column to statistics."""
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])
    return stats


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and its statistics, stored once for fitting and scoring."""
    return cut_lineage(docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                                   stats_udf()(text_of(text_col)).alias("stats")), "stats")


def _standard(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / spread, -6, 6)


def _features(x: np.ndarray, model: dict) -> np.ndarray:
    z = _standard(x, model["mean"], model["spread"])
    waves = np.cos(z @ model["waves"] + model["phase"]) * math.sqrt(2 / FEATURES)
    return np.hstack([waves, z, np.ones((len(z), 1))])


def raw_scores(x: np.ndarray, model: dict) -> np.ndarray:
    return _features(x, model) @ model["weights"]


def isotonic(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and the share of good rows in each block."""
    blocks: list[list[float]] = []      # sum of scores, good rows, rows
    for s, g, m in zip(score, good, n):
        blocks.append([s * m, g, m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top)]
    return (np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks]))


def calibrated(raw: np.ndarray, model: dict) -> np.ndarray:
    """Isotonic value with a slight slope, so that equal blocks keep the order of the ridge score."""
    flat = np.interp(raw, model["centres"], model["shares"])
    return np.clip(0.999 * flat + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _matrix(stats: pd.Series) -> np.ndarray:
    return np.array(stats.tolist(), dtype=np.float64).reshape(len(stats), _STATS)


def fit(stats: DataFrame, labels: DataFrame, label: str, held_out) -> dict | None:
    """The model from all labelled rows outside the held-out fold; ``None`` without any."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    rows = cut_lineage(stats.join(known, "doc_id").select("stats", "label"), "labelled")
    moments = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("spread")).collect()
    if not moments:
        return None
    moments = sorted(moments, key=lambda r: r["i"])
    rng = np.random.default_rng(SEED)
    model = {"mean": np.array([r["mean"] for r in moments]),
             "spread": np.array([r["spread"] or 1.0 for r in moments]),
             "waves": rng.normal(size=(_STATS, FEATURES)) * math.sqrt(2 / _STATS),
             "phase": rng.uniform(0, 2 * math.pi, FEATURES)}
    size = FEATURES + _STATS + 1
    upper = np.triu_indices(size + 1)

    def share(batches):
        total = np.zeros((size + 1, size + 1))
        for pdf in batches:
            if len(pdf):
                phi = np.hstack([_features(_matrix(pdf["stats"]), model),
                                 pdf["label"].to_numpy(dtype=np.float64)[:, None]])
                total += phi.T @ phi
        yield pd.DataFrame({"k": np.arange(len(upper[0])), "v": total[upper]})

    sums = rows.mapInPandas(share, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    gram = np.zeros((size + 1, size + 1))
    for r in sums.collect():
        gram[upper[0][r["k"]], upper[1][r["k"]]] = r["v"]
    gram = gram + np.triu(gram, 1).T
    n = max(1.0, gram[size - 1, size - 1])
    model["weights"] = np.linalg.solve(gram[:size, :size] + RIDGE * n * np.eye(size), gram[:size, size])

    def bins(batches):
        for pdf in batches:
            if len(pdf):
                raw = np.clip(raw_scores(_matrix(pdf["stats"]), model), -1, 2)
                yield pd.DataFrame({"bin": np.round(raw * BINS / 3).astype(int), "label": pdf["label"]})

    table = rows.mapInPandas(bins, "bin int, label int").groupBy("bin").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    cells = np.array([(r["bin"] * 3 / BINS, r["good"], r["n"]) for r in table], dtype=np.float64)
    model["centres"], model["shares"] = isotonic(*cells.T)
    return model


def score_udf(model: dict | None):
    """Stats column to calibrated score."""
    @F.pandas_udf("double")
    def score(stats: pd.Series) -> pd.Series:
        if model is None or not len(stats):
            return pd.Series([0.5] * len(stats))
        return pd.Series(calibrated(raw_scores(_matrix(stats), model), model))
    return score


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4,
            held_out_fold: int = 2) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    stats = with_stats(docs)
    model = fit(stats, labels, "quality", in_fold("doc_id", folds, held_out_fold))
    return stats.select("doc_id", in_fold("doc_id", folds, held_out_fold).alias("held_out"),
                        score_udf(model)("stats").alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4,
           held_out_fold: int = 2) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    model = fit(with_stats(docs), labels, "quality", in_fold("doc_id", folds, held_out_fold))
    return docs.filter(score_udf(model)(stats_udf()(text_of())) >= threshold)
