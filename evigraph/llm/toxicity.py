"""Toxicity scores: a convolutional text classifier trained in numpy.

Words are hashed to 32 bits; a hash that occurs in enough training documents has an embedding
row, all others share row 0. Filters one, two and three words wide run over the whole text, the
maximum of each filter over the text feeds a logistic unit. The score is calibrated for each
language, which is guessed from the letters of the text: 0.5 is the threshold with the best F1
of that language among the training rows.

The network is fitted on all labelled rows outside the held-out fold, read to their ends. Their words
are stored as hashes, dealt by id into parts of about ``PART_BYTES`` of text. ``EPOCHS`` passes are made
over seven eighths of the rows; the other eighth chooses the pass, and is learnt from in one more pass
after it. Several parts train side by side from the same network; after a pass their changes are
averaged, a word's over the parts that met it. Word counts and thresholds are counted over all parts, and
every word in ``MIN_DOCS`` training documents has an embedding row. The driver gets one network, 52 bytes
a word, and counts of logits; a part trains the rows of its own words only.

Defined cases: null and empty texts have no words and get the score of an empty text; label rows
with a null id or a label other than 0 and 1 are not learnt from; without rows of both labels
every score is 0.5 minus a bit, which predicts 0; extra columns are not read.
"""

from __future__ import annotations

import copy
import pickle
import zlib

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import bucketed
from .common import in_fold, text_of

PART_BYTES = 16 << 20   # bytes of training text one task learns from
MIN_DOCS = 4
BLOCK = 4096            # embedding rows that are averaged together
BIN = 0.01              # width of a bin of logits, between -LIMIT and LIMIT
LIMIT = 40.0
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH, BATCH_WORDS = 64, 150_000        # a step takes that many texts, or fewer if they are long
SEED = 4
#: Letters that tell the four languages of the corpus apart; texts without any count as English.
LETTERS = {"de": "äöüßÄÖÜ", "es": "ñíóáúÑÍÓÁÚ", "fr": "éèêçàâîôûÉÈÊÇÀ"}
LANGUAGES = ("en", *LETTERS)
_SPLIT = bytes(c if chr(c).isalnum() or c >= 128 or c == 39 else 32 for c in range(256))
_TEXTS = 1000           # texts a task holds as word rows at a time


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().encode("utf-8", "surrogatepass").translate(_SPLIT).split()
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))


def language(text: str) -> int:
    """Index into ``LANGUAGES``."""
    counts = [sum(map(text.count, letters)) for letters in LETTERS.values()]
    best = int(np.argmax(counts))
    return best + 1 if counts[best] * 200 > len(text) else 0


def _ranges(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _pad(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in one array, each with ``max(WIDTHS)`` zeros behind it and one more at the end, and their starts."""
    tail = np.zeros(max(WIDTHS), dtype=np.int32)
    flat = np.concatenate([x for d in docs for x in (d, tail)] + [tail[:1]])
    return flat, _ranges(np.array([len(d) + len(tail) for d in docs], dtype=np.int64))[:-1]


class Network:
    """Embeddings, one bank of filters per width, max pooling, a logistic unit; Adam."""

    def __init__(self, rows: int, prior: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.p = {"e": rng.normal(scale=0.05, size=(rows, DIM)).astype(np.float32),
                  "u": rng.normal(scale=0.1, size=FILTERS * len(WIDTHS)).astype(np.float32),
                  "b": np.zeros(1, dtype=np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(scale=0.25, size=(w * DIM, FILTERS)).astype(np.float32)
            self.p[f"c{w}"] = np.zeros(FILTERS, dtype=np.float32)
        self.p["e"][:, 0] = prior          # a start: how much more often the word is in toxic texts
        self.p["w1"][0, :2] = 1.0
        self.p["u"][:2] = 1.0
        self.p["e"][0] = 0
        self.begin()

    def begin(self) -> None:
        """Training starts from the weights as they are."""
        self.m, self.v = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.met, self.t = np.zeros(len(self.p["e"]), dtype=bool), 0

    def forward(self, flat: np.ndarray, starts: np.ndarray, keep: bool = False):
        p, n = self.p, len(flat) - max(WIDTHS) + 1
        # a document's last window starts right behind it; later ones would reach into the next document
        ends = np.append(starts[1:], len(flat) - 1) - max(WIDTHS) + 1
        cuts = np.stack([starts, ends], axis=1).ravel()
        # each word of these texts meets each piece of the filters once, a window adds up its words' products
        place = np.zeros(len(p["e"]), dtype=np.int32)
        place[flat] = 1
        met = np.flatnonzero(place)
        place[met] = np.arange(len(met))
        pieces = np.hstack([p[f"w{w}"][o * DIM:(o + 1) * DIM] for w in WIDTHS for o in range(w)])
        product, x, at = (p["e"][met] @ pieces)[place[flat]], np.empty((n, FILTERS * len(WIDTHS)), dtype=np.float32), 0
        for k, w in enumerate(WIDTHS):
            mine = x[:, k * FILTERS:(k + 1) * FILTERS]
            mine[:] = product[:n, at:at + FILTERS]
            for o in range(1, w):
                mine += product[o:o + n, at + o * FILTERS:at + (o + 1) * FILTERS]
            at += w * FILTERS
        # tanh grows with its argument, so it is taken of the maximum
        h = np.tanh(np.maximum.reduceat(x, cuts, axis=0)[::2] + np.hstack([p[f"c{w}"] for w in WIDTHS]))
        where = None
        if keep:
            top = np.stack([s + np.argmax(x[s:t], axis=0) for s, t in zip(starts, ends)])
            where = [top[:, k * FILTERS:(k + 1) * FILTERS] for k in range(len(WIDTHS))]
        return h, h @ p["u"] + p["b"][0], where

    def step(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        flat, starts = _pad(docs)
        h, z, where = self.forward(flat, starts, keep=True)
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        d = (weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
        g["u"], g["b"][0] = h.T @ d + 1e-4 * p["u"], d.sum()
        back = d[:, None] * p["u"][None, :] * (1 - h * h)
        for k, w in enumerate(WIDTHS):
            mine = back[:, k * FILTERS:(k + 1) * FILTERS]
            g[f"c{w}"] = mine.sum(axis=0)
            for o in range(w):
                ids = flat[where[k] + o]
                rows, cut = p["e"][ids], slice(o * DIM, (o + 1) * DIM)
                g[f"w{w}"][cut] = np.einsum("nfd,nf->df", rows, mine) + 1e-4 * p[f"w{w}"][cut]
                self.met[ids] = True
                np.add.at(g["e"], ids, mine[:, :, None] * p[f"w{w}"][cut].T[None])
        g["e"][0] = 0
        self.t += 1
        for k in p:
            # an embedding row without any gradient so far has no momentum either and stays
            rows = np.flatnonzero(self.met) if k == "e" else slice(None)
            change = g[k][rows]
            self.m[k][rows] = m = 0.9 * self.m[k][rows] + 0.1 * change
            self.v[k][rows] = v = 0.999 * self.v[k][rows] + 0.001 * change ** 2
            p[k][rows] -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-7)
        np.maximum(p["u"], 0, out=p["u"])     # words can speak for toxicity only, never against it

    def logits(self, docs: list[np.ndarray], batch: int = 20_000) -> np.ndarray:
        """Scores of documents in blocks of at most ``batch`` words, or one document if longer."""
        out, block, size = [], [], 0
        for d in [*docs, None]:
            if block and (d is None or size + len(d) > batch):
                out.append(self.forward(*_pad(block))[1])
                block, size = [], 0
            if d is not None:
                block.append(d)
                size += len(d) + max(WIDTHS)
        return np.concatenate(out) if out else np.zeros(0)


def rows_of(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Embedding rows of word hashes, from 1; 0 for those that the sorted ``vocabulary`` does not have."""
    out = np.zeros(len(hashes), dtype=np.int32)
    if not len(vocabulary):
        return out
    # the leading bits lead to the few words that have them, which are looked at one after the other
    bits = min(24, (2 * len(vocabulary)).bit_length())
    shift = np.uint32(32 - bits)
    first = _ranges(np.bincount(vocabulary >> shift, minlength=1 << bits)).astype(np.int32)
    lead = hashes >> shift
    at, end = first[lead], first[1:][lead]
    left = np.flatnonzero(at < end)
    at, end, wanted = at[left], end[left], hashes[left]
    while len(left):
        hit = vocabulary[at] == wanted
        out[left[hit]] = at[hit] + 1
        at += 1
        more = ~hit & (at < end)
        left, at, end, wanted = left[more], at[more], end[more], wanted[more]
    return out


def _as_rows(hashes: list[np.ndarray], vocabulary: np.ndarray) -> list[np.ndarray]:
    """``rows_of`` of some texts."""
    if not hashes:
        return []
    return np.split(rows_of(np.concatenate(hashes), vocabulary), np.cumsum([len(h) for h in hashes])[:-1])


def _best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The middle of the logits whose weighted F1 as a threshold is next to the best."""
    order = np.argsort(-z, kind="stable")
    z, hit, all_ = z[order], np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + max(1e-9, (weight * y).sum()))
    good = np.flatnonzero(f1 >= f1.max() - 0.004)
    low = z[min(good[-1] + 1, len(z) - 1)]
    return float((z[good[0]] + low) / 2)


def _batches(order: np.ndarray, sizes: np.ndarray):
    """Consecutive rows of ``order``, at most ``BATCH``, or ``BATCH_WORDS`` words if there are several."""
    part, words = [], 0
    for i in order.tolist():
        if part and (len(part) == BATCH or words + sizes[i] > BATCH_WORDS):
            yield part
            part, words = [], 0
        part.append(i)
        words += sizes[i]
    if part:
        yield part


def _prior(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How much more often a word is in toxic texts, from the texts of either label that have it."""
    rate = counts / np.maximum(1, totals)
    spread = np.sqrt((rate * (1 - rate) / np.maximum(1, totals)).sum(axis=0) + 1e-6)
    return np.clip((rate[1] - rate[0]) / spread / 8 - 0.5, -1.5, 3).astype(np.float32)


def train(hashes: list[np.ndarray], tongues: np.ndarray, y: np.ndarray, share: float) -> dict:
    """The network and its thresholds; ``share`` is the share of label 1 among all labels."""
    seen = np.concatenate([np.unique(h) for h in hashes])
    words, in_docs = np.unique(seen, return_counts=True)
    words = words[in_docs >= MIN_DOCS]
    docs = _as_rows(hashes, words)
    counts = np.zeros((2, len(words) + 1))
    for d, label in zip(docs, y):
        counts[label, np.unique(d)] += 1
    prior = _prior(counts, np.bincount(y, minlength=2)[:, None])
    net, rng = Network(len(words) + 1, prior), np.random.default_rng(SEED)
    natural = np.where(y == 1, share / max(1e-9, y.mean()), (1 - share) / max(1e-9, 1 - y.mean()))
    check = rng.permutation(len(docs)) < len(docs) // 8
    used, sizes = np.flatnonzero(~check), np.array([len(d) for d in docs])

    def learn(order, epoch):
        for part in _batches(order, sizes):
            net.step([docs[i] for i in part], y[part], np.sqrt(natural[part]), 0.01 * 0.8 ** epoch)

    least = np.inf
    for epoch in range(EPOCHS):
        learn(rng.permutation(used), epoch)
        z = net.logits([docs[i] for i in np.flatnonzero(check)])
        loss = (natural[check] * np.logaddexp(0, np.where(y[check] == 1, -z, z))).sum()
        if loss <= least:                   # without rows to choose by, the last
            least, best, chosen = loss, copy.deepcopy(net), epoch
    net = best
    learn(rng.permutation(np.flatnonzero(check)), chosen + 1)
    z = net.logits(docs)
    overall = _best_threshold(z, y, natural)
    cut = np.full(len(LANGUAGES), overall)
    for k in range(len(LANGUAGES)):
        mine = tongues == k
        if min(np.bincount(y[mine], minlength=2)) >= 30:
            cut[k] = _best_threshold(z[mine], y[mine], natural[mine])
    return {"words": words, "p": net.p, "cut": cut}


def _apply(texts: pd.Series, model: dict | None) -> np.ndarray:
    if model is None or not len(texts):
        return np.full(len(texts), 0.499)
    net = Network.__new__(Network)
    net.p = model["p"]
    z = np.concatenate([net.logits(_as_rows([word_hashes(t) for t in texts.iloc[k:k + _TEXTS]], model["words"]))
                        for k in range(0, len(texts), _TEXTS)])
    tongues = np.fromiter(map(language, texts), dtype=np.int64, count=len(texts))
    return 1 / (1 + np.exp(-np.clip(z - model["cut"][tongues], -30, 30)))


def fitting(sizes: pd.DataFrame, words_per_class: int) -> list[tuple]:
    """``label, turn`` of the rows ``label, turn, n`` whose words fit into the total of their label, by ``turn``.

    For trials on a bounded share of the rows; ``fit`` learns from all of them.
    """
    taken, left = [], {0: words_per_class, 1: words_per_class}
    for r in sizes.sort_values("turn").itertuples():
        if r.n <= left[r.label]:
            left[r.label] -= r.n
            taken.append((int(r.label), int(r.turn)))
    return taken


def _unpacked(pdf: pd.DataFrame) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(z), dtype=np.uint32) for z in pdf["words"]]


def _in_order(pdf: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """The rows of a part and their word hashes, in the same order in every run."""
    hashes = _unpacked(pdf)
    order = pdf.assign(raw=[h.tobytes() for h in hashes]).reset_index(drop=True) \
        .sort_values(["doc_id", "label", "raw"]).index
    return pdf.iloc[order], [hashes[i] for i in order]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, part_bytes: int) -> tuple[DataFrame, int]:
    """``part, doc_id, label, words, tongue`` of every training row, bucketed by part, and the number of parts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    texts = docs.filter(F.col("doc_id").isNotNull() & ~held_out).select("doc_id", text_of().alias("text"))
    size = texts.select("doc_id", F.octet_length("text").cast("long").alias("n")).join(known, "doc_id").agg(F.sum("n"))
    parts = max(1, -(-(size.first()[0] or 0) // part_bytes))

    @F.pandas_udf("binary")
    def pack(texts: pd.Series) -> pd.Series:
        small = zstandard.ZstdCompressor(level=1)
        return pd.Series([small.compress(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=object)

    @F.pandas_udf("struct<words: binary, tongue: int>")
    def encode(packed: pd.Series) -> pd.DataFrame:
        small, unpack, rows = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor(), []
        for z in packed:
            text = unpack.decompress(z).decode("utf-8", "surrogatepass")
            rows.append((small.compress(word_hashes(text).tobytes()), language(text)))
        return pd.DataFrame(rows, columns=["words", "tongue"])

    # both sides grow with the table, so the plan is the one of large tables at every size
    rows = texts.select("doc_id", pack("text").alias("packed")).join(known.hint("merge"), "doc_id").select(
        F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), "doc_id", "label", encode("packed").alias("x"))
    return bucketed(rows.select("part", "doc_id", "label", "x.*"), ["part"], "training"), parts


def word_counts(rows: DataFrame, least: int) -> pd.DataFrame:
    """``word, n0, n1``: in how many training rows of either label a word occurs, where that is ``least`` or more in all."""
    def count(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            seen, y = [np.unique(h) for h in _unpacked(pdf)], pdf["label"].to_numpy()
            words, at = np.unique(np.concatenate(seen), return_inverse=True)
            toxic = np.repeat(y == 1, [len(w) for w in seen])
            n1 = np.bincount(at[toxic], minlength=len(words))
            yield pd.DataFrame({"word": words.astype(np.int64), "n0": np.bincount(at, minlength=len(words)) - n1, "n1": n1})

    return (rows.select("label", "words").mapInPandas(count, "word long, n0 long, n1 long").groupBy("word")
            .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least)
            .toArrow().to_pandas().sort_values("word"))


def _blocks_of(net: Network, start: dict, at: np.ndarray | None = None) -> pd.DataFrame:
    """What training changed: embedding rows that moved, by block, and all other weights as block -1.

    ``at`` has the places of the network's embedding rows among all words, if they are not all of them.
    """
    other = np.concatenate([(net.p[k] - start[k]).ravel() for k in sorted(start) if k != "e"])
    out = [(-1, b"", other.astype(np.float32).tobytes())]
    change = net.p["e"] - start["e"]
    moved = np.flatnonzero(change.any(axis=1))
    change = change[moved]
    moved = moved if at is None else at[moved]
    for block in np.unique(moved // BLOCK).tolist():
        mine = moved // BLOCK == block
        out.append((block, moved[mine].astype(np.int32).tobytes(), change[mine].astype(np.float32).tobytes()))
    return pd.DataFrame(out, columns=["block", "places", "change"])


def _mean_change(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of the changes of a block, of each embedding row over the parts that moved it."""
    pdf = pdf.sort_values(["places", "change"])         # so that the sum has one order
    block = int(pdf["block"].iloc[0])
    if block < 0:
        mean = np.mean([np.frombuffer(c, dtype=np.float32) for c in pdf["change"]], axis=0, dtype=np.float64)
        return pd.DataFrame({"block": [block], "places": [b""], "change": [mean.astype(np.float32).tobytes()]})
    total, n = np.zeros((BLOCK, DIM)), np.zeros(BLOCK)
    for places, change in zip(pdf["places"], pdf["change"]):
        at = np.frombuffer(places, dtype=np.int32) - block * BLOCK
        total[at] += np.frombuffer(change, dtype=np.float32).reshape(-1, DIM)
        n[at] += 1
    at = np.flatnonzero(n)
    mean = (total[at] / n[at, None]).astype(np.float32)
    return pd.DataFrame({"block": [block], "places": [(at + block * BLOCK).astype(np.int32).tobytes()],
                         "change": [mean.tobytes()]})


def _changed(p: dict, blocks: pd.DataFrame) -> dict:
    p = {k: v.copy() for k, v in p.items()}
    for block, places, change in blocks.itertuples(index=False):
        change = np.frombuffer(change, dtype=np.float32)
        if block >= 0:
            p["e"][np.frombuffer(places, dtype=np.int32)] += change.reshape(-1, DIM)
            continue
        at = 0
        for k in sorted(p):
            if k != "e":
                p[k] += change[at:at + p[k].size].reshape(p[k].shape)
                at += p[k].size
    return p


def _own_words(hashes: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places in ``known`` of the words of some texts, and the texts as numbers of those, from 1; 0 for other words."""
    rows = _as_rows(hashes, known)
    number = np.zeros(len(known) + 1, dtype=np.int32)
    for r in rows:
        number[r] = 1
    number[0] = 0
    places = np.flatnonzero(number)
    number[places] = np.arange(1, len(places) + 1)
    return places, [number[r] for r in rows]


def _part_network(p: dict, places: np.ndarray) -> Network:
    """A network with the embedding rows 0 and ``places`` of ``p``; no other row of a part would move."""
    mine = Network.__new__(Network)
    mine.p = {k: v.copy() if k != "e" else v[np.append(0, places)] for k, v in p.items()}
    mine.begin()
    return mine


def train_in_parts(rows: DataFrame, share: float, counted: tuple[int, int]) -> dict:
    """The network and its thresholds from all parts of ``training_rows``; ``counted`` are the rows of either label."""
    spark = rows.sparkSession
    table = word_counts(rows, MIN_DOCS)
    words = table["word"].to_numpy(dtype=np.uint32)
    counts = np.vstack([np.zeros((1, 2)), table[["n0", "n1"]].to_numpy(dtype=np.float64)]).T
    p = Network(len(words) + 1, _prior(counts, np.array(counted)[:, None])).p
    held = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(8)) == 0

    def one_pass(some: DataFrame, p: dict, turn: int) -> dict:
        shared = spark.sparkContext.broadcast((words, p))

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            part, (pdf, hashes) = int(pdf["part"].iloc[0]), _in_order(pdf)
            known, start = shared.value
            places, docs = _own_words(hashes, known)
            mine = _part_network(start, places)
            start = {k: v.copy() for k, v in mine.p.items()}
            y = pdf["label"].to_numpy(dtype=np.int64)
            # as if both labels were as frequent and then weighed by the root of their shares
            weight = np.sqrt(0.5 / np.where(y == 1, share, 1 - share))
            order = np.random.default_rng([SEED, part, turn]).permutation(len(docs))
            for few in _batches(order, np.array([len(d) for d in docs])):
                mine.step([docs[i] for i in few], y[few], weight[few], 0.01 * 0.8 ** turn)
            return _blocks_of(mine, start, np.append(0, places))

        changes = some.groupBy("part").applyInPandas(learn, "block int, places binary, change binary")
        p = _changed(p, changes.groupBy("block").applyInPandas(_mean_change, changes.schema).toArrow().to_pandas())
        shared.destroy()
        return p

    def loss(p: dict) -> float:
        shared = spark.sparkContext.broadcast((words, p))

        def add(batches):
            known, p = shared.value
            mine, total = Network.__new__(Network), 0.0
            mine.p = p
            for pdf in batches:
                z = mine.logits(_as_rows(_unpacked(pdf), known))
                total += np.logaddexp(0, np.where(pdf["label"] == 1, -z, z)).sum()
            yield pd.DataFrame({"loss": [total]})

        total = rows.filter(held).select("label", "words").mapInPandas(add, "loss double").agg(F.sum("loss")).first()[0]
        shared.destroy()
        return total

    least, tried = np.inf, p
    for turn in range(EPOCHS):
        tried = one_pass(rows.filter(~held), tried, turn)
        if (now := loss(tried)) <= least:
            least, p, chosen = now, tried, turn
    p = one_pass(rows.filter(held), p, chosen + 1)
    shared = spark.sparkContext.broadcast((words, p))

    def logits(batches):
        known, p = shared.value
        mine = Network.__new__(Network)
        mine.p = p
        for pdf in batches:
            if len(pdf):
                z = mine.logits(_as_rows(_unpacked(pdf), known))
                yield pd.DataFrame({"tongue": pdf["tongue"], "label": pdf["label"],
                                    "bin": np.round(np.clip(z, -LIMIT, LIMIT) / BIN).astype(int)})

    bins = rows.select("tongue", "label", "words").mapInPandas(logits, "tongue int, label int, bin int") \
        .groupBy("tongue", "label", "bin").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas() \
        .sort_values(["bin", "label", "tongue"])
    z, y, n = bins["bin"].to_numpy() * BIN, bins["label"].to_numpy(), bins["n"].to_numpy(dtype=np.float64)
    cut = np.full(len(LANGUAGES), _best_threshold(z, y, n))
    for k in range(len(LANGUAGES)):
        mine = (bins["tongue"] == k).to_numpy()
        if min(n[mine & (y == label)].sum() for label in (0, 1)) >= 30:
            cut[k] = _best_threshold(z[mine], y[mine], n[mine])
    return {"words": words, "p": p, "cut": cut}


def fit(docs: DataFrame, labels: DataFrame, label: str, held_out, part_bytes: int = PART_BYTES) -> dict | None:
    """The model from all labelled rows outside the held-out fold; ``None`` without rows of both labels."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out)
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    rows, parts = training_rows(docs, labels, label, held_out, part_bytes)
    counted = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counted) < 2:
        return None
    if parts > 1:
        return train_in_parts(rows, share, (counted[0], counted[1]))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, hashes = _in_order(pdf)
        model = train(hashes, pdf["tongue"].to_numpy(), pdf["label"].to_numpy(dtype=np.int64), share)
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    return pickle.loads(rows.groupBy("part").applyInPandas(whole, "model binary").first()[0])


def score_udf(spark, model: dict | None):
    """Text column to score; the model travels once per executor."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(_apply(texts, shared.value))
    return score


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Per document: ``doc_id, held_out, score, predicted``."""
    held_out = in_fold("doc_id", folds, held_out_fold)
    model = fit(docs, labels, "toxic", held_out)
    return docs.select("doc_id", held_out.alias("held_out"),
                       score_udf(docs.sparkSession, model)(text_of()).alias("score")) \
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
