"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one last token its encoding can end with. An
automaton over all tokens gives, at each position, the longest token that ends there and the
shorter ones behind it; the one whose boundary with the last token of the remaining prefix no
merge would ever cross is the answer, and back-pointers then spell the ids. The time is linear
in the length of a word, however long it is.

The vocabulary is read from a tokenizer file on the driver and travels to the executors once.

Defined cases: a null text counts as empty and has no ids; texts are encoded to their end; the
strings of added tokens in a text become their ids; ids outside the vocabulary decode to
nothing; bytes that are not UTF-8 decode to U+FFFD; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, text_of

#: Fixed: the word pattern of byte-level vocabularies of this kind.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_WORDS = 400_000
MEMO_PAIRS = 400_000
MEMO_LENGTH = 64        # longer words are rare and large, so they are not remembered
FOREVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and the automaton of one tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        letters = byte_letters()
        raw = lambda word: bytes(letters[c] for c in word)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(w): i for w, i in spec["model"]["vocab"].items() if w not in self.added}
        size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for word, i in [*ids.items(), *((w.encode(), i) for w, i in self.added.items())]:
            self.bytes_of[i] = word
        self.length = [len(b) for b in self.bytes_of]
        self.rank, self.parts = [-1] * size, [None] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b = ids[raw(left)], ids[raw(right)]
            whole = ids[self.bytes_of[a] + self.bytes_of[b]]
            self.merge_rank[a, b] = rank
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = rank, (a, b)
        self._spines: tuple[dict, dict] = ({}, {})
        self._fit: dict[tuple[int, int], bool] = {}
        self._build_automaton({w: i for w, i in ids.items() if self._reachable(i)})
        self.words = regex.compile(WORDS)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Pieces of ``token`` at its right (0) or left (1) edge and the rank that ends each."""
        known = self._spines[side].get(token)
        if known is None:
            known, ends, piece = [], FOREVER, token
            while True:
                known.append((piece, ends))
                if self.parts[piece] is None:
                    break
                ends, piece = self.rank[piece], self.parts[piece][1 - side]
            self._spines[side][token] = known
        return known

    def _crosses(self, a: int, b: int, skip: tuple[int, int] | None = None) -> bool:
        """Whether some merge joins the edges of ``a`` and ``b`` while both pieces are there.

        Of two equal merges the left one comes first: one inside ``a`` beats the boundary, the
        boundary beats one inside ``b``.
        """
        for x, x_ends in self.spine(a, 0):
            for y, y_ends in self.spine(b, 1):
                rank = self.merge_rank.get((x, y))
                if rank is not None and rank < x_ends and rank <= y_ends and (x, y) != skip:
                    return True
        return False

    def _reachable(self, token: int) -> bool:
        parts = self.parts[token]
        return parts is None or not self._crosses(*parts, skip=parts)

    def fits(self, a: int, b: int) -> bool:
        """Whether ``a`` can be followed by ``b`` in an encoding."""
        known = self._fit.get((a, b))
        if known is None:
            if len(self._fit) >= MEMO_PAIRS:
                self._fit.clear()
            known = self._fit[a, b] = not self._crosses(a, b)
        return known

    def _build_automaton(self, ids: dict[bytes, int]) -> None:
        """Trie of the tokens with suffix links; each state knows the longest token it ends with."""
        goto: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for word, token in ids.items():
            state = 0
            for c in word:
                step = goto[state].get(c)
                if step is None:
                    step = goto[state][c] = len(goto)
                    goto.append({})
                    ends.append(-1)
                state = step
            ends[state] = token
        link, longest = [0] * len(goto), list(ends)
        self.shorter = [-1] * len(self.bytes_of)
        queue = list(goto[0].values())
        for state in queue:
            for c, child in goto[state].items():
                back = link[state]
                while back and c not in goto[back]:
                    back = link[back]
                link[child] = goto[back].get(c, 0) if goto[back].get(c, 0) != child else 0
                queue.append(child)
            below = longest[link[state]]
            if ends[state] < 0:
                longest[state] = below
            else:
                self.shorter[ends[state]] = below
        self.goto, self.link, self.longest = goto, link, longest

    def encode_word(self, word: bytes) -> list[int]:
        goto, link, longest, length = self.goto, self.link, self.longest, self.length
        shorter, fit, last, state = self.shorter, self._fit, [-1], 0
        for end, c in enumerate(word, 1):
            step = goto[state].get(c)
            while step is None and state:
                state = link[state]
                step = goto[state].get(c)
            state = step or 0
            token = longest[state]
            while token >= 0:
                before = last[end - length[token]]
                if before < 0:
                    if end == length[token]:
                        break
                else:
                    fits = fit.get((before, token))
                    if fits or fits is None and self.fits(before, token):
                        break
                token = shorter[token]
            last.append(token)
        out, end = [], len(word)
        while end:
            token = last[end]
            out.append(token)
            end -= length[token]
        out.reverse()
        return out

    def _ids_of(self, word: str) -> bytes:
        """Ids of one word; words seen lately are remembered in two generations."""
        ids = self.older.get(word)
        if ids is None:
            ids = np.array(self.encode_word(word.encode("utf-8", "surrogatepass")), dtype="<u4").tobytes()
        if len(self.memo) >= MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        if len(word) <= MEMO_LENGTH:
            self.memo[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """All ids of a text, each as four little-endian bytes."""
        for content, token in self.added.items():
            if content in text:
                mark = np.array([token], dtype="<u4").tobytes()
                return mark.join(self.encode(part) for part in text.split(content))
        memo, fresh, out = self.memo, self._ids_of, []
        for word in self.words.findall(text):
            out.append(memo.get(word) or fresh(word))
            memo = self.memo
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        words, size = self.bytes_of, len(self.bytes_of)
        return b"".join([words[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < size]) \
            .decode("utf-8", "replace")


def load(spark: SparkSession, path: str):
    """A broadcast of the tokenizer file; ``on_worker`` turns it into the vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def on_worker(shared) -> Vocabulary:
    return cached(("bpe", hashlib.md5(shared.value).hexdigest()), lambda: Vocabulary(shared.value))


def encode_udf(spark: SparkSession, path: str):
    """Text column to ids as little-endian unsigned 32-bit integers."""
    shared = load(spark, path)

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        vocabulary = on_worker(shared)
        return pd.Series([vocabulary.encode(t) for t in texts], dtype=object)
    return encode


def decode_udf(spark: SparkSession, path: str):
    """Ids as little-endian unsigned 32-bit integers to text."""
    shared = load(spark, path)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        vocabulary = on_worker(shared)
        return pd.Series([vocabulary.decode(i) for i in ids], dtype=object)
    return decode


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts."""
    return docs.withColumn(out_col, encode_udf(docs.sparkSession, path)(text_of(text_col)))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the texts of its ids; null ids decode to an empty text."""
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.lit(b""))
    return docs.withColumn(out_col, decode_udf(docs.sparkSession, path)(ids))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: ``doc_id, n_tokens``, and digests of its ids and of the text they decode to.

    Encoding and decoding are one pass of one function, so ids never leave the Python worker.
    """
    shared = load(docs.sparkSession, path)

    @F.pandas_udf("struct<n_tokens: long, ids_sha256: string, decoded_sha256: string>")
    def both(texts: pd.Series) -> pd.DataFrame:
        vocabulary, rows = on_worker(shared), []
        for text in texts:
            ids = vocabulary.encode(text)
            back = vocabulary.decode(ids).encode("utf-8")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", both(text_of()).alias("x")).select("doc_id", "x.*")
