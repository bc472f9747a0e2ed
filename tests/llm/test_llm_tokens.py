import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from evigraph.llm import bpe, packing, token_queries

from llm_cases import by_id, docs, empty, odd

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library_on_any_letter(vocabulary, library):
    for low in range(0, 0x110000, 211):
        letters = [chr(c) for c in range(low, min(low + 3, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b 1{c}!  {c}{c} \n{c}" for c in letters)
        assert np.frombuffer(vocabulary.encode(text), "<u4").tolist() == ids_of(library, text)


def test_bpe_equals_library_on_odd_texts(vocabulary, library):
    rng = random.Random(2)
    texts = ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "a" * 3000, " " * 500 + "x", "\n" * 99,
             "I'll don't 've", "x" * 10 + "'s", "1234567890" * 9, "aaaa aaaaa", "\x00\x1c\x85 "]
    texts += ["".join(rng.choice("aeiounrst  \n'lvd!.,3é漢") for _ in range(rng.randint(0, 80))) for _ in range(600)]
    for text in texts:
        ids = vocabulary.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)
        assert vocabulary.decode(ids) == text


def test_bpe_query(spark, data, library):
    got = by_id(token_queries.op1_bpe_round_trip(spark, data))
    for r in spark.read.parquet(f"{data}/documents.parquet").collect():
        ids = ids_of(library, r["text"])
        row = got[r["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert row["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_columns_and_odd_rows(spark):
    out = bpe.decode(bpe.encode(odd(spark), PATH), PATH)
    assert out.columns == [*odd(spark).columns, "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in out.collect())
    assert bpe.round_trip(odd(spark), PATH).count() == 11
    assert bpe.round_trip(empty(spark), PATH).count() == 0


def check_pieces(pieces, ids, window):
    for doc_id, want in ids.items():
        at = 0
        for p in sorted((p for p in pieces if p["doc_id"] == doc_id), key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(want)
            assert p["ids_crc32"] == zlib.crc32(np.array(want[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(want)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_query(spark, data, library):
    table = spark.read.parquet(f"{data}/documents.parquet").collect()
    ids = {r["doc_id"]: [*ids_of(library, r["text"]), 1] for r in table}
    assert check_pieces(token_queries.op8_packing_nnls(spark, data).collect(), ids, 2048) == 0


@pytest.mark.parametrize("texts", [["a"], ["a b c d e f g h"] * 40, ["x " * k for k in range(70)], [None, ""]])
def test_packing_small_windows(spark, library, texts):
    table = docs(spark, texts)
    ids = {k: [*ids_of(library, t), 1] for k, t in enumerate(texts)}
    assert check_pieces(packing.pack(table, PATH, window=16).collect(), ids, 16) == 0


def test_packing_odd_rows(spark):
    pieces = packing.pack(odd(spark), PATH).collect()
    assert sum(p["length"] for p in pieces if p["doc_id"] in (3, 4)) == 2
    assert packing.pack(empty(spark), PATH).count() == 0


def test_least_squares_meets_an_exact_histogram():
    histogram = np.zeros(16, dtype=np.int64)
    histogram[[4, 6, 12, 10]] = [600, 500, 500, 300]
    columns = packing.combinations(histogram, 16)
    assert (columns.sum(axis=1) == 16).all()
    x = packing.nnls(columns, histogram.astype(float))
    used = np.bincount(columns.ravel(), weights=np.repeat(x, 3), minlength=16)
    assert (x >= 0).all() and np.abs(used - histogram)[1:].max() < 2
    table, sequences = packing.plan(histogram, 16)
    assert ((table["hi"] - table["lo"]).sum()) >= 0.95 * histogram.sum()
    assert sequences * 16 >= 0.95 * (histogram * np.arange(16)).sum()


def test_tail_is_cut_into_powers_of_two():
    assert packing._ends(2048 * 3 + 13, 2048) == [(6144, 8), (6152, 4), (6156, 1)]
    assert packing._ends(4096, 2048) == []
