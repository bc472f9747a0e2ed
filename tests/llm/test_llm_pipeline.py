"""The pipeline against a plain version of its stages."""


import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evigraph.llm import quality
from evigraph.session import read_table

from test_llm_text import plain_spans
from test_llm_tokens import check_pieces


def plain_near_copies(texts, words=5, least=0.8):
    """Smallest position reachable over pairs of texts whose sets of word runs are that similar."""
    sets = []
    for text in texts:
        parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
        k = min(words, len(parts))
        sets.append({tuple(parts[i:i + k]) for i in range(len(parts) - k + 1)} if parts else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            both = len(a & sets[j])
            if both >= least * (len(a) + len(sets[j]) - both):
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def test_pipeline_against_plain_stages(spark, data):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "pii", "packing"]
    docs = read_table(spark, data, "documents")
    score = {r["doc_id"]: r["predicted"] for r in quality.quality(docs, read_table(spark, data, "labels")).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if score[r["doc_id"]])
    last = {text: doc_id for doc_id, text in rows}
    rows = [(i, t) for i, t in rows if last[t] == i]
    roots = plain_near_copies([t for _, t in rows])
    assert len(set(roots)) < len(rows)
    rows = [row for k, row in enumerate(rows) if roots[k] == k]

    def redacted(text):
        out, at = [], 0
        for start, kind, end in plain_spans(text):
            if start >= at:
                out += [text[at:start], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[kind]]
            at = max(at, end)
        return "".join(out) + text[at:]

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*library.encode(redacted(t), add_special_tokens=False).ids, 1] for i, t in rows}
    pieces = corpus_pipeline.run(spark, data).collect()
    assert {p["doc_id"] for p in pieces} == set(ids)
    assert check_pieces(pieces, ids, 2048) == 0


def test_stages_keep_columns_and_stand_odd_tables(spark, data):
    from llm_cases import empty, odd
    for table in (odd(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, data).columns == table.columns, name
            stage(spark, table, data).count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, data).columns[0] == "doc_id"
