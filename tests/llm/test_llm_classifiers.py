import numpy as np
import pandas as pd
import pytest

from evigraph.llm import classifier_queries, quality, toxicity

from llm_cases import docs, empty, odd

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def accuracy(spark, df, root, label):
    rows = df.join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    right = (rows["predicted"] == rows[label]).mean()
    order = rows["score"].rank()
    ones = (rows[label] == 1).sum()
    auc = (order[rows[label] == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(rows) - ones))
    return right, auc


def test_quality_held_out(spark, larger):
    df = classifier_queries.op10_quality_classifier(spark, larger)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 1000
    right, auc = accuracy(spark, df, larger, "quality")
    assert right > 0.95 and auc > 0.95


def test_toxicity_held_out(spark, larger):
    df = classifier_queries.op4_toxicity_cnn(spark, larger)
    assert df.columns == ["doc_id", "held_out", "score", "predicted"] and df.count() == 1000
    right, auc = accuracy(spark, df, larger, "toxic")
    assert right > 0.9 and auc > 0.8


def test_isotonic_is_monotone_and_averages():
    centres, shares = quality.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([1, 5, 2, 10]), np.array([10, 10, 10, 10]))
    assert (np.diff(shares) >= 0).all() and shares.tolist() == [0.1, 0.35, 1.0]
    assert centres[1] == pytest.approx(0.25)


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_odd_rows_without_and_with_labels(spark, operator):
    none = spark.createDataFrame([], LABELS)
    rows = operator(odd(spark), none).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in rows)
    some = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0), (None, 1, 1), (7, None, None), (7, 5, 9),
                                  (8, 0, 0), (9, 1, 1), (99, 1, 1)], LABELS)
    rows = operator(odd(spark), some).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["held_out"] for r in rows if r["doc_id"] is None} == {False}
    assert operator(empty(spark), some).count() == 0


def test_accept_keeps_columns(spark):
    good = [f"Plain words in a calm line number {k}. Another one." for k in range(40)]
    bad = [f"WORDS!! IN!! A!! LOUD!! LINE!! {k}!! $$$ ###" for k in range(40)]
    table = docs(spark, good + bad)
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(80)], LABELS)
    kept = quality.accept(table, labels)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(40))


def test_network_gradient():
    rng = np.random.default_rng(0)
    docs_ = [rng.integers(0, 6, size=n) for n in (4, 1, 7)]
    y = np.array([1, 0, 1])
    net = toxicity.Network(6, np.zeros(6, dtype=np.float32))

    def loss():
        z = net.forward(*toxicity._pad(docs_))[1]
        return np.logaddexp(0, np.where(y == 1, -z, z)).mean()

    before = loss()
    for _ in range(60):
        net.step(docs_, y, np.ones(3), 0.02)
    assert loss() < before - 0.1


def test_scores_of_a_fixed_network_equal_a_loop():
    rng = np.random.default_rng(7)
    texts = ["", "one two", "größe über alle größe", "a b c d e f g h", "unseen", " ".join(["one", "two", "c"] * 40)]
    words = np.unique(toxicity.word_hashes("one two größe über alle a b c d e f g"))
    net = toxicity.Network(len(words) + 1, np.zeros(len(words) + 1, dtype=np.float32))
    net.p = {k: rng.normal(size=v.shape).astype(np.float32) for k, v in net.p.items()}
    cut = np.array([0.3, -0.2, 0.0, 1.0])
    got = toxicity._apply(pd.Series(texts), {"words": words, "p": net.p, "cut": cut})
    place = {int(h): k + 1 for k, h in enumerate(words)}
    for text, score in zip(texts, got):
        ids = [place.get(int(h), 0) for h in toxicity.word_hashes(text)]
        longest, z = max(toxicity.WIDTHS), float(net.p["b"][0])
        padded = ids + [0] * (2 * longest)
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                z += net.p["u"][k * toxicity.FILTERS + f] * max(
                    np.tanh(sum(net.p["e"][padded[at + o]] @ net.p[f"w{w}"][o * toxicity.DIM:(o + 1) * toxicity.DIM, f]
                                for o in range(w)) + net.p[f"c{w}"][f]) for at in range(len(ids) + 1))
        assert score == pytest.approx(1 / (1 + np.exp(cut[toxicity.language(text)] - z)), rel=1e-4)


def test_training_words_are_bounded_in_total():
    sizes = pd.DataFrame([(k % 2, k, 10 if k else 1000) for k in range(20)], columns=["label", "turn", "n"])
    taken = toxicity.fitting(sizes, 55)
    assert [k for label, k in taken if not label] == [2, 4, 6, 8, 10] and [k for label, k in taken if label] == [1, 3, 5, 7, 9]
    batches = list(toxicity._batches(np.arange(200), np.full(200, 5)))
    assert [len(b) for b in batches] == [64, 64, 64, 8]
    assert [len(b) for b in toxicity._batches(np.arange(3), np.array([200_000, 100_000, 60_000]))] == [1, 1, 1]


def test_toxicity_learns_from_every_training_row(spark):
    n = 9600                                            # either label has more rows than a sample of 4,000
    texts = [f"plain word{k // 8} " + ("nasty" if k % 2 else "calm") for k in range(n)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(n)], LABELS)
    nobody = toxicity.in_fold("doc_id", 1, 1)
    for part_bytes in (toxicity.PART_BYTES, 20_000):
        model = toxicity.fit(docs(spark, texts), labels, "toxic", nobody, part_bytes)
        assert set(model["words"].tolist()) == {int(h) for t in texts for h in toxicity.word_hashes(t)}
        scores = toxicity._apply(pd.Series(["plain word7 nasty", "plain word7 calm", "nasty new", "calm new"]), model)
        assert (scores > 0.5).tolist() == [True, False, True, False]


def test_parts_count_words_and_average_changes(spark):
    texts = ["one two two", "one three", "one", "two \u00e4\u00f6", "three one " * 50, ""]
    table, labels = docs(spark, texts), spark.createDataFrame([(k, 0, k % 2) for k in range(len(texts))], LABELS)
    rows, parts = toxicity.training_rows(table, labels, "toxic", toxicity.in_fold("doc_id", 1, 1), 60)
    assert parts == 9 and rows.count() == len(texts)
    got = {r.word: (r.n0, r.n1) for r in toxicity.word_counts(rows, 2).itertuples()}
    one, two, three = toxicity.word_hashes("one two three").tolist()
    assert got == {one: (3, 1), two: (1, 1), three: (1, 1)}

    net = toxicity.Network(5000, np.zeros(5000, dtype=np.float32))
    start = {k: v.copy() for k, v in net.p.items()}
    a, b = (toxicity.Network(5000, np.zeros(5000, dtype=np.float32)) for _ in range(2))
    a.p["e"][3] += 1
    b.p["e"][3] += 3
    b.p["e"][4500] += 2                                 # one part has moved it: its change stands
    b.p["b"] += 4
    blocks = pd.concat([toxicity._blocks_of(a, start), toxicity._blocks_of(b, start)])
    p = toxicity._changed(start, pd.concat([toxicity._mean_change(x) for _, x in blocks.groupby("block")]))
    moved = p["e"] - start["e"]
    assert moved[3] == pytest.approx(np.full(toxicity.DIM, 2), rel=1e-5) and moved[4500] == pytest.approx(2, rel=1e-5)
    assert not np.delete(moved, [3, 4500], axis=0).any() and p["b"][0] == 2
    assert all((p[k] == start[k]).all() for k in start if k not in ("e", "b"))


def test_words_and_languages():
    assert len(toxicity.word_hashes("One, two; THREE's é漢 \n")) == 4
    assert [toxicity.LANGUAGES[toxicity.language(t)] for t in ("the and", "größe", "niño está", "été là", "")] == \
        ["en", "de", "es", "fr", "en"]


def test_every_row_is_learnt_from_in_every_pass(monkeypatch):
    met, step = [], toxicity.Network.step
    monkeypatch.setattr(toxicity.Network, "step", lambda net, docs_, *x: (met.extend(len(d) for d in docs_), step(net, docs_, *x)))
    hashes = [toxicity.word_hashes("same words " * (k + 1)) for k in range(80)]     # a text is known by its length
    toxicity.train(hashes, np.zeros(80, dtype=np.int64), np.arange(80) % 2, 0.5)
    assert sorted(np.bincount(met)[2::2].tolist()) == [1] * 10 + [toxicity.EPOCHS] * 70


def test_parts_learn_rare_words_in_all_passes(spark, monkeypatch):
    passes, changed = [], toxicity._changed
    monkeypatch.setattr(toxicity, "_changed", lambda *x: passes.append(1) or changed(*x))
    n = 9000
    texts = [f"plain text {'nasty' if k % 2 else 'calm'}" + " seldom" * (k in (1, 3, 5, 7)) for k in range(n)]
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(n)], LABELS)
    model = toxicity.fit(docs(spark, texts), labels, "toxic", toxicity.in_fold("doc_id", 1, 1), 100_000)
    assert set(model["words"].tolist()) == {int(h) for h in toxicity.word_hashes("plain text nasty calm seldom")}
    assert len(passes) == toxicity.EPOCHS + 1


def test_a_part_trains_the_rows_of_its_own_words():
    hashes = [toxicity.word_hashes(t) for t in ("one two", "", "three one odd")]
    known = np.unique(toxicity.word_hashes("zero one two three four five"))
    places, numbered = toxicity._own_words(hashes, known)
    rows = np.append(0, places)
    assert [rows[d].tolist() for d in numbered] == [toxicity.rows_of(h, known).tolist() for h in hashes]
    start = toxicity.Network(len(known) + 1, np.ones(len(known) + 1, dtype=np.float32))
    mine, y = toxicity._part_network(start.p, places), np.array([1, 0, 1])
    before = {k: v.copy() for k, v in mine.p.items()}
    for net, texts in ((mine, numbered), (start, [rows[d] for d in numbered])):
        for _ in range(3):
            net.step(texts, y, np.ones(3), 0.1)
    assert (start.p["e"][rows] == mine.p["e"]).all() and all((start.p[k] == mine.p[k]).all() for k in mine.p if k != "e")
    moved = [np.frombuffer(p, dtype=np.int32) for _, p, _ in toxicity._blocks_of(mine, before, rows).itertuples(index=False)]
    assert sorted(np.concatenate(moved)) == sorted(places)
