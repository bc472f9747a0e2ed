import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash

from evigraph.llm import dedup_queries, exact_dedup, fuse, multiset, near_copies, simhash
from evigraph.llm.components import components

from llm_cases import by_id, docs, empty, odd


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 70_000])
def test_fuse_filter_misses_nothing(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, size=n, dtype=np.uint64)
    built = fuse.build(np.concatenate([keys, keys[:5]]))
    assert fuse.may_contain(keys, *built).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, size=20_000, dtype=np.uint64)
    assert fuse.may_contain(others, *built).mean() < 0.012
    if n > 1000:
        assert len(built[3]) < 1.4 * n


def test_exact_dedup_equals_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{data}/documents.parquet')")
    got = dedup_queries.op2_exact_dedup(spark, data)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({dedup_queries.EXACT_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_exact_dedup_odd_rows(spark):
    rows = exact_dedup.exact_dedup(odd(spark)).collect()
    assert len(rows) == 11
    fox = [r for r in rows if r["doc_id"] in (1, 2)]
    assert [r["group_size"] for r in fox] == [3, 3, 3] and {r["keep_id"] for r in fox} == {2}
    assert sum(r["kept"] for r in fox) == 1
    blank = [r for r in rows if r["text_sha256"] == hashlib.sha256(b"").hexdigest()]
    assert len(blank) == 3 and {r["keep_id"] for r in blank} == {4}
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_survivors_keep_rows_as_they_are(spark):
    kept = exact_dedup.survivors(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 7
    assert sum(r["doc_id"] == 2 for r in kept.collect()) == 1


def test_colliding_digests_are_told_apart_by_bytes(spark):
    """Two texts that share the whole key are compared and stay two groups."""
    from pyspark.sql import functions as F
    staged = exact_dedup.stage(docs(spark, ["one", "two", "two", "one", "one"]))
    same = staged.withColumn("digest", F.lit(b"x")).withColumn("size", F.lit(3)).withColumn("mix", F.lit(1).cast("long")) \
        .withColumn("delivery", (F.col("text") == "two").cast("int"))
    out = exact_dedup.decide(same, exact_dedup.resolve(same)).collect()
    assert {(r["text"], r["keep_id"], r["group_size"]) for r in out} == {("one", 4, 3), ("two", 2, 2)}


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=3):
    """Smallest position reachable over links of at most ``radius`` bits."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_radius():
    rng = random.Random(1)
    for bits in (list(range(64)), [1, 5, 9, 20, 33, 40, 63]):
        masks = simhash.masks(bits)
        for _ in range(2000):
            differ = sum(1 << b for b in rng.sample(bits, 3))
            assert any(not differ & m for m in masks)


def test_simhash_query_against_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").toPandas()
    got = by_id(dedup_queries.op3_simhash_near_dedup(spark, data))
    prints = [plain_fingerprint(t) for t in table["text"]]
    roots = plain_components(prints)
    for k, doc_id in enumerate(table["doc_id"]):
        assert got[doc_id]["fingerprint"] == f"{prints[k]:016x}"
        assert got[doc_id]["component_id"] == table["doc_id"][roots[k]]


@pytest.mark.parametrize("limit", [2, 5, 4096])
def test_links_lose_nothing_in_crowded_buckets(spark, limit):
    rng = random.Random(limit)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0}
    for base in list(prints)[:6]:
        for _ in range(25):
            x = base
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    want = plain_components(prints)
    points = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(points, limit=limit)).collect()}
    got = [roots.get(simhash._signed(p), simhash._signed(p)) for p in prints]
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 900, 901")) \
        .union(spark.sql("SELECT CAST(NULL AS long), 3L")).union(spark.sql("SELECT 5, 5"))
    roots = {}
    for r in components(edges).collect():
        roots.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, roots.values())) == [2, 501]


def test_simhash_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == 11
    blank = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(blank) == 4 and {r["component_id"] for r in blank} == {3}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.representatives(odd(spark))
    assert kept.columns == odd(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 7, 8, 9]


def test_multiset_edits_against_plain_text(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet").toPandas().sort_values("doc_id", ascending=False)
    texts = table["text"].tolist()
    edited = [t[:len(t) - len(t) // 2] + texts[(k + 1) % len(texts)][:len(t) // 2] for k, t in enumerate(texts)]
    got = by_id(dedup_queries.op6_multiset_fingerprints(spark, data))
    prints = {}
    for doc_id, text, changed in zip(table["doc_id"], texts, edited):
        row = got[doc_id]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert 0 <= row["near_next"] <= 1 and 0 <= row["near_edited"] <= 1
    assert len(set(prints.values())) == len(prints)
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.95 * len(got)


def test_multiset_is_a_sum_of_paragraphs(spark):
    parts = ["one two three four", "a b", "", "x y z", "x y z"]
    texts = ["\n".join(parts), "\n".join(parts[::-1]), "\n".join(parts[:3]), "\n".join(parts[3:]), "\n".join(parts[1:])]
    lanes = {r["doc_id"]: r["lanes"] for r in multiset.lanes_of(docs(spark, texts), ["doc_id"]).collect()}
    assert lanes[0] == lanes[1] != lanes[4]
    frame = spark.createDataFrame([(lanes[0], lanes[2], lanes[3])], "whole array<long>, a array<long>, b array<long>")
    row = frame.select(multiset.add(frame["a"], frame["b"]), multiset.remove(frame["whole"], frame["b"]),
                       multiset.likeness(frame["a"], frame["a"])).first()
    assert list(row) == [lanes[0], lanes[2], 1.0]


def test_multiset_odd_rows(spark):
    rows = multiset.fingerprints_with_edits(odd(spark).dropDuplicates(["doc_id", "text"])).collect()
    assert len(rows) == 10
    one = multiset.fingerprints_with_edits(docs(spark, ["lonely text here"])).first()
    assert one["near_next"] == 1.0
    assert multiset.fingerprints_with_edits(empty(spark)).count() == 0
    assert multiset.fingerprints_with_edits(odd(spark)).count() == 11


def test_multiset_slices_follow_ids_and_hashes(spark):
    """Null ids, an id that owns a third of the rows and far outliers are cut, and slices rise with the order."""
    ids = [*range(3000), *[None] * 3000, *[700] * 3000, 1 << 60, (1 << 60) + 1, -(1 << 61)]
    rows = spark.createDataFrame([(i, (k * 0x9E3779B97F4A7C15 + (1 << 63)) % (1 << 64) - (1 << 63)) for k, i in enumerate(ids)],
                                 "id long, tie long")
    found = multiset._slices(rows).collect()
    assert len(found) == len(ids)
    found.sort(key=lambda r: (r["id"] is not None, r["id"] or 0, r["tie"]))
    numbers = [r["slice"] for r in found]
    assert numbers == sorted(numbers)
    sizes = {}
    for n in numbers:
        sizes[n] = sizes.get(n, 0) + 1
    assert max(sizes.values()) < 700


def test_multiset_next_document_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(multiset, "ROWS_PER_SLICE", 3)
    texts = [f"text number {i % 40} {'x' * (i % 17)}" for i in range(200)]
    table = [(None if i % 5 == 0 else 50 if i % 3 == 0 else i, t) for i, t in enumerate(texts)]
    pairs = multiset.with_next(spark.createDataFrame(table, "doc_id long, text string").repartition(5)).collect()
    at = {(r["slice"], r["position"]): r for r in pairs}
    assert len(at) == len(pairs) == 200
    order, now = [], max(pairs, key=lambda r: (r["id"] is not None, r["id"] or 0, r["tie"]))
    for _ in pairs:
        order.append(now)
        after = at[now["next_slice"], now["next_position"]]
        assert now["next_text"] == after["text"]
        now = after
    assert len({(r["slice"], r["position"]) for r in order}) == 200         # one round through all
    keys = [(r["id"] is not None, r["id"] or 0, r["tie"]) for r in order]
    assert keys == sorted(keys, reverse=True)


def test_multiset_likeness_of_a_word_put_in_front(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(400)]
    rows = by_id(multiset.fingerprints_with_edits(docs(spark, [" ".join(words), " ".join(["new", *words]), "others " * 300])))
    assert rows[1]["near_next"] > 0.9 and rows[2]["near_next"] < 0.5


@pytest.mark.parametrize("doc_id", [4, None])
def test_multiset_repeated_rows_stay_apart(spark, doc_id):
    """Five rows with one id, or none, and one text, between two others; three more share the id only."""
    same, other = "one two three four\nfive six\n" * 3, "other words of the same id\n" * 2
    table = [(9, "the first text of all\nends here"), *[(doc_id, same)] * 5, *[(doc_id, other)] * 3, (1, "the last text")]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    rows = multiset.fingerprints_with_edits(frame).collect()
    assert len(rows) == len(table)
    own = {r["doc_id"]: r["fingerprint"] for r in multiset.fingerprints_with_edits(
        spark.createDataFrame([(0, same), (1, other)], "doc_id long, text string")).collect()}
    for text, count in ((same, 5), (other, 3)):
        of_text = [r for r in rows if r["fingerprint"] == own[int(text == other)]]
        assert len(of_text) == count and {r["n_chars"] for r in of_text} == {len(text)}
        assert sum(r["near_next"] == 1.0 for r in of_text) == count - 1     # all but the last precede a copy
    bodies = {t[:len(t) - len(t) // 2] + u[:len(t) // 2] for _, t in table for _, u in table}
    prints = {hashlib.sha256(b.encode()).hexdigest(): r["lanes"] for b, r in zip(sorted(bodies), sorted(
        multiset.lanes_of(docs(spark, sorted(bodies)), ["doc_id"]).collect(), key=lambda r: r["doc_id"]))}
    for r in rows:
        assert r["edited_fingerprint"] == "".join(f"{x:08x}" for x in prints[r["edited_sha256"]])


def test_near_copies_of_given_documents_go(spark):
    """The stage against brute force over all pairs of the table."""
    import corpus_pipeline
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    rows = sorted((r["doc_id"], r["text"]) for r in table.collect())
    sets, where = [set(near_copies.shingles(t).tolist()) for _, t in rows], {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for k, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < k}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                pairs += 1
                x, y = find(k), find(j)
                root[max(x, y)] = min(x, y)
    assert pairs > 0
    want = {rows[k][0] for k in range(len(rows)) if find(k) == k}
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in stage(spark, frame, "").collect()}
    print("pairs", pairs, "documents", len(rows), "to go", len(rows) - len(want), "gone", len(rows) - len(kept))
    assert kept == want
    odd_rows = near_copies.representatives(odd(spark))
    assert odd_rows.columns == odd(spark).columns
    assert sorted(r["doc_id"] or 0 for r in odd_rows.collect()) == [0, 1, 3, 7, 8, 9]


@pytest.mark.parametrize("block_bytes", [1500, 1 << 24])
def test_near_copies_in_blocks_equal_all_pairs(spark, monkeypatch, block_bytes):
    """Chains that drift away from their first text, copies of one text, and texts of their own."""
    from test_llm_pipeline import plain_near_copies
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(8)
    texts = []
    for chain in range(4):
        words = [f"w{chain}x{k}" for k in range(60)]
        for step in range(14):
            words[int(rng.integers(60))] = f"n{chain}y{step}"
            texts.append(" ".join(words))
    texts += [t.upper().replace(" ", "  ") for t in texts[5:9]] + texts[:1] * 30 + ["", " ", "one two", "ONE two"]
    texts = [texts[k] for k in rng.permutation(len(texts))]
    roots = plain_near_copies(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in near_copies.representatives(frame).collect())
    assert kept == sorted(set(roots)) and len(kept) < len(texts) // 4


def test_near_copies_are_also_candidates_by_simhash(spark, monkeypatch):
    rows = spark.createDataFrame([(0, 0), (1, 7), (2, 0), (3, -1), (4, 1 << 40), (5, 0x5555)], "row long, fp long")
    found = {tuple(sorted((r["a"], r["b"]))) for r in near_copies._simhash_candidates(rows).collect()}
    root = {n: n for n in range(6)}
    for a, b in sorted(found):
        root = {n: root[a] if r == root[b] else r for n, r in root.items()}
    assert root[0] == root[1] == root[2] == root[4] and len({root[0], root[3], root[5]}) == 3
    asked, real = [], near_copies.fingerprint_links
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda points: asked.append(points.columns) or real(points))
    text = " ".join(f"w{i}" for i in range(400))
    kept = near_copies.representatives(docs(spark, [text, text + " end", "something else entirely"])).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2] and asked
