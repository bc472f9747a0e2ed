"""Passage removal, source audit and repair of conversations against SQL and brute force."""

import hashlib
import heapq
import random
from collections import Counter

import duckdb
import pytest

from evigraph.llm import audit_queries, conversations, divergence, passages

from llm_cases import by_id, docs, empty, odd


def sql_rows(query, **tables):
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({columns})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = con.execute(query)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def same(df, names, want):
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, df.select(*names).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("query, sql", [("op11_passage_cover", "PASSAGES_SQL"), ("op12_source_divergence", "DIVERGENCE_SQL"),
                                        ("op13_conversation_repair", "CONVERSATIONS_SQL")])
def test_queries_equal_sql(spark, data, query, sql):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got = con.execute(getattr(audit_queries, sql))
    same(getattr(audit_queries, query)(spark, data), [d[0] for d in got.description], got.fetchall())


@pytest.mark.parametrize("period", [1, 2, 5, 7, 13, 21, 24])
def test_cover_meets_every_pair_of_starts(period):
    window = period + 3
    at = set(passages.cover_positions(10 * period + window, window, period).tolist())
    for i in range(3 * period):
        for j in range(3 * period):
            assert any(i + d in at and j + d in at for d in range(period))


def plain_removed(texts, window):
    words = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window, period, words", [(6, 4, 3), (35, 21, 400), (9, 1, 2), (8, 8, 4)])
def test_passages_against_brute_force(spark, window, period, words):
    rng = random.Random(window)
    fresh = lambda n: [f"w{rng.randrange(words)}" for _ in range(n)]
    passage = fresh(3 * window)
    texts = [" ".join(fresh(rng.randrange(4 * window))) for _ in range(40)]
    for _ in range(30):                 # cuts of one passage at any place, from just too short on
        n, at = rng.randrange(window - 2, 2 * window), rng.randrange(window)
        texts.append(" ".join(fresh(rng.randrange(30)) + passage[at:at + n] + fresh(rng.randrange(30))))
    texts += [texts[3]] * 3 + ["a " * (window + 1), "a " * window, "b " * window, "c d " * window, " ".join(passage[:window - 1])] + [None, ""]
    got = by_id(passages.remove_passages(docs(spark, texts), window, period))
    for k, (n, removed, kept) in enumerate(plain_removed(texts, window)):
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept"]) == (n, removed, kept), texts[k]


def test_planted_passage_goes_and_the_rest_stays(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    own = [" ".join(f"x{k}_{i}" for i in range(100)) for k in range(20)]
    texts = [f"{t} {passage} {t[::-1]}" if k < 12 else t for k, t in enumerate(own)]
    got = by_id(passages.remove_passages(docs(spark, texts)))
    assert [got[k]["n_removed"] for k in range(20)] == [60] * 12 + [0] * 8
    assert got[15]["kept"] == own[15]


def test_passages_of_odd_rows(spark):
    rows = passages.report(odd(spark)).collect()
    assert len(rows) == 11 and passages.report(empty(spark)).count() == 0
    for r in rows:
        if r["doc_id"] in (1, 2, 8) or r["n_words"] == 400:
            assert r["n_removed"] == r["n_words"] > 0 and r["kept_sha256"] == hashlib.sha256(b"").hexdigest()
        else:
            assert r["n_removed"] == 0
    assert [r["n_words"] for r in rows if r["doc_id"] in (3, 4, 5)] == [0, 0, 0]


def test_audit_of_odd_rows_and_ties_equals_sql(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["aa Bb cc", "É é x1y z_w", "dd ee ff gg " * 3, "", None, "same words here"]),
             rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None])) for i in range(200)]
    rows += [(None, "tie1 tie2 tie3 tie4 " * 2, "it", "s1")] * 4 + [(1, "lone", "xx", "a"), (2, "other", "xx", "b")]
    rows += [(3, " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "la", s) for s in ("a", "a", "b", "c")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, want = sql_rows(audit_queries.DIVERGENCE_SQL, documents=("doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR", rows))
    same(divergence.audit(table), names, want)
    assert max(r["rank"] for r in divergence.audit(table, top=2).filter("part = 'term'").collect()) == 2
    assert divergence.audit(table.limit(0)).count() == 0


def test_audit_in_small_blocks(spark, data, monkeypatch):
    table = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(map(tuple, divergence.audit(table).collect()))
    for name, value in (("_HELD", 50), ("_BLOCK", 7), ("_CELLS", 64)):
        monkeypatch.setattr(divergence, name, value)
    assert sorted(map(tuple, divergence.audit(table).collect())) == want


def test_terms_lower_only_ascii():
    assert divergence.terms("Ab-É É_z\x00Q7ß x") == [x.encode() for x in ("ab", "É", "É", "z", "q", "ß x")]


def plain_repair(rows):
    """Cheapest and then ASCII-least audit by a search over whole audits; the repaired turns."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        state = (at, len(roles) - roles.startswith("s"), roles.startswith("s"))
        body = roles[1:] if roles.startswith("s") else roles
        if at == len(rows) and (not roles or (body and len(body) % 2 == 0)):
            return cost, audit
        if (state, roles[-1:]) in done or len(body) > len(rows) + 2:
            continue
        done.add((state, roles[-1:]))
        want = "ua"[len(body) % 2]
        heapq.heappush(heap, (cost + 5, audit + "I", at, roles + want))
        if at == len(rows):
            continue
        initial, fault = rows[at]
        heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
        if fault in ("blank", "duplicate"):
            continue
        more = 5 if fault == "truncated" else 0
        if initial == want or (initial == "s" and not roles):
            heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + initial))
        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, roles + want))


def test_graph_against_search():
    rng = random.Random(2)
    kinds = {"s": ("s", ""), "u": ("u", ""), "a": ("a", ""), "x": ("x", ""), "S": ("s", "truncated"), "U": ("u", "truncated"),
             "A": ("a", "truncated"), "X": ("x", "truncated"), "-": ("u", "blank")}
    every = {"".join(rng.choice("suaxSUAX-") for _ in range(rng.randrange(8))) for _ in range(1500)} | {""}
    graph = conversations.SuffixGraph()
    for backwards in sorted(every):
        assert (graph.add(backwards), graph.audit()) == plain_repair([kinds[c] for c in reversed(backwards)]), backwards
    endings = {b[:k] for b in every for k in range(1, len(b) + 1)}
    assert graph.made == len(endings)          # every ending is worked out once


TURNS = "conv_id long, turn long, role string, text string, row string, fault int"
ODD_TURNS = [
    (1, 0, "system", "Be kind.", "x", 1), (1, 1, "user", "Hi?", None, 2), (1, 2, "assistant", "Yes.", None, 2),
    (1, 2, "assistant", "Yes.", None, 2), (1, 9, "user", "cut off", None, 2), (2, None, None, None, None, None),
    (2, None, "user", "no turn!", None, None), (2, 5, "tool", "Result.", None, None), (2, 5, "", "Nothing.", None, None),
    (None, 1, "user", "Who?", None, None), (None, None, "assistant", "é🙂. \t", None, None), (None, None, None, None, None, None),
    (3, 4, "user", "", None, None), (3, 4, "user", " \n", None, None), (7, 1, "user", "word " * 50_000 + ".", None, None),
    (-8, 0, "user", "Alone.", None, None), ((1 << 62) + 1, 3, "assistant", "Large id.", None, None)]


def test_odd_conversations_equal_sql(spark):
    rows = ODD_TURNS + [(100 + i, t, random.Random(i * 31 + t).choice(["user", "assistant", "system"]), f"T{i % 3}{t}.", None, None)
                        for i in range(60) for t in range(i % 7)]
    table = spark.createDataFrame(rows, TURNS)
    names, want = sql_rows(audit_queries.CONVERSATIONS_SQL, conversations=(
        "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, row VARCHAR, fault INTEGER", rows))
    same(conversations.report(conversations.damage(table), table), names, want)
    none = table.limit(0)
    assert conversations.report(conversations.damage(none), none).count() == 0


def test_repaired_turns_follow_the_grammar(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["One.", "Two!", "three", "", f"n{t}."]), None, None)
            for c in range(80) for t in range(rng.randrange(9))]
    rows += [(999, t, rng.choice(["user", "assistant"]), f"Turn {t}.", None, None) for t in range(25_000)]
    table = spark.createDataFrame(rows, TURNS).repartition(7)
    digests = {r["conv_id"]: r for r in conversations.report(table).collect()}
    found = {}
    for r in sorted(conversations.repair(table).collect(), key=lambda r: (r["conv_id"], r["position"])):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, r in digests.items():
        turns = found.get(conv, [])
        initials = "".join(role[0] for role, _ in turns)
        body = initials.removeprefix("s")
        assert body == "ua" * (len(body) // 2) and (body or not initials)
        assert r["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in turns).encode()).hexdigest()
        paid = sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in r["audit"])
        assert 0 <= r["cost"] - paid <= 5 * r["truncated"] and (r["cost"] - paid) % 5 == 0
    assert len(digests[999]["audit"]) >= 25_000 and digests[999]["gaps"] == 0
