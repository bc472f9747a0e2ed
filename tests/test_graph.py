import random
from collections import deque

import pytest

from evigraph.operators import extract, graph, rerank

NODE = "id string, type string, properties map<string,string>, seq long"
EDGE = "source string, relation string, target string, properties map<string,string>, seq long"


def frames(spark, nodes, edges):
    return (spark.createDataFrame([(i, "t", p, n) for n, (i, p) in enumerate(nodes.items())], NODE),
            spark.createDataFrame([(s, r, t, p, n) for n, (s, r, t, p) in enumerate(edges)], EDGE))


def bfs(nodes, edges, start, depth, direction="outgoing", relation=None):
    """Queue walk that reports each edge once, with the depth of its first appearance."""
    if start not in nodes:
        return {}
    found, seen, queue = {}, {start}, deque([(start, 0)])
    while queue:
        here, d = queue.popleft()
        if d >= depth:
            continue
        for s, r, t, _ in edges:
            if relation and r != relation:
                continue
            if (direction != "incoming" and s == here) or (direction != "outgoing" and t == here):
                found.setdefault((s, r, t), d + 1)
                after = t if s == here else s
                if after not in seen:
                    seen.add(after)
                    queue.append((after, d + 1))
    return found


def step_back(nodes, edges, seed, depth):
    found = {}
    for s, r, t, _ in edges:
        if t == seed:
            found.setdefault((s, r, t), 1)
            if depth > 1:
                for edge, d in bfs(nodes, edges, s, depth - 1).items():
                    found.setdefault(edge, d + 1)
    return found


def in_domain(nodes, edge, domain):
    own = edge[3].get("domain")
    if not domain or own:
        return not domain or own == domain
    ends = {nodes[x].get("domain") for x in (edge[0], edge[2]) if x in nodes} - {None}
    return not ends or ends == {domain}


def context(nodes, edges, seeds, depth, domain):
    by_key = {e[:3]: e for e in edges}
    found = {}
    for seed in sorted(seeds):
        edges_of = bfs(nodes, edges, seed, depth) or step_back(nodes, edges, seed, depth)
        for key, d in edges_of.items():
            if in_domain(nodes, by_key[key], domain):
                found.setdefault(key, d)
    return found


def random_graph(rng):
    names = [f"n{i}" for i in range(9)]
    nodes = {n: ({"domain": rng.choice(["a", "b"])} if rng.random() < 0.6 else {})
             for n in names if rng.random() < 0.85}
    edges = {}
    for _ in range(rng.randint(4, 18)):
        key = (rng.choice(names), rng.choice("rs"), rng.choice(names))
        edges.setdefault(key, {"domain": rng.choice(["a", "b"])} if rng.random() < 0.3 else {})
    return nodes, [(*k, p) for k, p in edges.items()]


def as_dict(df, *key):
    out = {}
    for r in df.collect():
        out.setdefault(tuple(r[k] for k in key), {})[(r["source"], r["relation"], r["target"])] = r["depth"]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_traversal_equals_a_queue_walk(spark, seed):
    rng = random.Random(seed)
    nodes, edges = random_graph(rng)
    n, e = frames(spark, nodes, edges)
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("n1",)], "seed string")
    depth = rng.randint(1, 4)
    direction = graph.DIRECTIONS[seed % 3]
    relation = "r" if seed % 2 else None
    got = as_dict(graph.traverse(seeds, n, e, depth, direction, relation), "seed")
    for i in range(9):
        assert got.get((f"n{i}",), {}) == bfs(nodes, edges, f"n{i}", depth, direction, relation)


@pytest.mark.parametrize("seed", range(4))
def test_context_equals_a_seed_by_seed_walk(spark, seed):
    rng = random.Random(100 + seed)
    nodes, edges = random_graph(rng)
    n, e = frames(spark, nodes, edges)
    asked = {q: rng.sample(sorted(nodes), min(3, len(nodes))) for q in ("q1", "q2", "q3")}
    seeds = spark.createDataFrame([(q, s) for q, ss in asked.items() for s in ss],
                                  "query_id string, seed string")
    depth, domain = rng.randint(1, 3), (None, "a")[seed % 2]
    got = as_dict(graph.graph_context(seeds, n, e, domain, depth), "query_id")
    for q, ss in asked.items():
        assert got.get((q,), {}) == context(nodes, edges, ss, depth, domain)


def test_terminal_seed_steps_back_once(spark):
    nodes = {x: {} for x in ("suite", "one", "two")}
    edges = [("suite", "has", "one", {}), ("suite", "has", "two", {})]
    n, e = frames(spark, nodes, edges)
    seeds = spark.createDataFrame([("q", "one")], "query_id string, seed string")
    got = as_dict(graph.graph_context(seeds, n, e, None, 3), "query_id")[("q",)]
    assert got == {("suite", "has", "one"): 1, ("suite", "has", "two"): 2}


def test_merges(spark):
    writes = spark.createDataFrame([
        (" a ", "x", {"k": "1", "old": "1"}, 1), ("a", "y", {"k": "2"}, 5), ("b", " ", {}, 2),
        ("c", "z", None, 3)], NODE)
    got = {r["id"]: (r["type"], r["properties"], r["seq"]) for r in graph.merge_nodes(writes).collect()}
    assert got == {"a": ("y", {"k": "2"}, 1), "c": ("z", {}, 3)}
    writes = spark.createDataFrame([
        ("a", "r", "b", {"k": "late"}, 7), ("a", "r", "b", {"k": "first"}, 2),
        ("a", "r", "b", {"new": "v"}, 9), ("a", "r", "c", {}, 4), ("", "r", "c", {}, 5)], EDGE)
    merged = graph.merge_edges(writes)
    got = {(r["source"], r["target"]): (r["properties"], r["seq"]) for r in merged.collect()}
    assert got == {("a", "b"): ({"k": "first", "new": "v"}, 2), ("a", "c"): ({}, 4)}
    again = graph.merge_edges(merged.unionByName(merged))
    assert {(r["source"], r["target"]): (r["properties"], r["seq"]) for r in again.collect()} == got


def test_merges_of_blank_ends_and_property_keys(spark):
    writes = spark.createDataFrame([
        (" ", "r", "b", {"k": "1"}, 1), (None, "r", "b", {"k": "1"}, 2), ("a", None, "b", {}, 3), ("a", "r", "\u3000", {}, 4),
        ("a", "r", "b", {"x": "1"}, 5), (" a", "r", "b\t", {"y": "2"}, 6), ("a", "r", "c", {"x": "1", "y": "1"}, 9),
        ("a", "r", "c", {"y": "0", "x": "0"}, 7), ("a", "r", "d", None, 8), ("a", "r", "d", {"[]": "z"}, 10)], EDGE)
    got = {(r["source"], r["target"]): (r["properties"], r["seq"]) for r in graph.merge_edges(writes).collect()}
    assert got == {("a", "b"): ({"x": "1", "y": "2"}, 5), ("a", "c"): ({"x": "0", "y": "0"}, 7), ("a", "d"): ({"[]": "z"}, 8)}


def test_a_walk_joins_the_edges_once_a_level(spark, monkeypatch):
    nodes = {f"n{i}": {} for i in range(6)}
    edges = [("n0", "r", "n1", {}), ("n0", "r", "n0", {}), ("n1", "r", "n2", {}), ("n2", "r", "n0", {}), ("n1", "s", "n3", {}),
             ("n3", "r", "n4", {}), ("n4", "r", "n5", {})]
    n, e = frames(spark, nodes, edges)
    seeds = spark.createDataFrame([("n0",), (" n1",), ("n5",), ("none",), (None,)], "seed string")
    for direction in ("outgoing", "incoming", "both"):
        steps = graph.adjacency(e, direction)
        found = graph.traverse(seeds, n, e, 4, direction, steps=steps)
        # only the last level still reads the edges, the others are stored
        if direction != "both":
            files = set(steps.inputFiles())
            assert files & set(found.inputFiles()) == files and not files & set(found.where("depth < 4").inputFiles())
        got = as_dict(found, "seed")
        for seed in ("n0", "n1", "n5"):
            assert got.get((seed,), {}) == bfs(nodes, edges, seed, 4, direction, None)
        assert set(got) <= {("n0",), ("n1",), ("n5",)}


def test_neighbors_and_lookup(spark):
    n, e = frames(spark, {"a": {}, "b": {}}, [("a", "r", "a", {}), ("a", "r", "b", {}), ("c", "s", "a", {})])
    ids = spark.createDataFrame([("a",), ("a",)], "id string")
    assert graph.neighbors(ids, e).count() == 3
    assert graph.neighbors(ids, e, "outgoing").count() == 2
    assert graph.neighbors(ids, e, "incoming", "s").count() == 1
    assert graph.lookup(ids, n).count() == 1
    for bad in (lambda: graph.neighbors(ids, e, "both"), lambda: graph.traverse(ids, n, e, 0),
                lambda: graph.traverse(ids, n, e, 2, "up"), lambda: graph.graph_context(ids, n, e, None, 0)):
        with pytest.raises(ValueError):
            bad()


def test_curated_graph_is_idempotent(spark):
    n, e = extract.curated_graph(spark)
    nodes, edges = graph.merge_nodes(n), graph.merge_edges(e)
    for _ in range(2):
        counts = graph.graph_counts(nodes, edges).first()
        assert (counts["node_count"], counts["edge_count"]) == (57, 57)
        nodes, edges = extract.load_graph(nodes, edges, n, e)
    seeds = spark.createDataFrame([("q", "candidate_molecule")], "query_id string, seed string")
    found = graph.graph_context(seeds, nodes, edges, "drug_discovery", 6)
    assert found.where("target = 'rmsd'").first()["depth"] == 6
    assert graph.graph_context(seeds, nodes, edges, "cybersecurity", 3).isEmpty()


def test_extraction(spark):
    df = spark.createDataFrame([
        (1, "RDKit computes molecular descriptors", "d", "s"), (2, "GROMACS only", "d", "s"), (3, "none", "d", "s")],
        "seq long, text string, domain string, source string")
    found = extract.extract_relations(extract.extract_entities(df))
    got = {r["seq"]: (sorted(x["node_id"] for x in r["entities"]), [tuple(x) for x in r["relations"]])
           for r in found.collect()}
    assert got[1] == (["molecular_descriptors", "rdkit"], [("rdkit", "calculates", "molecular_descriptors")])
    assert got[2] == (["gromacs"], []) and got[3] == ([], [])
    assert extract.node_writes(found).count() == 3 and extract.edge_writes(found).count() == 1


def test_seeds_come_from_metadata_not_from_prose(spark):
    n, _ = frames(spark, {"rdkit": {"domain": "d"}, "gromacs": {"domain": "d"}, "blender": {"domain": "x"},
                          "rmsd": {}}, [("a", "r", "b", {})])
    asked = spark.createDataFrame([("q", "how do I use Blender and RMSD?")], "query_id string, question string")
    hits = spark.createDataFrame([("q", " RDKit ", "gromacs_rms", "gromacs smina vina")],
                                 "query_id string, tool string, source_id string, text string")
    from evigraph import vocab
    got = graph.seed_nodes(asked, hits, n, vocab.ALIASES, vocab.TOOL_NODES, vocab.SOURCE_NODES, "d")
    assert sorted(r["seed"] for r in got.collect()) == ["gromacs", "rdkit", "rmsd"]


def test_blank_writes_are_rejects(spark):
    nodes = spark.createDataFrame([("a", "t", None, 1), (" ", "t", None, 2), ("b", None, None, 3)],
                                  "id string, type string, properties map<string,string>, seq long")
    assert {(r["seq"], r["reject_reason"]) for r in graph.node_rejects(nodes).collect()} == {
        (2, "id is blank"), (3, "type is blank")}
    edges = spark.createDataFrame([("a", "r", "b", None, 1), ("a", "", "b", None, 2), (None, "r", "b", None, 3)],
                                  "source string, relation string, target string, properties map<string,string>, seq long")
    assert {(r["seq"], r["reject_reason"]) for r in graph.edge_rejects(edges).collect()} == {
        (2, "relation is blank"), (3, "source is blank")}
    assert graph.merge_nodes(nodes).count() + graph.node_rejects(nodes).count() == 3


def test_hub_context_is_rows(spark):
    edges = spark.range(3000).selectExpr("'q' query_id", "'hub' source", "'r' relation", "concat('t', id) target", "1 depth")
    lines = rerank.context_edges(edges)
    assert lines.count() == 3000 and lines.first()["line"].endswith("(depth 1)")


def test_questions_with_the_same_seeds_share_their_context(spark):
    nodes = spark.createDataFrame([(n, "t", {}, i) for i, n in enumerate("abcd")],
                                  "id string, type string, properties map<string,string>, seq long")
    edges = spark.createDataFrame([("a", "r", "b", {}, 1), ("b", "r", "c", {}, 2), ("d", "r", "c", {}, 3)],
                                  "source string, relation string, target string, properties map<string,string>, seq long")
    seeds = spark.createDataFrame([(q, s) for q in ("1", "2", None) for s in ("c", "a")] + [("3", "a"), ("4", "d")],
                                  "query_id string, seed string")
    members, sets = graph.seed_sets(seeds)
    assert members.count() == 5 and sets.select("query_id").distinct().count() == 3
    columns = ["query_id", "source", "relation", "target", "depth"]
    alone = graph.graph_context(seeds, nodes, edges, max_depth=2).select(*columns).collect()
    shared = graph.shared_context(seeds, nodes, edges, max_depth=2).select(*columns).collect()
    assert len(alone) and sorted(alone, key=str) == sorted(shared, key=str)


def test_adjacency_of_both_directions_stores_each_end_once(spark):
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "s", "b")], "source string, relation string, target string")
    steps = graph.adjacency(edges, "both")
    assert sorted(tuple(r) for r in steps.select("node", "next", "source", "relation", "target").collect()) == [
        ("a", "b", "a", "r", "b"), ("b", "a", "a", "r", "b"), ("b", "b", "b", "s", "b"), ("b", "b", "b", "s", "b")]
    stored = spark.read.parquet(steps.inputFiles()[0].rsplit("/", 1)[0])
    assert [f.name for f in stored.schema if f.dataType.simpleString() == "string"] == ["node", "next", "relation"]


def test_edges_of_a_walk_are_not_searched_again_for_their_domain(spark, monkeypatch):
    n, e = frames(spark, {"a": {"domain": "x"}, "b": {}, "c": {"domain": "y"}, "d": {"domain": "x"}}, [
        ("a", "r", "b", {}), ("a", "s", "c", {}), ("a", "own", "c", {"domain": "x"}), ("b", "r", "d", {"domain": "y"}),
        ("b", "s", "d", {"domain": ""}), ("d", "r", "a", {})])
    n = n.unionByName(n.where("id = 'd'")).unionByName(n.where("id = 'c'"))
    searched, search = [], graph.edges_in_domain

    def counted(found, *rest):
        searched.append(found.count())
        return search(found, *rest)

    monkeypatch.setattr(graph, "edges_in_domain", counted)
    seeds = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, seed string")
    got = as_dict(graph.graph_context(seeds, n, e, "x", 2), "query_id")[("q",)]
    assert got == {("a", "r", "b"): 1, ("a", "own", "c"): 1, ("b", "s", "d"): 2, ("d", "r", "a"): 2}
    assert searched == [0]                  # no seed is a dead end, so only the walk found edges
