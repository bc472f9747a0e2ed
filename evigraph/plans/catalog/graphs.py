"""Graph tables made from the star schema, routing, extraction and question context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...functions import text as tx
from ...operators import chunking, extract, graph, rerank, route
from ...session import cut_lineage, read_table, scratch_path
from ...sources import tables
from .. import evidence
from . import query
from . import sqltext as s
from .retrieval import hits_sql, question_hits, user_questions

# --- the star schema as a property graph ---------------------------------------------------

_KINDS = [  # node kind, table, key, domain
    ("order", "orders", "o_orderkey", "sales"), ("customer", "customer", "c_custkey", "sales"),
    ("supplier", "supplier", "s_suppkey", "supply"), ("part", "part", "p_partkey", "supply"),
    ("nation", "nation", "n_nationkey", None), ("region", "region", "r_regionkey", None),
]
_LINKS = [  # source kind, source key, relation, target kind, target key, table, domain, order
    ("order", "o_orderkey", "placed_by", "customer", "o_custkey", "orders", "sales", 0),
    ("customer", "c_custkey", "located_in", "nation", "c_nationkey", "customer", None, 1),
    ("supplier", "s_suppkey", "located_in", "nation", "s_nationkey", "supplier", None, 2),
    ("supplier", "l_suppkey", "supplies", "part", "l_partkey", "lineitem", "supply", 3),
    ("nation", "n_nationkey", "part_of", "region", "n_regionkey", "nation", None, 4),
]
_MAP = "map<string,string>"


def _props(domain):
    if domain is None:
        return F.create_map().cast(_MAP)
    return F.create_map(F.lit("domain"), F.lit(domain))


def _id(kind, key):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def star_nodes(spark, root):
    parts = [read_table(spark, root, table).select(
        _id(kind, key).alias("id"), F.lit(kind).alias("type"), _props(domain).alias("properties"),
        (F.col(key).cast("long") * 10 + n).alias("seq"))
        for n, (kind, table, key, domain) in enumerate(_KINDS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edge_writes(spark, root):
    parts = [read_table(spark, root, table).select(
        _id(sk, sc).alias("source"), F.lit(rel).alias("relation"), _id(tk, tc).alias("target"),
        _props(domain).alias("properties"),
        (F.lit(n * 10_000_000_000_000) + F.col(sc).cast("long") * 10_000_000 + F.col(tc))
        .alias("seq"))
        for sk, sc, rel, tk, tc, table, domain, n in _LINKS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_edges(spark, root):
    """The merged edges as a stored table, which is what graph operators normally read."""
    return graph.merge_edges(star_edge_writes(spark, root))


NODES = "nodes AS (" + " UNION ALL ".join(
    f"SELECT '{kind}:' || {key} AS id, '{kind}' AS type, "
    f"{'NULL' if d is None else s.quoted(d)}::VARCHAR AS domain FROM {table}"
    for kind, table, key, d in _KINDS) + ")"
EDGES = "edges AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT '{sk}:' || {sc} AS source, '{rel}' AS relation, '{tk}:' || {tc} AS target, "
    f"{'NULL' if d is None else s.quoted(d)}::VARCHAR AS domain, "
    f"{n * 10_000_000_000_000}::BIGINT + {sc}::BIGINT * 10000000 + {tc} AS seq FROM {table}"
    for sk, sc, rel, tk, tc, table, d, n in _LINKS) + ")"


def walk_sql(seeds: str, depth: int, steps: str = "forward", name: str = "walk") -> str:
    """Node distances from seeds, bounded by depth, and the edges found on the way."""
    return f"""{name}_d AS (
        WITH RECURSIVE r(seed, node, distance) AS (
            SELECT seed, seed, 0 FROM {seeds} UNION
            SELECT r.seed, e.next, r.distance + 1 FROM r JOIN {steps} e ON e.node = r.node
            WHERE r.distance < {depth - 1})
        SELECT seed, node, min(distance) AS distance FROM r GROUP BY 1, 2),
    {name} AS (SELECT d.seed, e.source, e.relation, e.target, min(d.distance) + 1 AS depth
        FROM {name}_d d JOIN {steps} e ON e.node = d.node GROUP BY 1, 2, 3, 4)"""


FORWARD = "forward AS (SELECT source AS node, target AS next, * FROM edges)"
BACKWARD = "backward AS (SELECT target AS node, source AS next, * FROM edges)"
BOTH = "bothways AS (SELECT * FROM forward UNION ALL SELECT * FROM backward)"


@query("graph_nodes", "M8 A21 G5", f"""
    WITH {NODES} SELECT type, count(*) AS nodes, min(id) AS first_id FROM nodes GROUP BY 1""")
def graph_nodes(spark, root):
    return graph.merge_nodes(star_nodes(spark, root)).groupBy("type").agg(
        F.count("*").alias("nodes"), F.min("id").alias("first_id"))


@query("graph_edges", "M9 A3", f"""
    WITH {EDGES} SELECT source, relation, target, domain, seq FROM edges""")
def graph_edges(spark, root):
    return star_edges(spark, root).select(
        "source", "relation", "target", F.col("properties")["domain"].alias("domain"), "seq")


@query("graph_counts", "A21 G5", f"""
    WITH {NODES}, {EDGES} SELECT (SELECT count(*) FROM nodes) AS node_count,
        (SELECT count(*) FROM edges) AS edge_count""")
def graph_counts(spark, root):
    return graph.graph_counts(star_nodes(spark, root), star_edges(spark, root))


@query("node_upsert", "A2", """
    SELECT 'user:' || user_id AS id, arg_max(event_type, event_id) AS type,
        arg_max(value, event_id) AS value, min(event_id) AS seq FROM events GROUP BY 1""")
def node_upsert(spark, root):
    """Every event writes its user's node; the last event decides type and properties."""
    e = read_table(spark, root, "events")
    writes = e.select(
        F.concat(F.lit(" user:"), F.col("user_id").cast("string")).alias("id"),
        F.col("event_type").alias("type"),
        F.create_map(F.lit("value"), F.col("value").cast("string")).alias("properties"),
        F.col("event_id").alias("seq"))
    return graph.merge_nodes(writes).select(
        "id", "type", F.col("properties")["value"].cast("double").alias("value"), "seq")


@query("edge_merge", "A3 H9", """
    WITH w AS (SELECT 'user:' || user_id AS source, event_type AS relation,
        'hour:' || extract(hour FROM ts) AS target, 'k' || (json_extract_string(props, '$.k')::INT
            % 3) AS key, event_id FROM events),
    f AS (SELECT source, relation, target, key, min(event_id) AS value FROM w GROUP BY 1, 2, 3, 4)
    SELECT source, relation, target, string_agg(key || '=' || value, ' ' ORDER BY key) AS props,
        min(value) AS seq FROM f GROUP BY 1, 2, 3""")
def edge_merge(spark, root):
    """Edges written again and again; each property key keeps its first value."""
    key = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("int") % 3).cast("string"))
    writes = read_table(spark, root, "events").select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("source"),
        F.col("event_type").alias("relation"),
        F.concat(F.lit("hour:"), F.hour("ts").cast("string")).alias("target"),
        F.create_map(key, F.col("event_id").cast("string")).alias("properties"),
        F.col("event_id").alias("seq"))
    merged = graph.merge_edges(writes)
    pairs = F.array_sort(F.transform(F.map_entries("properties"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])))
    return merged.select("source", "relation", "target",
                         F.array_join(pairs, " ").alias("props"), "seq")


@query("graph_round_trip", "S9", f"""
    WITH {NODES}, {EDGES} SELECT 'node ' || type AS kind, count(*) AS elements FROM nodes GROUP BY 1
    UNION ALL SELECT 'edge ' || relation, count(*) FROM edges GROUP BY 1""")
def graph_round_trip(spark, root):
    """The graph exported as JSON lines and read back."""
    path = scratch_path(spark, "graph")
    tables.graph_to_json(star_nodes(spark, root), star_edges(spark, root), path)
    nodes, edges = tables.graph_from_lines(spark, path)
    return nodes.groupBy(F.concat(F.lit("node "), "type").alias("kind")).agg(
        F.count("*").alias("elements")).unionAll(
        edges.groupBy(F.concat(F.lit("edge "), "relation")).agg(F.count("*")))


@query("graph_json_import", "S9", f"""
    WITH {NODES}, {EDGES} SELECT 'node ' || type AS kind, count(*) AS elements, sum(length(id))::BIGINT AS letters FROM nodes GROUP BY 1
    UNION ALL SELECT 'edge ' || relation, count(*), sum(length(source) + length(target))::BIGINT FROM edges GROUP BY 1""")
def graph_json_import(spark, root):
    """The whole graph as JSON documents of about a thousand elements, imported again."""
    path = scratch_path(spark, "documents")
    nodes, edges = star_nodes(spark, root), star_edges(spark, root)
    rows = graph.graph_counts(nodes, edges).selectExpr("greatest(node_count, edge_count)").first()[0]
    tables.write_documents(tables.graph_documents(nodes, edges, rows), path)
    nodes, edges = tables.graph_from_json(spark, path)
    return nodes.groupBy(F.concat(F.lit("node "), "type").alias("kind")).agg(
        F.count("*").alias("elements"), F.sum(F.char_length("id")).alias("letters")).unionAll(
        edges.groupBy(F.concat(F.lit("edge "), "relation")).agg(
            F.count("*"), F.sum(F.char_length("source") + F.char_length("target"))))


# --- neighbours and traversal -------------------------------------------------------------

@query("neighbors_related", "J10", f"""
    WITH {EDGES} SELECT s.s_suppkey AS supplier, e.source, e.relation, e.target
    FROM supplier s JOIN edges e ON 'supplier:' || s.s_suppkey IN (e.source, e.target)""")
def neighbors_related(spark, root):
    ids = read_table(spark, root, "supplier").select(_id("supplier", "s_suppkey").alias("id"))
    found = graph.neighbors(ids, star_edges(spark, root))
    return found.select(F.substring_index("id", ":", -1).cast("long").alias("supplier"),
                        "source", "relation", "target")


@query("neighbors_incoming", "J10", f"""
    WITH {EDGES} SELECT e.target AS id, e.source, e.relation FROM nation n
    JOIN edges e ON e.target = 'nation:' || n.n_nationkey WHERE e.relation = 'located_in'""")
def neighbors_incoming(spark, root):
    ids = read_table(spark, root, "nation").select(_id("nation", "n_nationkey").alias("id"))
    return graph.neighbors(ids, star_edges(spark, root), "incoming", "located_in").select(
        "id", "source", "relation")


@query("node_lookup", "G4", f"""
    WITH {NODES} SELECT DISTINCT n.id, n.type, n.domain FROM nodes n
    JOIN orders o ON n.id = 'customer:' || o.o_custkey WHERE o.o_orderstatus = 'F'""")
def node_lookup(spark, root):
    ids = read_table(spark, root, "orders").where("o_orderstatus = 'F'").select(
        _id("customer", "o_custkey").alias("id"))
    return graph.lookup(ids, star_nodes(spark, root)).select(
        "id", "type", F.col("properties")["domain"].alias("domain"))


def _order_seeds(spark, root):
    return read_table(spark, root, "orders").select(_id("order", "o_orderkey").alias("seed"))


@query("traverse_outgoing", "G1 M10", f"""
    WITH {EDGES}, {FORWARD}, seeds AS (SELECT 'order:' || o_orderkey AS seed FROM orders),
    {walk_sql('seeds', 3)} SELECT seed, source, relation, target, depth::INTEGER AS depth
    FROM walk""")
def traverse_outgoing(spark, root):
    """From every order to its customer, nation and region."""
    return graph.traverse(_order_seeds(spark, root), star_nodes(spark, root),
                          star_edges(spark, root), 3)


@query("traverse_incoming", "G1", f"""
    WITH {EDGES}, {BACKWARD}, seeds AS (SELECT 'region:' || r_regionkey AS seed FROM region),
    {walk_sql('seeds', 3, 'backward')} SELECT seed, relation, depth::INTEGER AS depth,
        count(*) AS edges, min(source) AS first_source FROM walk GROUP BY 1, 2, 3""")
def traverse_incoming(spark, root):
    """Everything that leads to a region, counted per relation and depth."""
    seeds = read_table(spark, root, "region").select(_id("region", "r_regionkey").alias("seed"))
    return graph.traverse(seeds, star_nodes(spark, root), star_edges(spark, root), 3, "incoming") \
        .groupBy("seed", "relation", "depth").agg(
            F.count("*").alias("edges"), F.min("source").alias("first_source"))


@query("traverse_both", "G1", f"""
    WITH {EDGES}, {FORWARD}, {BACKWARD}, {BOTH},
    seeds AS (SELECT 'nation:' || n_nationkey AS seed FROM nation),
    {walk_sql('seeds', 2, 'bothways')} SELECT seed, source, relation, target,
        depth::INTEGER AS depth FROM walk""")
def traverse_both(spark, root):
    seeds = read_table(spark, root, "nation").select(_id("nation", "n_nationkey").alias("seed"))
    return graph.traverse(seeds, star_nodes(spark, root), star_edges(spark, root), 2, "both")


@query("traverse_one_relation", "G1", f"""
    WITH {EDGES}, {FORWARD}, located AS (SELECT * FROM forward WHERE relation = 'located_in'),
    seeds AS (SELECT 'supplier:' || s_suppkey AS seed FROM supplier),
    {walk_sql('seeds', 3, 'located')} SELECT seed, target, depth::INTEGER AS depth FROM walk""")
def traverse_one_relation(spark, root):
    """The relation filter also stops the expansion."""
    seeds = read_table(spark, root, "supplier").select(_id("supplier", "s_suppkey").alias("seed"))
    return graph.traverse(seeds, star_nodes(spark, root), star_edges(spark, root), 3,
                          relation="located_in").select("seed", "target", "depth")


# --- terminal seeds and question context ---------------------------------------------------

def _terminal_sql(depth):
    onward = f"""
        UNION ALL SELECT i.seed, w.source, w.relation, w.target, i.seq, 1, w.depth + 1
        FROM into_seed i JOIN back w ON w.seed = i.source""" if depth > 1 else ""
    walk = f", {walk_sql('parents', depth - 1, name='back')}" if depth > 1 else ""
    return f"""into_seed AS (SELECT t.seed, e.* FROM dead_ends t
            JOIN edges e ON e.target = t.seed),
        parents AS (SELECT DISTINCT i.source AS seed FROM into_seed i JOIN nodes n
            ON n.id = i.source){walk},
        steps_back AS (SELECT seed, source, relation, target, seq, 0 AS kind, 1 AS depth
            FROM into_seed{onward}),
        terminal AS (SELECT seed, source, relation, target, depth FROM (SELECT *, row_number()
            OVER (PARTITION BY seed, source, relation, target ORDER BY seq, kind) AS n
            FROM steps_back) WHERE n = 1)"""


@query("terminal_regions", "G3", f"""
    WITH {NODES}, {EDGES}, {FORWARD},
    dead_ends AS (SELECT 'region:' || r_regionkey AS seed FROM region), {_terminal_sql(3)}
    SELECT seed, source, relation, target, depth::INTEGER AS depth FROM terminal""")
def terminal_regions(spark, root):
    seeds = read_table(spark, root, "region").select(_id("region", "r_regionkey").alias("seed"))
    return graph.terminal_edges(seeds, star_nodes(spark, root), star_edges(spark, root), 3)


@query("terminal_parts", "G3", f"""
    WITH {NODES}, {EDGES}, {FORWARD},
    dead_ends AS (SELECT 'part:' || p_partkey AS seed FROM part), {_terminal_sql(1)}
    SELECT seed, source, relation, depth::INTEGER AS depth FROM terminal""")
def terminal_parts(spark, root):
    seeds = read_table(spark, root, "part").select(_id("part", "p_partkey").alias("seed"))
    return graph.terminal_edges(seeds, star_nodes(spark, root), star_edges(spark, root), 1) \
        .select("seed", "source", "relation", "depth")


def _context_sql(depth, domain=None):
    """Edges per question for ``pairs(query_id, seed)``."""
    keep = "TRUE"
    if domain:
        keep = f"""CASE WHEN coalesce(e.domain, '') <> '' THEN e.domain = '{domain}'
            ELSE coalesce(a.domain, '{domain}') = '{domain}'
            AND coalesce(b.domain, '{domain}') = '{domain}' END"""
    return f"""starts AS (SELECT DISTINCT p.seed FROM pairs p JOIN nodes n ON n.id = p.seed),
    {walk_sql('starts', depth)},
    dead_ends AS (SELECT DISTINCT seed FROM pairs WHERE seed NOT IN (SELECT seed FROM walk)),
    {_terminal_sql(depth)},
    allowed AS (SELECT e.source, e.relation, e.target FROM edges e
        LEFT JOIN nodes a ON a.id = e.source LEFT JOIN nodes b ON b.id = e.target WHERE {keep}),
    found AS (SELECT * FROM (SELECT * FROM walk UNION ALL SELECT * FROM terminal)
        JOIN allowed USING (source, relation, target)),
    context AS (SELECT query_id, source, relation, target, depth FROM (SELECT p.query_id, f.*,
        row_number() OVER (PARTITION BY p.query_id, f.source, f.relation, f.target
            ORDER BY p.seed) AS n FROM (SELECT DISTINCT * FROM pairs) p
        JOIN found f ON f.seed = p.seed) WHERE n = 1)"""


PAIRS = """pairs AS (SELECT 'q' || o_orderkey AS query_id, 'order:' || o_orderkey AS seed
        FROM orders UNION ALL SELECT 'q' || o.o_orderkey, 'nation:' || c.c_nationkey
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    UNION ALL SELECT 'q' || o.o_orderkey, 'region:' || n.n_regionkey
        FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderpriority = '1-URGENT')"""


def _order_pairs(spark, root):
    o = read_table(spark, root, "orders")
    c = read_table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                                   "c_nationkey")
    n = read_table(spark, root, "nation").select(F.col("n_nationkey").alias("c_nationkey"),
                                                 "n_regionkey")
    qid = F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("query_id")
    placed = o.join(c, "o_custkey")
    return (o.select(qid, _id("order", "o_orderkey").alias("seed"))
            .unionAll(placed.select(qid, _id("nation", "c_nationkey")))
            .unionAll(placed.where("o_orderpriority = '1-URGENT'").join(n, "c_nationkey")
                      .select(qid, _id("region", "n_regionkey"))))


@query("graph_context", "G2 G3 W7", f"""
    WITH {NODES}, {EDGES}, {FORWARD}, {PAIRS}, {_context_sql(3)}
    SELECT query_id, source, relation, target, depth::INTEGER AS depth FROM context""")
def graph_context(spark, root):
    """One question per order, seeded with the order, its nation and sometimes its region."""
    return graph.graph_context(_order_pairs(spark, root), star_nodes(spark, root),
                               star_edges(spark, root))


@query("graph_context_in_domain", "G2 P10 W7", f"""
    WITH {NODES}, {EDGES}, {FORWARD}, {PAIRS}, {_context_sql(2, 'sales')}
    SELECT query_id, source, relation, target, depth::INTEGER AS depth FROM context""")
def graph_context_in_domain(spark, root):
    return graph.graph_context(_order_pairs(spark, root), star_nodes(spark, root),
                               star_edges(spark, root), "sales", 2)


@query("domain_edges", "P10", f"""
    WITH {NODES}, {EDGES} SELECT e.source, e.relation, e.target FROM edges e
    LEFT JOIN nodes a ON a.id = e.source LEFT JOIN nodes b ON b.id = e.target
    WHERE CASE WHEN e.domain IS NOT NULL THEN e.domain = 'supply'
        ELSE coalesce(a.domain, 'supply') = 'supply' AND coalesce(b.domain, 'supply') = 'supply'
        END""")
def domain_edges(spark, root):
    edges = star_edges(spark, root)
    return graph.edges_in_domain(edges.select(*graph.EDGE), edges, star_nodes(spark, root),
                                 "supply")


@query("domain_nodes", "P9", f"""
    WITH {NODES} SELECT id, type FROM nodes WHERE domain IS NULL OR domain = 'sales'""")
def domain_nodes(spark, root):
    return graph.nodes_in_domain(star_nodes(spark, root), "sales").select("id", "type")


# --- routing --------------------------------------------------------------------------------

# Short words of the corpus stand in for entity names; they match as substrings.
ALIASES = [("region:0", "thand"), ("region:1", "eaux"), ("nation:3", "tion"),
           ("nation:4", "ichsch"), ("nation:5", "heit"), ("customer:7", "oue"),
           ("supplier:8", "hein"), ("customer:2", "ado"), ("customer:3", "cióna"),
           ("missing:1", "the"), ("customer:7", "ingth")]
TOOLS = [("fr", "nation:6"), ("de", "region:2"), ("es", "missing:2"), ("en", "customer:9")]
SOURCES = [("src0", "supplier:1"), ("src0", "part:4"), ("src3", "region:4"), ("src5", "nation:1"),
           ("src7", "order:11")]
PATTERNS = [("workflow", r"\bund\b"), ("workflow", r"\bthe\b.+\bfor\b"),
            ("relationship", r"\bles?\b"), ("relationship", r"\band\b"),
            ("boundary", r"\bnicht mit\b"), ("boundary", r"\bpara (?:el|la)\b"),
            ("boundary", r"\bfrom\b"), ("direct", r"\bpour\b"), ("direct", r"\bthis (?:is|that)\b"),
            ("direct", r"\bwith\b")]


def _boundaries(pattern: str) -> str:
    r"""A pattern with ``\b`` as Unicode word boundaries for an engine without them."""
    word = "[^\\p{L}\\p{N}\\p{M}_]"
    parts = pattern.split(r"\b")
    inner = parts[1:-1]
    body = f"(?:^|{word})" + inner[0]
    if len(inner) == 3:       # two words with any text between: A\b.+\bB
        near = word.replace("_]", "_\\n]")
        gap = f"(?:{near}.*{near}|{near})"
        body += gap + inner[2]
    return body + f"(?:$|{word})"


def route_sql(aliases, patterns, source="questions"):
    def hit(group):
        mine = [f"regexp_matches(lower(question), {s.quoted(_boundaries(p))})"
                for g, p in patterns if g == group]
        return "(" + " OR ".join(mine) + ")"
    return f"""named AS (SELECT q.query_id, list_sort(list_distinct(list(a.entity))) AS nodes
        FROM {source} q JOIN {s.values(aliases, 'entity, alias').replace(') AS t(', ') AS a(')}
        ON contains(lower(q.question), a.alias) GROUP BY 1),
    flags AS (SELECT q.query_id, q.question, coalesce(n.nodes, []) AS nodes,
        {hit('workflow')} AS w, {hit('relationship')} AS r, {hit('boundary')} AS b,
        {hit('direct')} AS d FROM {source} q LEFT JOIN named n USING (query_id)),
    chosen AS (SELECT *, b OR (w AND len(nodes) >= 1) OR (r AND len(nodes) >= 2 AND NOT d)
        OR (len(nodes) >= 3 AND NOT d) AS g FROM flags),
    routed AS (SELECT query_id, question, nodes,
        CASE WHEN g THEN 'graph' ELSE 'vector' END AS selected_mode,
        CASE WHEN g THEN CASE WHEN b THEN 0.9 WHEN w THEN 0.85 ELSE 0.75 END
            WHEN d THEN 0.85 ELSE 0.65 END::DOUBLE AS confidence,
        array_to_string(list_filter([CASE WHEN w THEN 'workflow_language' END,
            CASE WHEN r THEN 'relationship_language' END, CASE WHEN b THEN 'boundary_question' END,
            CASE WHEN d THEN 'direct_evidence_question' END,
            CASE WHEN len(nodes) >= 2 THEN 'multiple_question_entities' END,
            CASE WHEN NOT (w OR r OR b OR d OR len(nodes) >= 2)
                THEN 'conservative_vector_default' END], lambda x: x IS NOT NULL), ' ') AS signals
        FROM chosen)"""


def _turns(spark, root):
    return read_table(spark, root, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("query_id"), F.col("text").alias("question"))


TURNS = """questions AS (SELECT conv_id || '-' || turn AS query_id, text AS question
    FROM conversations)"""


def _decision(df):
    return df.select("query_id", "selected_mode", "confidence",
                     F.array_join("signals", " ").alias("signals"),
                     F.array_join("entity_nodes", " ").alias("entity_nodes"))


_DECISION = """SELECT query_id, selected_mode, confidence, signals,
    array_to_string(nodes, ' ') AS entity_nodes FROM routed"""


@query("route_default_rules", "T8 J3 M11", f"""
    WITH questions AS (SELECT 'd' || doc_id AS query_id, text AS question FROM documents
        WHERE {s.strip('text')} <> ''),
    {route_sql(vocab.ALIASES, vocab.ROUTE_PATTERNS)} {_DECISION}""")
def route_default_rules(spark, root):
    """Every document taken as a question, with the default aliases and patterns."""
    q = read_table(spark, root, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("query_id"),
        F.col("text").alias("question")).where(~tx.is_blank("question"))
    return _decision(route.route(q))


@query("route_own_rules", "T8 J3 U3", f"""
    WITH {TURNS}, {route_sql(ALIASES, PATTERNS)} {_DECISION}""")
def route_own_rules(spark, root):
    """All turns with aliases and patterns of the corpus, passed as tables."""
    aliases = spark.createDataFrame(ALIASES, "entity string, alias string")
    patterns = spark.createDataFrame(PATTERNS, "group string, pattern string")
    return _decision(route.route(_turns(spark, root), aliases, patterns))


@query("route_forced", "T8", f"""
    WITH {TURNS}, {route_sql(ALIASES, PATTERNS)} SELECT query_id, 'vector' AS selected_mode,
        1.0::DOUBLE AS confidence, 'explicit_override' AS signals,
        array_to_string(nodes, ' ') AS entity_nodes FROM routed""")
def route_forced(spark, root):
    return _decision(route.route(_turns(spark, root), ALIASES, PATTERNS, "vector"))


@query("entity_matches", "J3", f"""
    WITH {TURNS} SELECT q.query_id, a.entity AS node, count(*) AS aliases FROM questions q
    JOIN {s.values(ALIASES, 'entity, alias').replace(') AS t(', ') AS a(')}
    ON contains(lower(q.question), a.alias) GROUP BY 1, 2""")
def entity_matches(spark, root):
    """Matched entities with the number of their aliases that occur."""
    q = route.match_entities(_turns(spark, root), ALIASES)
    per = [(e, [a for x, a in ALIASES if x == e]) for e in dict.fromkeys(x for x, _ in ALIASES)]
    count = F.lit(0)
    for entity, names in per:
        hits = sum((F.contains(F.lower("question"), F.lit(a)).cast("int") for a in names), F.lit(0))
        count = F.when(F.col("node") == entity, hits).otherwise(count)
    return q.select("query_id", "question", F.explode("entity_nodes").alias("node")).select(
        "query_id", "node", count.cast("long").alias("aliases"))


def _seeds_sql(domain=None):
    keep = f"AND coalesce(n.domain, '{domain}') = '{domain}'" if domain else ""
    return f"""wanted AS (SELECT query_id, unnest(nodes) AS seed FROM routed
        UNION SELECT h.query_id, t.node FROM hits h
            JOIN {s.values(TOOLS, 'tool, node')} ON t.tool = h.tool
        UNION SELECT h.query_id, t.node FROM hits h
            JOIN {s.values(SOURCES, 'source_id, node')} ON t.source_id = h.source_id),
    pairs AS (SELECT DISTINCT w.query_id, w.seed FROM wanted w JOIN nodes n ON n.id = w.seed
        WHERE TRUE {keep})"""


_ASKED = "questions AS (SELECT query_id, question FROM q)"


@query("seed_nodes", "J4 J5 P9 O5", f"""
    WITH {hits_sql()}, {_ASKED}, {NODES}, {route_sql(ALIASES, PATTERNS)}, {_seeds_sql('sales')}
    SELECT query_id, seed FROM pairs""")
def seed_nodes(spark, root):
    return graph.seed_nodes(user_questions(spark, root), question_hits(spark, root),
                            star_nodes(spark, root), ALIASES, TOOLS, SOURCES, "sales")


@query("answer_context", "A7 G2 T8 J5 O3 W7", f"""
    WITH {hits_sql()}, {_ASKED}, {NODES}, {EDGES}, {FORWARD}, {route_sql(ALIASES, PATTERNS)},
    to_graph AS (SELECT * FROM routed WHERE selected_mode = 'graph'
        AND query_id IN (SELECT query_id FROM hits)),
    wanted AS (SELECT query_id, unnest(nodes) AS seed FROM to_graph
        UNION SELECT h.query_id, t.node FROM hits h JOIN to_graph USING (query_id)
            JOIN {s.values(TOOLS, 'tool, node')} ON t.tool = h.tool
        UNION SELECT h.query_id, t.node FROM hits h JOIN to_graph USING (query_id)
            JOIN {s.values(SOURCES, 'source_id, node')} ON t.source_id = h.source_id),
    pairs AS (SELECT DISTINCT w.query_id, w.seed FROM wanted w JOIN nodes n ON n.id = w.seed),
    {_context_sql(2)},
    texts AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS t
        FROM hits GROUP BY 1),
    lines AS (SELECT query_id, count(*) AS n, string_agg(source || ' ' || relation || ' '
        || target || ' (depth ' || depth || ')', chr(10)
        ORDER BY depth, source, relation, target) AS g FROM context GROUP BY 1),
    seeds AS (SELECT query_id, string_agg(seed, ' ' ORDER BY seed) AS seeds FROM pairs GROUP BY 1)
    SELECT r.query_id, r.selected_mode, s.seeds, coalesce(l.n, 0) AS graph_edges,
        md5(t.t || coalesce(chr(10) || chr(10) || 'Knowledge graph relationships:' || chr(10)
            || l.g, '')) AS context_md5
    FROM routed r LEFT JOIN texts t USING (query_id) LEFT JOIN lines l USING (query_id)
        LEFT JOIN seeds s USING (query_id)""")
def answer_context(spark, root):
    """The whole path for a batch of questions: route, retrieve, seed, traverse, assemble."""
    out = evidence.answer_context(
        user_questions(spark, root), question_hits(spark, root), star_nodes(spark, root),
        star_edges(spark, root), ALIASES, PATTERNS, TOOLS, SOURCES, max_depth=2)
    return out.select("query_id", "selected_mode", F.array_join("seeds", " ").alias("seeds"),
                      "graph_edges", F.md5("context").alias("context_md5"))


@query("context_lines", "A7 O3 G2 J5", f"""
    WITH {hits_sql(2)}, {_ASKED}, {NODES}, {EDGES}, {FORWARD}, {route_sql(ALIASES, PATTERNS)}, {_seeds_sql()},
    {_context_sql(1)}
    SELECT query_id, depth, source, relation, target,
        source || ' ' || relation || ' ' || target || ' (depth ' || depth || ')' AS line FROM context""")
def context_lines(spark, root):
    """Graph lines of all questions as rows; a question that meets a hub is many rows, not one value."""
    hits = cut_lineage(question_hits(spark, root, k=2), "hits")
    nodes = star_nodes(spark, root)
    seeds = cut_lineage(graph.seed_nodes(user_questions(spark, root), hits, nodes, ALIASES, TOOLS, SOURCES), "seeds")
    return rerank.context_edges(graph.shared_context(seeds, nodes, star_edges(spark, root), max_depth=1))


# --- extraction --------------------------------------------------------------------------------

ENTITY_RULES = [("tion", "tion", "suffix"), ("thand", "thand", "stem"), ("eaux", "eaux", "stem"),
                ("ouen", "ouen", "stem"), ("license", "licence", "legal"),
                ("licence", "licence", "legal"), ("copyright", "copyright", "legal"),
                ("token", "token", "secret"), ("password", "token", "secret"),
                ("@", "mail", "personal")]
RELATION_RULES = [("licence", "mentions", "copyright"), ("tion", "near", "thand"),
                  ("eaux", "near", "ouen"), ("tion", "near", "eaux"), ("token", "guards", "mail"),
                  ("thand", "near", "ouen")]


def _chunks_to_read(spark, root):
    d = read_table(spark, root, "documents").select(
        "doc_id", "source", F.col("lang").alias("domain"), "text")
    return chunking.chunk(d).withColumn(
        "seq", F.col("doc_id") * 1000 + F.col("position")).withColumnRenamed("chunk_text", "text")


def _extracted(spark, root, entity_rules=ENTITY_RULES, relation_rules=RELATION_RULES):
    found = extract.extract_entities(_chunks_to_read(spark, root), entity_rules)
    return extract.extract_relations(found, relation_rules)


EXTRACTED = f"""spans AS (SELECT *, unnest(range(0,
            greatest(0, ceil((length(text) - 500) / 450.0))::BIGINT + 1)) AS number
        FROM documents),
    cut AS (SELECT doc_id, source, lang AS domain, number,
        {s.strip('substring(text, number * 450 + 1, 500)')} AS chunk_text FROM spans),
    chunks AS (SELECT *, doc_id * 1000 + row_number() OVER (PARTITION BY doc_id ORDER BY number)
        - 1 AS seq FROM cut WHERE chunk_text <> ''),
    entities AS (SELECT DISTINCT c.seq, c.domain, c.source, r.node_id, r.type FROM chunks c
        JOIN {s.values(ENTITY_RULES, 'needle, node_id, type').replace(') AS t(', ') AS r(')}
        ON contains(lower(c.chunk_text), r.needle)),
    relations AS (SELECT a.seq, r.source, r.relation, r.target FROM {
        s.values(RELATION_RULES, 'source, relation, target').replace(') AS t(', ') AS r(')}
        JOIN entities a ON a.node_id = r.source
        JOIN entities b ON b.node_id = r.target AND b.seq = a.seq)"""


@query("extract_entities", "T5", f"""
    WITH {EXTRACTED} SELECT seq, node_id, type, domain, source FROM entities""")
def extract_entities(spark, root):
    return _extracted(spark, root).select(
        "seq", F.explode("entities").alias("e"), "domain", "source").select(
        "seq", "e.node_id", "e.type", "domain", "source")


@query("extract_relations", "T6", f"""
    WITH {EXTRACTED} SELECT seq, source, relation, target FROM relations""")
def extract_relations(spark, root):
    return _extracted(spark, root).select("seq", F.explode("relations").alias("r")).select(
        "seq", "r.*")


@query("extract_to_graph", "T5 T6 A2 A3", f"""
    WITH {EXTRACTED} SELECT node_id AS element, arg_max(type, seq) AS kind,
        arg_max(domain || '/' || source, seq) AS provenance, min(seq) AS seq
        FROM entities GROUP BY 1
    UNION ALL SELECT source || '>' || target, relation, NULL, min(seq) FROM relations
        GROUP BY source, target, relation""")
def extract_to_graph(spark, root):
    """Chunks read into a merged graph; the newest chunk gives a node its provenance."""
    found = _extracted(spark, root)
    nodes = graph.merge_nodes(extract.node_writes(found))
    edges = graph.merge_edges(extract.edge_writes(found))
    props = F.col("properties")
    return nodes.select(
        F.col("id").alias("element"), F.col("type").alias("kind"),
        F.concat(props["domain"], F.lit("/"), props["source"]).alias("provenance"), "seq",
    ).unionAll(edges.select(F.concat("source", F.lit(">"), "target"), "relation",
                            F.lit(None).cast("string"), "seq"))


_DEFAULT_NODES = s.values(vocab.ENTITY_RULES, "needle, node_id, type")


@query("curated_graph", "T7 A2 A3 G5", f"""
    WITH curated_n AS (SELECT * FROM {s.values([(i,) for c in vocab.CURATED.values()
                                               for i, _ in c['nodes']], 'id')}),
    curated_e AS (SELECT * FROM {s.values([e for c in vocab.CURATED.values() for e in c['edges']],
                                          'source, relation, target')}),
    found AS (SELECT DISTINCT d.doc_id, r.node_id FROM documents d
        JOIN {_DEFAULT_NODES.replace(') AS t(', ') AS r(')} ON contains(lower(d.text), r.needle)),
    rel AS (SELECT DISTINCT t.source, t.relation, t.target FROM
        {s.values(vocab.RELATION_RULES, 'source, relation, target')}
        JOIN found a ON a.node_id = t.source JOIN found b ON b.node_id = t.target
        AND a.doc_id = b.doc_id)
    SELECT (SELECT count(*) FROM (SELECT id FROM curated_n UNION SELECT node_id FROM found))
            AS nodes,
        (SELECT count(*) FROM (SELECT * FROM curated_e UNION SELECT * FROM rel)) AS edges,
        (SELECT count(DISTINCT id) FROM curated_n WHERE id NOT IN (SELECT node_id FROM found))
            AS nodes_created""")
def curated_graph(spark, root):
    """The curated workflows loaded twice over the graph read from whole documents."""
    docs = read_table(spark, root, "documents").select(
        "text", "source", F.col("lang").alias("domain"), F.col("doc_id").alias("seq"))
    found = cut_lineage(extract.extract_relations(extract.extract_entities(docs)).drop("text"))
    before = cut_lineage(graph.merge_nodes(extract.node_writes(found)), "nodes")
    nodes, edges = before, cut_lineage(graph.merge_edges(extract.edge_writes(found)), "edges")
    for _ in range(2):
        nodes, edges = extract.load_graph(nodes, edges, *extract.curated_graph(spark))
    created = graph.created(before, nodes, ["id"]).agg(F.count("*").alias("nodes_created"))
    return graph.graph_counts(nodes, edges).select(
        F.col("node_count").alias("nodes"), F.col("edge_count").alias("edges"),
        F.lit(1).alias("_one")).join(created.withColumn("_one", F.lit(1)), "_one").drop("_one")
