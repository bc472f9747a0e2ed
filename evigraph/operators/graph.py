"""Property-graph tables: merging writes, neighbours, bounded traversal, question context.

``nodes(id, type, properties map<string,string>, seq)`` and
``edges(source, relation, target, properties map<string,string>, seq)``; ``seq`` is the
insertion position and is the only notion of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage, rule_rows
from ..sources.buckets import bucketed

EDGE = ["source", "relation", "target"]
DIRECTIONS = ("outgoing", "incoming", "both")
EMPTY_MAP = "map<string,string>"
_SPREAD = 4


# --- merging ------------------------------------------------------------------

def merge_nodes(writes: DataFrame) -> DataFrame:
    """Last write wins: it replaces the type and the whole property map.

    A node keeps the position of its first write. Blank ids or types are
    not written; ``node_rejects`` lists them.
    """
    rows = writes.select(
        tx.strip("id").alias("id"), tx.strip("type").alias("type"), "properties", "seq"
    ).where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("type", F.lit("")) != ""))
    return (
        rows.groupBy("id").agg(
            F.max_by(F.struct("type", "properties"), "seq").alias("w"),
            F.min("seq").alias("seq"))
        .select("id", "w.type",
                F.coalesce("w.properties", F.create_map().cast(EMPTY_MAP)).alias("properties"),
                "seq")
    )


def node_rejects(writes: DataFrame) -> DataFrame:
    """Node writes that ``merge_nodes`` does not take, with their reason."""
    reason = F.when(tx.is_blank("id"), F.lit("id is blank")).when(tx.is_blank("type"), F.lit("type is blank"))
    return writes.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")


def edge_rejects(writes: DataFrame) -> DataFrame:
    """Edge writes that ``merge_edges`` does not take, with their reason."""
    reason = F.coalesce(*[F.when(tx.is_blank(c), F.lit(f"{c} is blank")) for c in EDGE])
    return writes.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")


def merge_edges(writes: DataFrame) -> DataFrame:
    """One edge per (source, relation, target).

    For every property key the first writer wins; later writers only add keys. The edge keeps
    the position of its first write. Blank ends are not written; ``edge_rejects`` lists them.

    One aggregate settles every edge whose writes all have the same keys, as its first write
    is the result then; only the writes of other edges are taken apart by key. All steps
    combine before they shuffle, so repeated writes of one edge do not pile up in a task.
    Blank ends are left out of what is stored: a filter of the writes would trim them twice.
    """
    rows = writes.select(*[tx.strip(c).alias(c) for c in EDGE], "properties", "seq")
    # Ids share long prefixes, which makes sorting by them slow; the hash in front of the
    # grouping key tells almost all of them apart in one comparison.
    key = [F.xxhash64(*EDGE).alias("_hash"), *EDGE]
    names = F.map_keys("properties")
    keys = F.when(F.size(names) == 1, F.concat(F.lit("1"), names[0])) \
        .when(F.size(names) > 1, F.to_json(F.sort_array(names))).otherwise(F.lit("[]"))
    merged = cut_lineage(
        rows.select(*key, "seq", "properties", keys.alias("_keys")).groupBy("_hash", *EDGE).agg(
            F.min_by("properties", "seq").alias("properties"), F.min("seq").alias("seq"),
            (F.min("_keys") == F.max("_keys")).alias("_alike")), "edges")
    for c in EDGE:
        merged = merged.where(F.col(c) != "")
    empty = F.create_map().cast(EMPTY_MAP)
    alike = merged.where("_alike").select(*EDGE, F.coalesce("properties", empty).alias("properties"), "seq")
    others = merged.where("NOT _alike").select(*EDGE)
    if others.limit(1).isEmpty():
        return alike
    apart = rows.join(others, EDGE, "left_semi").select(*key, "seq", F.explode_outer("properties").alias("key", "value"))
    per_key = apart.groupBy("_hash", *EDGE, "key").agg(
        F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    entries = F.collect_list(F.when(F.col("key").isNotNull(), F.struct("key", "value")))
    return alike.unionByName(per_key.groupBy("_hash", *EDGE).agg(
        F.map_from_entries(F.array_sort(entries)).alias("properties"),
        F.min("seq").alias("seq")).drop("_hash"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts as one row."""
    tagged = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionAll(
        edges.select(F.lit(0), F.lit(1)))
    return tagged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("node_count"),
                      F.coalesce(F.sum("e"), F.lit(0)).alias("edge_count"))


def created(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``after`` that ``before`` does not have."""
    return after.join(before.select(*key), key, "left_anti")


def lookup(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the given ``id`` rows."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


# --- neighbours and traversal -----------------------------------------------------

def _of_relation(edges: DataFrame, relation: str | None) -> DataFrame:
    return edges if relation is None else edges.where(F.col("relation") == relation)


def neighbors(ids: DataFrame, edges: DataFrame, direction: str = "related",
              relation: str | None = None) -> DataFrame:
    """Edges that touch each ``id``: ``outgoing``, ``incoming`` or ``related`` (either end).

    A self-loop is reported once.
    """
    if direction not in ("outgoing", "incoming", "related"):
        raise ValueError("direction must be outgoing, incoming or related")
    ids = ids.select("id").distinct()
    edges = _of_relation(edges, relation)
    out = ids.join(edges, ids["id"] == edges["source"])
    into = ids.join(edges, ids["id"] == edges["target"])
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return into
    return out.unionByName(into.where(F.col("source") != F.col("target")))


def adjacency(edges: DataFrame, direction: str = "outgoing", relation: str | None = None,
              more: tuple[str, ...] = ()) -> DataFrame:
    """``(node, next, source, relation, target, *more)``, a stored table bucketed by ``node``.

    The edges are shuffled once, when it is made; every level of a walk shuffles what it has
    reached and reads the buckets where they are.
    """
    edges = _of_relation(edges, relation).select(*EDGE, *more)
    if direction == "both":
        # both ends are in the row already, so a flag says which one is the source
        there, back = F.lit(True).alias("_out"), F.lit(False).alias("_out")
        forward = edges.select(F.col("source").alias("node"), F.col("target").alias("next"), "relation", there, *more)
        backward = edges.select(F.col("target").alias("node"), F.col("source").alias("next"), "relation", back, *more)
        stored = bucketed(forward.unionAll(backward), ["node"], "adjacency")
        return stored.select("node", "next", F.when(F.col("_out"), F.col("node")).otherwise(F.col("next")).alias("source"),
                             "relation", F.when(F.col("_out"), F.col("next")).otherwise(F.col("node")).alias("target"), *more)
    near, far = ("source", "target") if direction == "outgoing" else ("target", "source")
    stored = bucketed(edges, [near], "adjacency")
    return stored.select(F.col(near).alias("node"), F.col(far).alias("next"), *EDGE, *more)


def traverse(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 2,
             direction: str = "outgoing", relation: str | None = None,
             steps: DataFrame | None = None) -> DataFrame:
    """Breadth-first edges from every seed: ``(seed, source, relation, target, depth)``.

    All seeds advance together, one level per pass. A level joins the edges once: what it finds
    is stored and holds the next level's nodes as well, and only the last level is left as a
    join. A node counts at its least distance, so an edge's depth is one more than the distance
    of its nearest expanding end. A seed that is not a registered node yields nothing; nodes met
    on the way need not be registered. ``steps`` is the ``adjacency`` of the edges, for callers
    that walk them more than once; its further columns come along unless the direction is ``both``.
    """
    if max_depth <= 0:
        raise ValueError("max_depth must be greater than zero")
    direction = direction.strip().lower()
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if steps is None:
        steps = adjacency(edges, direction, relation)

    registered = nodes.select(F.col("id").alias("seed"))
    level = (seeds.select(tx.strip("seed").alias("seed")).distinct()
             .join(registered, "seed", "left_semi")
             .select("seed", F.col("seed").alias("node"), F.lit(0).alias("distance")))
    far = {"outgoing": "target", "incoming": "source", "both": "next"}[direction]
    more = [] if direction == "both" else [c for c in steps.columns if c not in ("node", "next", *EDGE)]
    kept = list(dict.fromkeys(["seed", *EDGE, far, *more]))
    reached, parts = level, []
    for distance in range(max_depth):
        last = distance == max_depth - 1
        walked = level.join(steps, "node").select(*kept)
        if not last:
            walked = cut_lineage(walked, "walked")
        parts.append(walked.select("seed", *EDGE, *more, F.lit(distance + 1).alias("depth")))
        if last:
            break
        ahead = walked.select("seed", F.col(far).alias("node"), F.lit(distance + 1).alias("distance")) \
            .where("node IS NOT NULL AND node <> seed")
        if distance:        # of the seeds themselves the filter has taken care
            ahead = reached.unionByName(ahead)
        level = cut_lineage(ahead.groupBy("seed", "node").agg(F.min("distance").alias("distance"))
                            .where(F.col("distance") == distance + 1))
        if level.isEmpty():
            break
        reached = reached.unionByName(level) if distance else level
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if direction == "both":
        found = found.groupBy("seed", *EDGE).agg(F.min("depth").alias("depth"))
    return found


# --- domain isolation ---------------------------------------------------------------

def nodes_in_domain(nodes: DataFrame, domain: str | None) -> DataFrame:
    """Nodes of the domain and nodes without one; all nodes when no domain is asked for."""
    if not domain:
        return nodes
    own = F.coalesce(F.col("properties")["domain"], F.lit(""))
    return nodes.where((own == "") | (own == domain))


def edges_in_domain(found: DataFrame, edges: DataFrame, nodes: DataFrame,
                    domain: str | None) -> DataFrame:
    """Rows of ``found`` whose edge belongs to the domain.

    The edge's own domain decides when it has one. Otherwise the domains of its registered
    ends must be absent or exactly the requested one.
    """
    if not domain:
        return found
    ends = nodes.select("id", F.col("properties")["domain"].alias("d")).where("d IS NOT NULL")
    # only the edges that were found and their ends are looked up
    props = edges.join(found.select(*EDGE).distinct(), EDGE, "left_semi").select(
        *EDGE, F.col("properties")["domain"].alias("own"))
    source = ends.select(F.col("id").alias("source"), F.col("d").alias("sd"))
    target = ends.select(F.col("id").alias("target"), F.col("d").alias("td"))
    own = F.coalesce("own", F.lit(""))
    allowed = (
        props.join(source, "source", "left").join(target, "target", "left")
        .where(F.when(own != "", own == domain).otherwise(
            (F.col("sd").isNull() | (F.col("sd") == domain))
            & (F.col("td").isNull() | (F.col("td") == domain))))
        .select(*EDGE)
    )
    return found.join(allowed, EDGE, "left_semi")


def found_in_domain(found: DataFrame, nodes: DataFrame, domain: str) -> DataFrame:
    """``edges_in_domain`` for a stored ``found`` that has the domain of its edges as ``own``.

    The edges are not read again. Ends are looked up for edges without a domain only, among the
    nodes that rule an edge out.
    """
    own = F.coalesce("own", F.lit(""))
    other = nodes.select("id", F.col("properties")["domain"].alias("d")).where("d IS NOT NULL") \
        .groupBy("id").agg(F.max(F.col("d") == domain).alias("same")).where("NOT same")
    whole = found.where("relation IS NOT NULL AND target IS NOT NULL")      # no edge is looked up by a null
    by_ends = whole.where(own == "")
    for end in ("source", "target"):
        by_ends = by_ends.join(other.select(F.col("id").alias(end)), end, "left_anti")
    return whole.where((own != "") & (own == domain)).unionByName(by_ends).drop("own")


# --- question context -----------------------------------------------------------------

def seed_nodes(questions: DataFrame, hits: DataFrame, nodes: DataFrame, aliases,
               tool_map, source_map, domain: str | None = None) -> DataFrame:
    """``(query_id, seed)``: graph entry points of each question.

    Entities named in the question, the tool of a hit and the trusted source of a hit
    nominate nodes; only registered nodes of the domain remain. The text of hits is never
    scanned, so distractor passages cannot widen the context.
    """
    alias_rows = rule_rows(aliases, ("entity", "alias"))
    tools = rule_rows(tool_map, ("tool", "node"))
    sources = rule_rows(source_map, ("source_id", "node"))
    named = questions.select("query_id", F.explode(
        tx.matching_names(F.lower("question"), alias_rows)).alias("seed"))

    def targets(column: str, pairs):
        rules = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in pairs])
        return tx.bind(F.lower(tx.strip(F.col(column))), lambda key: F.transform(
            F.filter(rules, lambda r: r["k"] == key), lambda r: r["n"]))

    parts = [targets(c, pairs) for c, pairs in (("tool", tools), ("source_id", sources))
             if pairs and c in hits.columns]
    wanted = named
    if parts:
        # Few distinct targets per question: deduplicate before anything is joined.
        wanted = wanted.unionByName(
            hits.select("query_id", F.explode(F.concat(*parts)).alias("seed")))
    allowed = nodes_in_domain(nodes, domain).select(F.col("id").alias("seed"))
    return wanted.distinct().join(allowed, "seed", "left_semi").select("query_id", "seed")


def seed_sets(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query_id, seeds, seed_set)`` and the distinct sets as seeds of their own, ``query_id`` their name.

    The context of a question depends on its set of seeds only, so a set stands for all its questions.
    """
    members = cut_lineage(seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
                          .withColumn("seed_set", F.to_json("seeds")), "sets")
    sets = members.select("seed_set", "seeds").distinct()
    return members, sets.select(F.col("seed_set").alias("query_id"), F.explode("seeds").alias("seed"))


def shared_context(seeds: DataFrame, nodes: DataFrame, edges: DataFrame,
                   domain: str | None = None, max_depth: int = 3) -> DataFrame:
    """``graph_context`` for questions that share their seeds: made once for each set of seeds.

    Questions with the same set are spread over ``_SPREAD`` keys, as one set can be most of them.
    """
    members, sets = seed_sets(seeds)
    found = cut_lineage(graph_context(sets, nodes, edges, domain, max_depth), "context")
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = members.select("query_id", "seed_set", F.pmod(F.xxhash64("query_id"), F.lit(_SPREAD)).alias("spread"))
    lines = found.select(F.col("query_id").alias("seed_set"), *EDGE, "depth",
                         F.explode(F.sequence(F.lit(0).cast("long"), F.lit(_SPREAD - 1).cast("long"))).alias("spread"))
    return asked.repartition(parts, "seed_set", "spread").join(lines, ["seed_set", "spread"]) \
        .select("query_id", *EDGE, "depth")


def terminal_edges(seeds: DataFrame, nodes: DataFrame, edges: DataFrame,
                   max_depth: int = 3, steps: DataFrame | None = None) -> DataFrame:
    """Context of seeds without outgoing edges: step back to the parents, then outward.

    Parents are taken in insertion order of their edges. An edge counts at its first
    appearance: as the edge of parent j, or on the way out from an earlier parent.
    """
    seeds = seeds.select("seed").distinct()
    into = cut_lineage(seeds.join(edges, F.col("seed") == F.col("target")).select(
        "seed", *EDGE, "seq"), "into")
    found = into.select("seed", *EDGE, "seq", F.lit(0).alias("kind"), F.lit(1).alias("depth"))
    if max_depth > 1:
        out = traverse(into.select(F.col("source").alias("seed")), nodes, edges, max_depth - 1, steps=steps)
        parents = into.select("seed", F.col("source").alias("parent"), "seq")
        onward = out.withColumnRenamed("seed", "parent").join(parents, "parent").select(
            "seed", *EDGE, "seq", F.lit(1).alias("kind"), (F.col("depth") + 1).alias("depth"))
        found = found.unionByName(onward)
    return found.groupBy("seed", *EDGE).agg(
        F.min_by("depth", F.col("seq") * 2 + F.col("kind")).alias("depth"))


def graph_context(seeds: DataFrame, nodes: DataFrame, edges: DataFrame,
                  domain: str | None = None, max_depth: int = 3) -> DataFrame:
    """``(query_id, source, relation, target, depth)`` for ``seeds(query_id, seed)``.

    Each distinct seed is expanded once, however many questions share it. Among the seeds of
    a question the alphabetically first one that reaches an edge fixes its depth.
    """
    if max_depth <= 0:
        raise ValueError("max_depth must be greater than zero")
    pairs = seeds.select("query_id", "seed").distinct()
    starts = cut_lineage(pairs.select("seed").distinct())
    nodes = cut_lineage(nodes.select("id", "properties"), "nodes")
    if domain:      # a walk brings the domain of each edge along, so that the edges are not searched again
        steps = adjacency(edges.withColumn("own", F.col("properties")["domain"]), more=("own",))
    else:
        steps = adjacency(edges)
    outward = traverse(starts, nodes, edges, max_depth, steps=steps)
    # the first step of a walk tells which seeds have a way out; a seed that is no node has none either
    way_out = outward.where("depth = 1").select("seed").distinct()
    dead_ends = starts.join(way_out, "seed", "left_anti")
    back = terminal_edges(dead_ends, nodes, edges, max_depth, steps)
    if domain:
        outward = found_in_domain(cut_lineage(outward, "outward"), nodes, domain)
        back = edges_in_domain(back, edges, nodes, domain)
    found = outward.unionByName(back)
    # A question has few seeds; their order as a number keeps the large aggregation hashed.
    order = Window.partitionBy("query_id").orderBy("seed")
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    return ranked.join(found, "seed").groupBy("query_id", *EDGE).agg(
        F.min_by("depth", "rank").alias("depth"))
