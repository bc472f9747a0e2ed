"""Vector retrieval, reranking, source lists and context text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import vectors as vx
from ...operators import cells, evaluate, knn, rerank
from ...operators.chunking import paged_chunks
from ...operators.embed import answer, embed
from ...session import read_table
from .. import evidence
from . import query
from . import sqltext as s


# --- inputs ---------------------------------------------------------------------------

def vector_table(spark, root):
    """Embeddings with the metadata of their documents as typed columns."""
    v = read_table(spark, root, "embeddings").withColumnRenamed("vec_id", "id")
    d = read_table(spark, root, "documents")
    return v.join(d.select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"),
                           F.col("source").alias("source")), "id")


def payload(spark, root):
    """What is shown of a hit; one document is one page here."""
    return read_table(spark, root, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("tool"),
        F.col("source").alias("source_id"), (F.col("n_chars") % 3).alias("page"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("chunk_id"))


def user_questions(spark, root):
    """Every user turn; its vector is the one with the conversation's number."""
    c = read_table(spark, root, "conversations").where("role = 'user'").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("query_id"), F.col("text").alias("question"), "conv_id")
    e = read_table(spark, root, "embeddings").select(F.col("vec_id").alias("conv_id"), "embedding")
    return c.join(e, "conv_id").drop("conv_id")


def question_hits(spark, root, k=8, limit=1.4, **filters):
    return evidence.retrieve(
        user_questions(spark, root), vector_table(spark, root), payload(spark, root),
        k=k, max_distance=limit, **filters)


V = """v AS (SELECT e.vec_id AS id, e.embedding, e.label, d.lang AS domain, d.source
    FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"""
Q = """q AS (SELECT c.conv_id::VARCHAR || '-' || c.turn::VARCHAR AS query_id,
    c.text AS question, e.embedding
    FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE c.role = 'user')"""


def hits_sql(k=8, limit=1.4, where="TRUE"):
    return f"""{V}, {Q},
    near AS (SELECT q.query_id, v.id, v.domain, v.source,
        {s.l2('q.embedding', 'v.embedding')} AS distance
        FROM q, v WHERE {where}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
        FROM near),
    hits AS (SELECT r.query_id, r.id, r.distance, r.rank, d.text, d.lang AS tool,
        d.source AS source_id, d.n_chars % 3 AS page, 'doc-' || d.doc_id AS chunk_id
        FROM ranked r JOIN documents d ON d.doc_id = r.id
        WHERE r.rank <= {k} AND r.distance <= {limit})"""


# --- search -----------------------------------------------------------------------------

@query("evidence_search", "J1 W1 P1 P2 P3 T8-path", f"""
    WITH {hits_sql(5, 1.4, "v.domain = 'en'")}
    SELECT query_id, id, round(distance, 5) AS distance, rank::INTEGER AS rank, source_id
    FROM hits""")
def evidence_search(spark, root):
    """Flagship: user questions against the English part of the vector table."""
    return question_hits(spark, root, k=5, domain="en").select(
        "query_id", "id", F.round("distance", 5).alias("distance"), "rank", "source_id")


_KNN_ALL = f"""
    WITH near AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
        {s.l2('a.embedding', 'b.embedding')} AS distance FROM embeddings a, embeddings b),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
        FROM near)
    SELECT query_id, id, round(distance, 5) AS distance, rank::INTEGER AS rank
    FROM ranked WHERE rank <= 5"""


def _all_to_all(spark, root, **options):
    e = read_table(spark, root, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    v = e.select(F.col("vec_id").alias("id"), "embedding")
    return knn.knn(q, v, k=5, **options).select(
        "query_id", "id", F.round("distance", 5).alias("distance"), "rank")


@query("nearest_all", "J1 W1", _KNN_ALL)
def nearest_all(spark, root):
    return _all_to_all(spark, root)


@query("nearest_grid", "J1 W1", _KNN_ALL)
def nearest_grid(spark, root):
    """The same search in the blocks of queries that large batches are cut into."""
    return _all_to_all(spark, root, max_query_bytes=100_000)


TABLES, BITS, WIDTH = 20, 4, 64        # recall@5 of 0.94 or more on all given tables, see README
_PLANES = ", ".join(f"({n // BITS}, {n % BITS}, [{', '.join(repr(float(x)) for x in row)}])"
                    for n, row in enumerate(knn.hash_planes(TABLES, BITS, WIDTH)))
_HASHED = f"""
    planes(tbl, bit, p) AS (VALUES {_PLANES}),
    codes AS (SELECT vec_id, tbl, sum(CASE WHEN {s.dot('embedding', 'p')} >= 0 THEN 1 << bit ELSE 0 END) AS code
        FROM embeddings, planes GROUP BY 1, 2),
    pairs AS (SELECT DISTINCT a.vec_id AS query_id, b.vec_id AS id FROM codes a JOIN codes b USING (tbl, code)),
    near AS (SELECT query_id, id, {s.l2('a.embedding', 'b.embedding')} AS distance FROM pairs
        JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = id),
    hashed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near)"""


@query("nearest_hashed", "J1 (approximate)", f"""
    WITH {_HASHED} SELECT query_id, id, round(distance, 5) AS distance, rank::INTEGER AS rank
    FROM hashed WHERE rank <= 5""")
def nearest_hashed(spark, root):
    """The planes are constants of the operator, so SQL finds the same rows."""
    return _all_to_all(spark, root, approx=True, block_rows=2000, tables=TABLES, bits=BITS)


@query("nearest_hashed_recall", "J1 (approximate)", f"""
    WITH {_HASHED}, e AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
        {s.l2('a.embedding', 'b.embedding')} AS distance FROM embeddings a, embeddings b),
    exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM e)
    SELECT count(*) AS wanted, count(h.id) AS found FROM exact LEFT JOIN (SELECT * FROM hashed WHERE rank <= 5) h
    USING (query_id, id) WHERE exact.rank <= 5""")
def nearest_hashed_recall(spark, root):
    """How many of the exact five nearest the hashed search finds."""
    exact = nearest_all(spark, root).select("query_id", "id")
    found = nearest_hashed(spark, root).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found"))


def _cells_sql() -> str:
    """The rounds of the partition index, the cells of all vectors and the answers from probed cells."""
    near = f"arg_min(cell, {{d: {s.l2('embedding', 'c')}, n: cell}})"
    steps = [f"""sampled AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS n
        FROM embeddings WHERE embedding IS NOT NULL QUALIFY n < {cells.SAMPLE})""",
             f"c0 AS (SELECT n AS cell, list_transform(embedding, lambda x: x::DOUBLE) AS c FROM sampled WHERE n < {cells.CELLS})"]
    for r in range(cells.ROUNDS):
        steps += [f"a{r} AS (SELECT vec_id, {near} AS cell FROM sampled, c{r} GROUP BY vec_id)",
                  f"""m{r} AS (SELECT cell, list(x ORDER BY i) AS c FROM (
            SELECT cell, i, round(avg(embedding[i]::DOUBLE), 6) AS x FROM a{r} JOIN sampled USING (vec_id),
                   range(1, 65) AS t(i) GROUP BY cell, i) GROUP BY cell)""",
                  f"c{r + 1} AS (SELECT cell, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m USING (cell))"]
    return ", ".join([*steps, f"""
    centres AS MATERIALIZED (SELECT * FROM c{cells.ROUNDS}),
    stored AS (SELECT vec_id AS id, {near} AS cell FROM embeddings, centres GROUP BY vec_id),
    asked AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
    probed AS (SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY {s.l2('embedding', 'c')}, cell) AS p
        FROM asked, centres QUALIFY p <= {cells.PROBES}),
    near AS (SELECT query_id, id, {s.l2('a.embedding', 'e.embedding')} AS distance FROM probed JOIN stored USING (cell)
        JOIN asked a USING (query_id) JOIN embeddings e ON e.vec_id = id),
    found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM near)"""])


def _asked(spark, root):
    e = read_table(spark, root, "embeddings")
    return (e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"),
            e.select(F.col("vec_id").alias("id"), "embedding"))


@query("nearest_in_cells", "J1 (approximate) W1", f"""
    WITH {_cells_sql()} SELECT query_id, id, round(distance, 5) AS distance, rank::INTEGER AS rank
    FROM found WHERE rank <= 5""")
def nearest_in_cells(spark, root):
    """Every twentieth vector against a stored partition index of all of them."""
    asked, every = _asked(spark, root)
    return cells.search(asked, cells.build(every), every).select(
        "query_id", "id", F.round("distance", 5).alias("distance"), "rank")


@query("nearest_in_cells_recall", "J1 (approximate)", f"""
    WITH {_cells_sql()}, e AS (SELECT query_id, b.vec_id AS id, {s.l2('a.embedding', 'b.embedding')} AS distance
        FROM asked a, embeddings b),
    exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM e)
    SELECT count(*) AS wanted, count(f.id) AS found, count(f.id) >= 0.9 * count(*) AS enough
    FROM exact LEFT JOIN (SELECT * FROM found WHERE rank <= 5) f USING (query_id, id) WHERE exact.rank <= 5""")
def nearest_in_cells_recall(spark, root):
    """How many of the exact five nearest the partition index finds."""
    asked, every = _asked(spark, root)
    exact = knn.knn(asked, every, k=5).select("query_id", "id")
    found = nearest_in_cells(spark, root).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found"),
        (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


@query("nearest_cosine", "J1 J2 W1", f"""
    WITH near AS (SELECT a.vec_id AS query_id, b.vec_id AS id,
        1 - {s.dot('a.embedding', 'b.embedding')} /
        sqrt({s.dot('a.embedding', 'a.embedding')} * {s.dot('b.embedding', 'b.embedding')})
        AS distance FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
        FROM near)
    SELECT query_id, id, round(distance, 5) AS distance FROM ranked WHERE rank <= 3""")
def nearest_cosine(spark, root):
    """All vectors against all, by cosine distance, without the self match."""
    e = read_table(spark, root, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), "embedding")
    v = e.select(F.col("vec_id").alias("id"), "embedding")
    # The self match is one of the four nearest unless exact copies precede it.
    hits = knn.knn(q, v, k=4, metric="cosine").where("query_id <> id")
    order = F.struct(F.col("distance"), F.col("id"))
    top = hits.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(order)), 1, 3)
                                       .alias("h"))
    return top.select("query_id", F.explode("h").alias("h")).select(
        "query_id", "h.id", F.round("h.distance", 5).alias("distance"))


@query("vector_cosine", "J2", f"""
    SELECT a.vec_id AS id, round({s.dot('a.embedding', 'b.embedding')} /
        (sqrt({s.dot('a.embedding', 'a.embedding')}) *
         sqrt({s.dot('b.embedding', 'b.embedding')})), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_cosine(spark, root):
    e = read_table(spark, root, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("b"))
    return a.join(b, "id").select(
        "id", F.round(vx.cosine_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("filter_by_metadata", "P1 P3", f"""
    WITH {V} SELECT id, label, domain, source FROM v WHERE domain = 'en' AND source = 'src3'""")
def filter_by_metadata(spark, root):
    return knn.metadata_filter(vector_table(spark, root), domain=" en ", source="src3",
                               tool=None).select("id", "label", "domain", "source")


@query("threshold_after_top_k", "P2", f"""
    WITH {hits_sql(8, 1.35)} SELECT query_id, count(*) AS kept, round(max(distance), 5) AS far
    FROM hits GROUP BY query_id""")
def threshold_after_top_k(spark, root):
    return question_hits(spark, root, limit=1.35).groupBy("query_id").agg(
        F.count("*").alias("kept"), F.round(F.max("distance"), 5).alias("far"))


# --- after the search -----------------------------------------------------------------

_RERANK = f"""
    scored AS (SELECT h.*, list_sort(list_filter({s.tokens('q.question')}, lambda x:
            list_contains({s.tokens('h.text')}, x))) AS matched,
        {s.tokens('q.question')} AS qt
        FROM hits h JOIN q USING (query_id)),
    rescored AS (SELECT *, round(0.7 * (len(matched) / greatest(len(qt), 1))
        + 0.3 * greatest(0.0, 1.0 - distance), 6) AS rerank_score FROM scored),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY rerank_score DESC, rank) AS rerank FROM rescored)"""


@query("rerank_evidence", "H4 W2 W3", f"""
    WITH {hits_sql()}, {_RERANK}
    SELECT query_id, id, rerank_score, array_to_string(matched, ' ') AS matched,
        rerank::INTEGER AS rerank FROM best WHERE rerank <= 4""")
def rerank_evidence(spark, root):
    out = rerank.rerank(user_questions(spark, root), question_hits(spark, root))
    return out.select("query_id", "id", "rerank_score",
                      F.array_join("matched_query_tokens", " ").alias("matched"), "rerank")


@query("context_evidence_blocks", "A8 W2 W3", f"""
    WITH {hits_sql()}, {_RERANK},
    blocks AS (SELECT query_id, rerank, '[EVIDENCE ' || rerank || ']' || chr(10)
        || 'Source: ' || source_id || chr(10) || 'Page: ' || page || chr(10)
        || 'Rerank score: ' || rerank_score::VARCHAR || chr(10) || 'Matched query terms: ['
        || array_to_string(list_transform(matched, lambda t: '''' || t || ''''), ', ') || ']'
        || chr(10) || 'Text:' || chr(10) || {s.strip('text')} AS block
        FROM best WHERE rerank <= 4)
    SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rerank) AS context
    FROM blocks GROUP BY query_id""")
def context_evidence_blocks(spark, root):
    hits = question_hits(spark, root).withColumn("source", F.col("source_id"))
    return evidence.reranked_context(user_questions(spark, root), hits)


@query("context_plain", "A7", f"""
    WITH {hits_sql()}
    SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
    FROM hits GROUP BY query_id""")
def context_plain(spark, root):
    return rerank.assemble_context(question_hits(spark, root))


@query("context_labelled", "A6 A8", f"""
    WITH {hits_sql()}
    SELECT query_id, string_agg('Source: ' || source_id || chr(10) || 'Domain: ' || tool
        || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Content:' || chr(10) || text,
        chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
    FROM hits GROUP BY query_id""")
def context_labelled(spark, root):
    hits = question_hits(spark, root).withColumns(
        {"source": F.col("source_id"), "domain": F.col("tool")})
    return rerank.assemble_context(hits, style="labelled")


@query("sources_by_chunk", "A4", f"""
    WITH {hits_sql()}, first AS (SELECT *, row_number() OVER (
        PARTITION BY query_id, source_id, page, tool ORDER BY rank) AS n FROM hits)
    SELECT query_id, source_id, page, tool, round(distance, 5) AS distance,
        row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS position
    FROM first WHERE n = 1""")
def sources_by_chunk(spark, root):
    return rerank.source_list(
        question_hits(spark, root), ["source_id", "page", "tool"],
        ["source_id", "page", "tool", "distance"]).withColumn("distance", F.round("distance", 5))


@query("sources_by_page", "A5", f"""
    WITH {hits_sql()}, {_RERANK}, first AS (SELECT *, row_number() OVER (
        PARTITION BY query_id, source_id, page ORDER BY rerank) AS n FROM best
        WHERE rerank <= 4)
    SELECT query_id, source_id, page, round(distance, 5) AS distance, rerank_score,
        row_number() OVER (PARTITION BY query_id ORDER BY rerank)::INTEGER AS position
    FROM first WHERE n = 1""")
def sources_by_page(spark, root):
    best = rerank.rerank(user_questions(spark, root), question_hits(spark, root))
    return rerank.source_list(
        best, ["source_id", "page"], ["source_id", "page", "distance", "rerank_score"],
        "rerank").withColumn("distance", F.round("distance", 5))


@query("sources_plain", "A6", f"""
    WITH {hits_sql()} SELECT query_id, source_id, tool AS domain, chunk_id,
        round(distance, 5) AS distance FROM hits""")
def sources_plain(spark, root):
    return question_hits(spark, root).select(
        "query_id", "source_id", F.col("tool").alias("domain"), "chunk_id",
        F.round("distance", 5).alias("distance"))


@query("evidence_audit", "P15", f"""
    WITH {hits_sql()} SELECT query_id, rank::INTEGER AS rank, id::VARCHAR AS chunk_id,
        round(distance, 5) AS distance, source_id, md5(text) AS text_md5 FROM hits""")
def evidence_audit(spark, root):
    return evaluate.evidence_audit(question_hits(spark, root)).select(
        "query_id", "rank", "chunk_id", F.round("distance", 5).alias("distance"), "source_id",
        F.md5("text").alias("text_md5"))


@query("source_recall", "J15", f"""
    WITH {hits_sql()},
    gold AS (SELECT c.conv_id::VARCHAR || '-' || c.turn::VARCHAR AS query_id,
        d.source AS source_id FROM conversations c
        JOIN documents d ON d.doc_id BETWEEN c.conv_id AND c.conv_id + 2 WHERE c.role = 'user'),
    g AS (SELECT DISTINCT query_id, source_id FROM gold),
    h AS (SELECT DISTINCT query_id, source_id FROM hits)
    SELECT g.query_id, count(h.source_id) AS found, count(*) AS gold,
        round(count(h.source_id) / count(*), 6) AS recall
    FROM g LEFT JOIN h USING (query_id, source_id) GROUP BY g.query_id""")
def source_recall(spark, root):
    c = read_table(spark, root, "conversations").where("role = 'user'")
    wanted = c.select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("query_id"),
        F.explode(F.sequence("conv_id", F.col("conv_id") + 2)).alias("doc_id"))
    gold = wanted.join(read_table(spark, root, "documents").select(
        "doc_id", F.col("source").alias("source_id")), "doc_id").drop("doc_id")
    return evaluate.source_recall(question_hits(spark, root), gold).withColumn(
        "recall", F.round("recall", 6))


# --- the model hook ------------------------------------------------------------------------

def document_chunks(spark, root):
    docs = read_table(spark, root, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.col("lang").alias("domain"), F.lit(1).alias("page"), "text")
    return paged_chunks(docs)


_BODY = f"""body AS (SELECT doc_id, {s.strip('text')} AS text FROM documents),
    spans AS (SELECT *, unnest(range(0, greatest(0, ceil((length(text) - 1200) / 1000.0))::BIGINT
        + 1)) AS number FROM body),
    chunks AS (SELECT doc_id, number,
        {s.strip('substring(text, number * 1000 + 1, 1200)')} AS chunk_text FROM spans)"""


def _vectors_sql(name, rows, key, text):
    """Scaled word counts in 256 buckets, one row per bucket that is not empty."""
    digit = lambda n: f"(strpos('0123456789abcdef', substr(md5(token), {n}, 1)) - 1)"
    return f"""{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS token
            FROM {rows}),
        {name}_n AS (SELECT {key}, {digit(7)} * 16 + {digit(8)} AS bucket, count(*) AS n FROM {name}_t GROUP BY 1, 2),
        {name} AS (SELECT {key}, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w FROM {name}_n)"""


_CHUNKS = f"""{_BODY}, pieces AS (SELECT 'doc' || doc_id || '.txt::p1::c' || row_number() OVER (
        PARTITION BY doc_id ORDER BY number) AS chunk_id, chunk_text FROM chunks WHERE chunk_text <> '')"""


@query("embed_chunks", "T14", f"""
    WITH {_CHUNKS}, {_vectors_sql('v', 'pieces', 'chunk_id', 'chunk_text')}
    SELECT p.chunk_id, length(p.chunk_text) AS character_count, 256 AS dim, count(v.bucket) AS filled,
        coalesce(round(sum(w), 3), 0) AS total, coalesce(round(sum(w * bucket), 2), 0) AS moment
    FROM pieces p LEFT JOIN v USING (chunk_id) GROUP BY ALL""")
def embed_chunks(spark, root):
    """Hashed embeddings of all document chunks; sums over their entries stand for them."""
    out = embed(document_chunks(spark, root), "chunk_text").withColumn(
        "e", F.transform("embedding", lambda x: x.cast("double")))
    add = lambda a, x: a + x
    return out.select(
        "chunk_id", "character_count", F.size("e").alias("dim"),
        F.size(F.filter("e", lambda x: x > 0)).cast("long").alias("filled"),
        F.round(F.aggregate("e", F.lit(0.0), add), 3).alias("total"),
        F.round(F.aggregate(F.transform("e", lambda x, i: x * i), F.lit(0.0), add), 2).alias("moment"))


@query("embed_with_own_model", "U1", """
    SELECT doc_id, length(text)::DOUBLE AS letters, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS blanks
    FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10)) <> ''""")
def embed_with_own_model(spark, root):
    """A model of the caller's, here of two numbers."""
    docs = read_table(spark, root, "documents").select("doc_id", "text")
    out = embed(docs, model=lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    return out.select("doc_id", F.col("embedding")[0].cast("double").alias("letters"),
                      F.col("embedding")[1].cast("double").alias("blanks"))


_EMBEDDED_HITS = f"""{_CHUNKS}, q AS (SELECT c.conv_id::VARCHAR || '-' || c.turn::VARCHAR AS query_id, c.text AS question
        FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id WHERE c.role = 'user'),
    {_vectors_sql('v', 'pieces', 'chunk_id', 'chunk_text')}, {_vectors_sql('u', 'q', 'query_id', 'question')},
    dots AS (SELECT query_id, chunk_id, sum(u.w * v.w) AS dot FROM u JOIN v USING (bucket) GROUP BY 1, 2),
    near AS (SELECT q.query_id, p.chunk_id AS id, p.chunk_text AS text,
        (q.question SIMILAR TO '(?s).*[\\p{{L}}\\p{{N}}_].*')::INT + (p.chunk_text SIMILAR TO '(?s).*[\\p{{L}}\\p{{N}}_].*')::INT
        - 2 * coalesce(dot, 0) AS distance
        FROM q CROSS JOIN pieces p LEFT JOIN dots d ON d.query_id = q.query_id AND d.chunk_id = p.chunk_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), id) AS rank FROM near),
    hits AS (SELECT * FROM ranked WHERE rank <= 8 AND distance <= 0.85)"""


@query("search_embedded_chunks", "T14 J1 W1 P2 W2", f"""
    WITH {_EMBEDDED_HITS}, {_RERANK}
    SELECT query_id, id, round(distance, 4) AS distance, round(rerank_score, 4) AS rerank_score
    FROM best WHERE rerank <= 4""")
def search_embedded_chunks(spark, root):
    """Questions and chunks embedded by the same model, searched and reranked."""
    chunks = document_chunks(spark, root)
    asked = embed(user_questions(spark, root).drop("embedding"), "question")
    vectors = embed(chunks, "chunk_text").select(F.col("chunk_id").alias("id"), "embedding")
    hits = evidence.retrieve(
        asked, vectors, chunks.select(F.col("chunk_id").alias("id"),
                                      F.col("chunk_text").alias("text"), "source"), k=8)
    return rerank.rerank(asked, hits).select(
        "query_id", "id", F.round("distance", 4).alias("distance"),
        F.round("rerank_score", 4).alias("rerank_score"))


@query("answered_questions", "U2 A7 A9", f"""
    WITH {hits_sql()}, context AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
        FROM hits GROUP BY query_id),
    answers AS (SELECT query_id, {s.norm("substring(context, 1, 400)")} AS answer FROM context),
    marks AS (SELECT query_id, contains(answer, 'the') OR contains(answer, 'der') AS a,
        contains(answer, 'thon') AS b FROM answers)
    SELECT query_id, (a AND b)::INT::BIGINT AS claims, round((a::INT + b::INT) / 2, 6) AS claim_group_coverage FROM marks""")
def answered_questions(spark, root):
    """Retrieve, assemble, answer with a fixed function, score: one plan."""
    asked = user_questions(spark, root).select("query_id", "question")
    context = rerank.assemble_context(question_hits(spark, root)).join(asked, "query_id")
    answers = answer(context, lambda question, text: text[:400])
    claims = asked.select("query_id", F.from_json(F.lit(
        '[{"claim_id": "c", "term_groups": [["the", "der"], ["thon"]]}]'),
        "array<struct<claim_id:string,term_groups:array<array<string>>>>").alias("claims"))
    return evaluate.score_answers(answers, claims, "query_id").select(
        "query_id", F.size("claims_passed").cast("long").alias("claims"),
        F.round("claim_group_coverage", 6).alias("claim_group_coverage"))
