"""Corpus reading, chunking, identity, ingestion and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...functions import text as tx
from ...operators import chunking, ingest, rules
from ...session import cut_lineage, read_table, scratch_path
from ...sources import corpus, pages, stored, tables
from .. import ingestion
from . import query
from . import sqltext as s

ROOT = "/corpus"


def corpus_files(spark, root):
    """The documents as files of a directory tree, some with other suffixes, some blank."""
    d = read_table(spark, root, "documents")
    blank = read_table(spark, root, "labels").where("toxic = 1").select("doc_id")
    kinds = F.array(*[F.lit(k) for k in ("md", "txt", "MD", "html")])
    path = F.concat(F.lit(ROOT + "/"), "lang", F.lit("/"), "source", F.lit("/doc"),
                    F.col("doc_id").cast("string"), F.lit("."),
                    F.element_at(kinds, (F.col("n_chars") % 4 + 1).cast("int")))
    return d.join(blank.withColumn("blank", F.lit(True)), "doc_id", "left").select(
        path.alias("path"),
        F.when(F.col("blank"), F.lit(" \t\n")).otherwise(F.col("text")).cast("binary")
        .alias("content"))


FILES = f"""files AS (SELECT '{ROOT}/' || d.lang || '/' || d.source || '/doc' || d.doc_id || '.'
        || (['md', 'txt', 'MD', 'html'])[d.n_chars % 4 + 1] AS path,
        'doc' || d.doc_id || '.' || (['md', 'txt', 'MD', 'html'])[d.n_chars % 4 + 1] AS source,
        d.lang AS domain, '.' || (['md', 'txt', 'md', 'html'])[d.n_chars % 4 + 1] AS extension,
        CASE WHEN l.toxic = 1 THEN ' ' || chr(9) || chr(10) ELSE d.text END AS content
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
    listing AS (SELECT * FROM files WHERE extension IN ('.md', '.txt'))"""


@query("corpus_listing", "S1 S2 H5 H10", f"""
    WITH {FILES} SELECT path, source, domain, extension, sha256(content) AS document_sha256,
        strlen(content) AS length, domain IN ('en', 'fr', 'de') AS known_domain FROM listing""")
def corpus_listing(spark, root):
    return corpus.corpus_listing(corpus_files(spark, root), ROOT,
                                 domains=("en", "fr", "de")).drop("content")


@query("load_pages", "S4 M1", f"""
    WITH {FILES} SELECT path, 1 AS page, length({s.strip('content')}) AS character_count,
        md5({s.strip('content')}) AS text_md5 FROM listing""")
def load_pages(spark, root):
    listing = corpus.corpus_listing(corpus_files(spark, root), ROOT)
    return corpus.load_pages(listing).select(
        "path", "page", "character_count", F.md5("text").alias("text_md5"))


@query("load_documents", "S3 P7", f"""
    WITH {FILES} SELECT path, CASE WHEN {s.strip('content')} = '' THEN 'document is empty'
        ELSE 'loaded' END AS outcome FROM listing""")
def load_documents(spark, root):
    good, bad = corpus.load_documents(corpus.corpus_listing(corpus_files(spark, root), ROOT))
    return good.select("path", F.lit("loaded").alias("outcome")).unionAll(
        bad.select("path", F.col("reject_reason").alias("outcome")))


HTML = f"""body AS (SELECT page_id, regexp_replace(html, '(?is)<script[\\s/>].*?</script\\s*>|'
        || '<style[\\s/>].*?</style\\s*>', '', 'g') AS html FROM pages),
    nodes AS (SELECT page_id, list_filter(list_transform(
        string_split_regex(html, '(?s)<!--.*?-->|<[!?/a-zA-Z][^>]*>'),
        lambda t: {s.strip("regexp_replace(regexp_replace(regexp_replace(regexp_replace("
                           "regexp_replace(t, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'),"
                           " '&quot;?', chr(34), 'g'), '&amp;?', '&', 'g'),"
                           " '[\\s\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}"
                           "\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')")}),
        lambda t: t <> '') AS parts FROM body),
    texts AS (SELECT page_id, array_to_string(parts, chr(10)) AS text FROM nodes)"""


@query("html_text", "S5 H1 H5", f"""
    WITH {HTML} SELECT page_id, length(text) AS characters, sha256(text) AS sha256,
        length(text) >= 500 AS sufficient FROM texts""")
def html_text(spark, root):
    return pages.html_to_text(read_table(spark, root, "pages")).select(
        "page_id", "characters", "sha256", "sufficient")


# --- chunking -------------------------------------------------------------------------------

def _windows(size, overlap, text="text", table="documents"):
    step = size - overlap
    return f"""spans AS (SELECT *, unnest(range(0,
            greatest(0, ceil((length({text}) - {size}) / {step}.0))::BIGINT + 1)) AS number
        FROM {table}),
    cut AS (SELECT *, {s.strip(f'substring({text}, number * {step} + 1, {size})')} AS chunk_text
        FROM spans)"""


def _documents(spark, root):
    return read_table(spark, root, "documents").select(
        F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".v1.txt"))
        .alias("source"), F.col("lang").alias("domain"), "text")


@query("chunk_simple", "T1 P6 M3 H2", f"""
    WITH {_windows(500, 50)}
    SELECT source || '_doc' || doc_id || '.v1_chunk_' || CASE WHEN number < 1000
        THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END AS chunk_id,
        lang AS domain, (row_number() OVER (PARTITION BY doc_id ORDER BY number) - 1)::INTEGER
        AS metadata_number, length(chunk_text) AS chunk_size, md5(chunk_text) AS text_md5
    FROM cut WHERE chunk_text <> ''""")
def chunk_simple(spark, root):
    return chunking.simple_chunks(_documents(spark, root)).select(
        "chunk_id", "domain", "metadata_number", "chunk_size", F.md5("chunk_text").alias("text_md5"))


def _named(spark, root):
    return read_table(spark, root, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        F.col("lang").alias("domain"), F.lit(1).alias("page"), "text",
        tx.sha256(F.col("text")).alias("document_sha256"))


def _content_chunks(spark, root):
    return chunking.content_chunks(_named(spark, root))


NAMED = f"""named AS (SELECT 'doc' || doc_id || '.txt' AS source, lang AS domain,
        {s.strip('text')} AS text, sha256(text) AS document_sha256, doc_id FROM documents)"""
CHUNKS = f"""{NAMED}, {_windows(1200, 200, table='named')},
    chunks AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY number)::INTEGER
        AS chunk_index FROM cut WHERE chunk_text <> ''),
    expected AS (SELECT *, 'sha256:' || document_sha256 || '::' || source || '::p1::c'
        || chunk_index AS chunk_id FROM chunks)"""


@query("chunk_paged", "T2 M4", f"""
    WITH {CHUNKS} SELECT source || '::p1::c' || chunk_index AS chunk_id, domain, 1 AS page,
        chunk_index, length(chunk_text) AS character_count, md5(chunk_text) AS text_md5
    FROM chunks""")
def chunk_paged(spark, root):
    return chunking.paged_chunks(_named(spark, root)).select(
        "chunk_id", "domain", "page", "chunk_index", "character_count",
        F.md5("chunk_text").alias("text_md5"))


@query("chunk_html_pages", "T3 S5", f"""
    WITH {HTML}, ready AS (SELECT t.page_id, p.url, t.text FROM texts t JOIN pages p USING (page_id)
        WHERE length(t.text) >= 500),
    {_windows(1200, 150, table='ready')}
    SELECT 'page' || page_id || '_chunk_' || lpad(number::VARCHAR, 3, '0') AS chunk_id, url,
        (row_number() OVER (PARTITION BY page_id ORDER BY number) - 1)::INTEGER
        AS metadata_number, length(chunk_text) AS chunk_size, md5(chunk_text) AS text_md5
    FROM cut WHERE chunk_text <> ''""")
def chunk_html_pages(spark, root):
    """Readable page text cut the way the benchmark does, with the page's own fields kept."""
    ready = pages.html_to_text(read_table(spark, root, "pages")).where("sufficient").select(
        F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("source"),
        F.lit("web").alias("domain"), "url", "sha256", "text")
    return chunking.simple_chunks(ready, 1200, 150).select(
        "chunk_id", "url", "metadata_number", "chunk_size", F.md5("chunk_text").alias("text_md5"))


@query("page_rejects", "S5 P7", f"""
    WITH {HTML} SELECT page_id, length(text) AS characters, 'page has too little text' AS reject_reason
    FROM texts WHERE length(text) < 500""")
def page_rejects(spark, root):
    """The pages that ``chunk_html_pages`` leaves out."""
    return pages.html_to_text(read_table(spark, root, "pages")).where("NOT sufficient").select(
        "page_id", F.char_length("text").alias("characters"), F.lit("page has too little text").alias("reject_reason"))


@query("chunk_benchmark_window", "T3", f"""
    WITH {_windows(1200, 150)}
    SELECT doc_id, number::INTEGER AS chunk_number, length(chunk_text) AS chunk_size
    FROM cut WHERE chunk_text <> ''""")
def chunk_benchmark_window(spark, root):
    d = read_table(spark, root, "documents").select("doc_id", "text")
    return chunking.chunk(d, 1200, 150).select(
        "doc_id", "chunk_number", F.char_length("chunk_text").alias("chunk_size"))


@query("chunk_in_sql", "U4", f"""
    WITH {_windows(300, 30)} SELECT doc_id, number::INTEGER AS chunk_number,
        md5(chunk_text) AS text_md5 FROM cut WHERE chunk_text <> ''""")
def chunk_in_sql(spark, root):
    chunking.register_chunk_function(spark)
    return spark.sql(
        "SELECT d.doc_id, c.chunk_number, md5(c.chunk_text) AS text_md5 "
        "FROM {docs} d, LATERAL chunk_text(d.text, 300, 30) c",
        docs=read_table(spark, root, "documents"))


@query("content_identity", "T4 H5", f"""
    WITH {CHUNKS} SELECT chunk_id, document_sha256, character_count FROM (
        SELECT chunk_id, document_sha256, length(chunk_text) AS character_count FROM expected)""")
def content_identity(spark, root):
    return _content_chunks(spark, root).select("chunk_id", "document_sha256", "character_count")


@query("repeated_content", "T4", f"""
    WITH c AS (SELECT sha256(text) AS document_sha256 FROM documents)
    SELECT document_sha256, count(*) AS copies FROM c GROUP BY 1 HAVING count(*) > 1""")
def repeated_content(spark, root):
    hashes = read_table(spark, root, "documents").select(
        tx.sha256(F.col("text")).alias("document_sha256"))
    return chunking.duplicate_ids(hashes, "document_sha256")


# --- incremental ingestion ---------------------------------------------------------------------

def _stored(spark, root):
    """Good documents are stored completely, poor ones only with their first chunk."""
    quality = read_table(spark, root, "labels").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source"),
        "quality")
    return _content_chunks(spark, root).join(quality, "source").where(
        "quality = 1 OR chunk_index = 1")


STORED = f"""{CHUNKS}, stored AS (SELECT e.* FROM expected e JOIN labels l USING (doc_id)
    WHERE l.quality = 1 OR e.chunk_index = 1)"""


@query("missing_chunks", "J6 O4", f"""
    WITH {STORED} SELECT chunk_id FROM expected EXCEPT ALL SELECT chunk_id FROM stored""")
def missing_chunks(spark, root):
    return ingest.missing_chunks(_content_chunks(spark, root), _stored(spark, root)).select(
        "chunk_id")


@query("layout_conflicts", "J7 O4", f"""
    WITH {STORED}, older AS (SELECT document_sha256, unnest(range(1,
            greatest(0, ceil((length(text) - 700) / 600.0))::BIGINT + 2)) AS i, source FROM named)
    SELECT document_sha256, 'sha256:' || document_sha256 || '::' || source || '::p1::c' || i
        AS chunk_id FROM older
    WHERE chunk_id NOT IN (SELECT chunk_id FROM expected)""")
def layout_conflicts(spark, root):
    """Chunks left by an older, finer layout of the same documents."""
    older = chunking.content_chunks(_named(spark, root), 700, 100)
    return ingest.layout_conflicts(_content_chunks(spark, root), older).select(
        "document_sha256", "chunk_id")


@query("verify_stored_ids", "J8 O4", f"""
    WITH {STORED}, ids AS (SELECT document_sha256, chunk_id, 1 AS e, 0 AS x FROM expected
        UNION ALL SELECT document_sha256, chunk_id, 0, 1 FROM stored),
    flags AS (SELECT document_sha256, chunk_id, max(e) AS e, max(x) AS x FROM ids GROUP BY 1, 2)
    SELECT document_sha256, sum(e)::BIGINT AS expected, sum(x)::BIGINT AS stored,
        count(*) FILTER (WHERE e <> x) AS unmatched, bool_and(e = x) AS verified
    FROM flags GROUP BY 1""")
def verify_stored_ids(spark, root):
    return ingest.verify_ids(_content_chunks(spark, root), _stored(spark, root))


@query("ingest_outcome", "A16", f"""
    WITH {STORED}, ids AS (SELECT document_sha256, chunk_id, 1 AS e, 0 AS x FROM expected
        UNION ALL SELECT document_sha256, chunk_id, 0, 1 FROM stored),
    flags AS (SELECT document_sha256, chunk_id, max(e) AS e, max(x) AS x FROM ids GROUP BY 1, 2),
    t AS (SELECT document_sha256, sum(e)::BIGINT AS chunks_total,
        sum(x)::BIGINT AS chunks_preexisting, count(*) FILTER (WHERE x = 0) AS chunks_indexed
        FROM flags GROUP BY 1)
    SELECT *, CASE WHEN chunks_indexed = 0 THEN 'duplicate' WHEN chunks_preexisting > 0
        THEN 'resumed' ELSE 'created' END AS status,
        ceil(chunks_indexed / 32.0)::BIGINT AS batches FROM t""")
def ingest_outcome(spark, root):
    return ingest.ingest_outcome(_content_chunks(spark, root), _stored(spark, root))


@query("ingest_totals", "A1 S2", f"""
    WITH {_windows(500, 50)}, per AS (SELECT lang AS domain, source, count(*) AS chunks
        FROM cut WHERE chunk_text <> '' GROUP BY 1, 2)
    SELECT domain, source, count(*) AS files, sum(chunks)::BIGINT AS chunks,
        grouping(domain, source)::BIGINT AS level FROM per GROUP BY ROLLUP (domain, source)""")
def ingest_totals(spark, root):
    d = read_table(spark, root, "documents").select("source", F.col("lang").alias("domain"), "text")
    return ingest.ingest_totals(chunking.chunk(d)).withColumn("level", F.col("level").cast("long"))


@query("indexing_rate", "A23", f"""
    WITH {_windows(500, 50)}, log AS (SELECT source, count(*) AS chunks,
        round(sum(length(chunk_text)) / 5000.0, 3) AS seconds FROM cut WHERE chunk_text <> ''
        GROUP BY 1)
    SELECT source, chunks, ceil(chunks / 16.0)::BIGINT AS batches,
        round(chunks / seconds, 3) AS chunks_per_second FROM log""")
def indexing_rate(spark, root):
    """Batches and rate of a run log with one line per source."""
    d = read_table(spark, root, "documents").select("source", "text")
    log = chunking.chunk(d).groupBy("source").agg(
        F.count("*").alias("chunks"),
        F.round(F.sum(F.char_length("chunk_text")) / 5000.0, 3).alias("seconds"))
    return ingest.indexing_rate(log).drop("seconds")


# --- metadata ------------------------------------------------------------------------------------

def _raw_metadata(spark, root):
    """Document metadata as a user might supply it: padded, mixed case, sometimes missing."""
    d = read_table(spark, root, "documents")
    kind = F.col("n_chars") % 5
    return d.select(
        "doc_id", "text", F.concat(F.lit(" "), "source", F.lit("\t")).alias("source"),
        F.when(kind == 0, F.lit("  ")).otherwise(F.col("lang")).alias("domain"),
        F.when(kind == 1, F.lit(None)).otherwise(F.lit("sub ")).cast("string").alias("subdomain"),
        F.when(kind < 3, F.concat(F.lit(" "), "lang")).alias("tool"),
        F.when(kind == 4, F.lit("v2")).otherwise(F.lit(" ")).alias("version"),
        F.when(kind == 2, F.lit("Secret")).when(kind == 3, F.lit(" PUBLIC "))
        .otherwise(F.lit("private")).alias("visibility"),
        F.when(F.col("n_chars") % 7 == 0, F.lit("")).otherwise(F.lit("manual"))
        .alias("document_type"))


RAW = """raw AS (SELECT doc_id, text, ' ' || source || chr(9) AS source,
        CASE WHEN n_chars % 5 = 0 THEN '  ' ELSE lang END AS domain,
        CASE WHEN n_chars % 5 = 1 THEN NULL ELSE 'sub ' END AS subdomain,
        CASE WHEN n_chars % 5 < 3 THEN ' ' || lang END AS tool,
        CASE WHEN n_chars % 5 = 4 THEN 'v2' ELSE ' ' END AS version,
        CASE n_chars % 5 WHEN 2 THEN 'Secret' WHEN 3 THEN ' PUBLIC ' ELSE 'private' END
            AS visibility,
        CASE WHEN n_chars % 7 = 0 THEN '' ELSE 'manual' END AS document_type FROM documents)"""


@query("rejected_inputs", "P7", f"""
    WITH {RAW} SELECT doc_id, CASE
        WHEN {s.strip('text')} = '' THEN 'text is blank'
        WHEN {s.strip('domain')} = '' THEN 'domain is blank'
        WHEN {s.strip('source')} = '' THEN 'source is blank'
        WHEN coalesce({s.strip('subdomain')}, '') = '' THEN 'subdomain is blank'
        WHEN lower({s.strip('visibility')}) NOT IN ('private', 'public')
            THEN 'visibility is not private or public'
        WHEN document_type = '' THEN 'document_type is blank' END AS reject_reason FROM raw""")
def rejected_inputs(spark, root):
    return ingest.with_reject_reason(_raw_metadata(spark, root)).select("doc_id", "reject_reason")


@query("chunk_metadata", "P4 P5 M5", f"""
    WITH {RAW}, ready AS (SELECT *, {s.strip('text')} AS body, sha256(text) AS document_sha256
        FROM raw),
    {_windows(1200, 200, 'body', 'ready')},
    chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY number)::INTEGER
        AS chunk_index FROM cut WHERE chunk_text <> '')
    SELECT doc_id, chunk_index, 1 AS page, {s.strip('source')} AS source,
        {s.strip('domain')} AS domain, coalesce({s.strip('subdomain')}, '') AS subdomain,
        coalesce({s.strip('tool')}, '') AS tool, {s.strip('version')} AS version,
        lower({s.strip('visibility')}) AS visibility, document_type, document_sha256,
        length(chunk_text) AS character_count, 1200 AS chunk_size_setting,
        200 AS chunk_overlap_setting FROM chunks""")
def chunk_metadata(spark, root):
    docs = _raw_metadata(spark, root).withColumns(
        {"page": F.lit(1), "document_sha256": tx.sha256(F.col("text")),
         "chunk_id": F.col("doc_id").cast("string")})
    chunks = chunking.chunk(docs, 1200, 200, "dense").withColumnRenamed(
        "chunk_number", "chunk_index").withColumn("character_count", F.lit(None).cast("int"))
    return ingest.ingest_metadata(chunks).withColumn(
        "doc_id", F.col("chunk_id").cast("long")).drop("chunk_id", "chunk_text")


@query("plain_metadata", "P4", """
    SELECT doc_id, coalesce(source, '') AS source, '' AS domain, coalesce(n_chars, 0)::INTEGER
        AS character_count, 0 AS page FROM documents""")
def plain_metadata(spark, root):
    d = read_table(spark, root, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), "source",
        F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("page"),
        F.lit(None).cast("string").alias("chunk_index"),
        F.col("n_chars").alias("character_count"))
    return ingest.index_metadata(d).select(
        F.col("chunk_id").alias("doc_id"), "source", "domain", "character_count", "page")


@query("metadata_profile", "A22", f"""
    WITH {RAW} SELECT 'domain' AS field, domain AS value, count(*) AS "rows" FROM raw GROUP BY 2
    UNION ALL SELECT 'tool', tool, count(*) FROM raw GROUP BY 2
    UNION ALL SELECT 'visibility', visibility, count(*) FROM raw GROUP BY 2""")
def metadata_profile(spark, root):
    return ingest.metadata_profile(_raw_metadata(spark, root), "domain", "tool", "visibility")


UPDATES = [("src1", 50, "chemistry", "v2"), ("src2", 49, "physics", "v1"),
           ("src5", 50, "chemistry", None)]


def _legacy(spark, root):
    return read_table(spark, root, "documents").select(
        "doc_id", "source", F.when(F.col("lang") == "en", F.lit("chemistry"))
        .alias("subdomain"), F.when(F.col("lang") != "fr", F.lit("v2")).alias("version"))


LEGACY = """legacy AS (SELECT doc_id, source,
    CASE WHEN lang = 'en' THEN 'chemistry' END AS subdomain,
    CASE WHEN lang <> 'fr' THEN 'v2' END AS version FROM documents)"""
_UPD = s.values(UPDATES, "source, expected_count, subdomain, version")


@query("enrich_metadata", "P12", f"""
    WITH {LEGACY} SELECT l.doc_id, l.source,
        CASE WHEN t.source IS NULL THEN l.subdomain ELSE t.subdomain END AS subdomain,
        CASE WHEN t.source IS NULL THEN l.version ELSE t.version END AS version,
        t.source IS NOT NULL AND (l.subdomain IS DISTINCT FROM t.subdomain
            OR l.version IS DISTINCT FROM t.version) AS needs_update
    FROM legacy l LEFT JOIN {_UPD} ON t.source = l.source""")
def enrich_metadata(spark, root):
    return ingest.enrich(_legacy(spark, root), UPDATES, ("subdomain", "version"))


@query("enrich_report", "P12", f"""
    WITH {LEGACY}, f AS (SELECT t.source, t.expected_count::BIGINT AS expected_count,
        count(l.doc_id) AS records_found, count(*) FILTER (WHERE l.doc_id IS NOT NULL
            AND (l.subdomain IS DISTINCT FROM t.subdomain
                 OR l.version IS DISTINCT FROM t.version)) AS records_requiring_update
        FROM {_UPD} LEFT JOIN legacy l ON l.source = t.source GROUP BY 1, 2)
    SELECT *, records_found = expected_count AS preflight_ok,
        records_requiring_update = 0 AS already_current, 0::BIGINT AS records_updated FROM f""")
def enrich_report(spark, root):
    return ingest.enrich_report(_legacy(spark, root), UPDATES, ("subdomain", "version"))


# --- scalar functions and rules -----------------------------------------------------------------

@query("text_functions", "H1 H2 H3 H4 H10", f"""
    SELECT doc_id, md5({s.strip('text')}) AS stripped, md5({s.norm('text')}) AS normalized,
        len({s.tokens('text')}) AS important,
        md5(array_to_string(list_sort({s.tokens('text')}), ' ')) AS all_tokens,
        'a_' || source || '.tar' AS stem, source || '.tar.GZ' AS name, '.gz' AS ext,
        replace(replace(lower(lang || ' A-b'), '-', '_'), ' ', '_') AS key FROM documents""")
def text_functions(spark, root):
    d = read_table(spark, root, "documents")
    path = F.concat(F.lit("a/"), "source", F.lit(".tar.GZ"))
    return d.select(
        "doc_id", F.md5(tx.strip("text")).alias("stripped"),
        F.md5(tx.normalize("text")).alias("normalized"),
        F.size(tx.important_tokens("text")).alias("important"),
        F.md5(F.array_join(F.array_sort(tx.important_tokens("text")), " ")).alias("all_tokens"),
        tx.source_stem(path).alias("stem"), tx.file_name(path).alias("name"),
        tx.extension(path).alias("ext"),
        tx.name_key(F.concat("lang", F.lit(" A-b "))).alias("key"))


PATTERNS = [
    ("credential", r"(?i)(api[_-]?key|access[_-]?token|token|secret|password|passwd)"
                   r"[ \t\n]*[:=][ \t\n]*['\"][^'\"]{4,}['\"]"),
    ("private_key_block", r"(?i)-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"),
    ("ipv4", r"(^|[^0-9.])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9.])"),
    ("licence", r"(?i)licen[cs]e"),
]


#: Cheap patterns that every match of the costly ones contains.
GUARDS = {"credential": r"[:=][ \t\n]*['\"]", "email": "@", "ipv4": r"[0-9]\.[0-9]"}


def _scan_sql(table, key, column, patterns):
    found = ", ".join(f"CASE WHEN regexp_matches({column}, {s.quoted(p)}) THEN '{n}' END" for n, p in patterns)
    return (f"SELECT {key}, array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ' ') "
            f"AS matched_rules FROM {table}")


@query("pattern_scan", "P13", _scan_sql("documents", "doc_id", "text", PATTERNS))
def pattern_scan(spark, root):
    out = rules.scan_patterns(read_table(spark, root, "documents"),
                              rules=[(n, p, GUARDS.get(n)) for n, p in PATTERNS])
    return out.select("doc_id", F.array_join("matched_rules", " ").alias("matched_rules"))


@query("secret_scan_pages", "P13", _scan_sql("pages", "page_id", "html", vocab.SECRET_PATTERNS))
def secret_scan_pages(spark, root):
    """The default secret rules over all raw pages."""
    out = rules.scan_patterns(read_table(spark, root, "pages"), "html")
    return out.select("page_id", F.array_join("matched_rules", " ").alias("matched_rules"))


LIMITS = [("l_quantity", 45, "quantity_gt_45"), ("l_extendedprice", 80000, "price_gt_80000"),
          ("l_discount", 0.08, "discount_gt_0.08"), ("l_tax", 0.07, "tax_gt_0.07")]


@query("limit_violations", "P14", "WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, "
       "l_suppkey, list_filter(["
       + ", ".join(f"CASE WHEN {c} > {v} THEN '{n}' END" for c, v, n in LIMITS)
       + "], lambda x: x IS NOT NULL) AS v FROM lineitem) SELECT l_orderkey, l_linenumber, "
       "l_partkey, l_suppkey, array_to_string(v, ' ') AS violations, "
       "len(v)::INTEGER AS violation_count, len(v) = 0 AS passed FROM v")
def limit_violations(spark, root):
    out = rules.violations(read_table(spark, root, "lineitem"), LIMITS)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.array_join("violations", " ").alias("violations"), "violation_count",
                      "passed")


@query("best_score_in_logs", "A18", """
    WITH logs AS (SELECT l_orderkey, string_agg('  ' || l_linenumber || '   '
        || (CASE WHEN l_discount > 0.05 THEN '-' ELSE '' END) || l_quantity || ' kcal', chr(10)
        ORDER BY l_linenumber, l_partkey, l_suppkey) || chr(10) || 'mode 1 -99.9' AS text
        FROM lineitem GROUP BY 1),
    found AS (SELECT l_orderkey, list_transform(regexp_extract_all(text,
        '(?m)^\\s*\\d+\\s+(-?\\d+(?:\\.\\d+)?)', 1), lambda x: x::DOUBLE) AS v FROM logs)
    SELECT l_orderkey, len(v)::INTEGER AS scores, list_min(v) AS best_score FROM found""")
def best_score_in_logs(spark, root):
    """Log text with one score line per order line, and a trailer that is not a score."""
    line = F.concat(F.lit("  "), F.col("l_linenumber").cast("string"), F.lit("   "),
                    F.when(F.col("l_discount") > 0.05, F.lit("-")).otherwise(F.lit("")),
                    F.col("l_quantity").cast("string"), F.lit(" kcal"))
    logs = read_table(spark, root, "lineitem").groupBy("l_orderkey").agg(F.array_sort(
        F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("t"))))
        .alias("lines")).select("l_orderkey", F.concat(
            F.array_join(F.transform("lines", lambda x: x["t"]), "\n"),
            F.lit("\nmode 1 -99.9")).alias("text"))
    return rules.best_score(logs).select(
        "l_orderkey", F.size("scores").alias("scores"), "best_score")


@query("vector_field_stats", "A19", f"""
    WITH m AS (SELECT label, sqrt({s.dot('embedding', 'embedding')}) AS m FROM embeddings)
    SELECT label, count(*) AS "rows", round(min(m), 6) AS minimum, round(max(m), 6) AS maximum,
        round(avg(m), 6) AS mean FROM m GROUP BY 1""")
def vector_field_stats(spark, root):
    out = rules.field_stats(read_table(spark, root, "embeddings"), ["label"])
    return out.select("label", "rows", *[F.round(c, 6).alias(c)
                                         for c in ("minimum", "maximum", "mean")])


@query("latest_numeric_name", "A19", """
    WITH n AS (SELECT lang, TRY_CAST(replace(source, 'src', '') AS DOUBLE) AS v FROM documents)
    SELECT lang, max(v) AS latest FROM n GROUP BY 1""")
def latest_numeric_name(spark, root):
    d = read_table(spark, root, "documents").withColumn(
        "name", F.replace("source", F.lit("src"), F.lit("")))
    return rules.latest_numeric(d, ["lang"], "name")


GROUPS = [("volume", "n_R"), ("volume", "n_A"), ("money", "rev_R"), ("money", "rev_N")]


@query("regroup_metric_maps", "A20", """
    WITH m AS (SELECT l_suppkey, l_returnflag AS f, count(*)::DOUBLE AS n,
        round(sum(l_extendedprice), 2) AS rev FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, coalesce(sum(n) FILTER (WHERE f IN ('R', 'A')), 0) AS volume,
        count(*) FILTER (WHERE f IN ('R', 'A')) AS volume_size,
        count(*) FILTER (WHERE f IN ('R', 'N')) AS money_size,
        count(*) AS percentile_count, 2 * count(*) AS base_count,
        count(*) FILTER (WHERE f = 'N') + count(*) FILTER (WHERE f = 'A') AS unclassified_count
    FROM m GROUP BY 1""")
def regroup_metric_maps(spark, root):
    """Metric maps per supplier with percentile entries, regrouped by name."""
    m = read_table(spark, root, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count("*").cast("double").alias("n"),
        F.round(F.sum("l_extendedprice"), 2).alias("rev"))
    entry = [F.struct(F.concat(F.lit(p), "l_returnflag", F.lit(e)).alias("k"),
                      v.alias("v")) for p, e, v in (
        ("n_", "", F.col("n")), ("rev_", "", F.col("rev")), ("n_", "_pct", F.lit(0.5)))]
    maps = m.groupBy("l_suppkey").agg(F.map_from_entries(F.flatten(F.collect_list(
        F.array(*entry)))).alias("metrics"))
    out = rules.regroup_metrics(maps, groups=GROUPS, suffix="_pct")
    volume = F.col("grouped")["volume"]
    return out.select(
        "l_suppkey", F.aggregate(F.map_values(volume), F.lit(0.0), lambda a, x: a + x)
        .alias("volume"), F.size(volume).cast("long").alias("volume_size"),
        F.size(F.col("grouped")["money"]).cast("long").alias("money_size"),
        *[F.col(c).cast("long").alias(c)
          for c in ("percentile_count", "base_count", "unclassified_count")])


# --- tables ---------------------------------------------------------------------------------------

@query("vector_upsert", "S7 S8 A21", """
    WITH w AS (SELECT vec_id, label + 100 AS label, vec_id AS seq FROM embeddings WHERE label < 5
        UNION ALL SELECT vec_id + 1000000, label, vec_id FROM embeddings WHERE label = 7
        UNION ALL SELECT vec_id, label + 200, vec_id + 1000000 FROM embeddings WHERE label = 3),
    newest AS (SELECT vec_id, arg_max(label, seq) AS label FROM w GROUP BY 1)
    SELECT vec_id, label FROM newest UNION ALL SELECT vec_id, label FROM embeddings e
    WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.vec_id = e.vec_id)""")
def vector_upsert(spark, root):
    e = read_table(spark, root, "embeddings").select("vec_id", "label")
    seq = F.col("vec_id").alias("seq")
    new = (e.where("label < 5").select("vec_id", (F.col("label") + 100).alias("label"), seq)
           .unionAll(e.where("label = 7").select(F.col("vec_id") + 1000000, "label", seq))
           .unionAll(e.where("label = 3").select("vec_id", F.col("label") + 200,
                                                 F.col("vec_id") + 1000000)))
    return tables.upsert_by_key(e, new, ["vec_id"], "seq").select("vec_id", "label")


@query("vector_table_append", "S7 S8", """
    SELECT d.lang AS domain, count(*) AS vectors, sum(e.vec_id)::BIGINT AS ids
    FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id GROUP BY 1""")
def vector_table_append(spark, root):
    """Vectors written as a table partitioned by domain, emptied, appended and counted."""
    from .retrieval import vector_table
    path = scratch_path(spark, "vectors")
    rows = vector_table(spark, root).select("id", "embedding", "domain")
    tables.append(rows, path, "domain")
    tables.reset(rows, path)
    tables.append(rows, path, "domain")
    return spark.read.schema(rows.schema).parquet(path).groupBy("domain").agg(
        F.count("*").alias("vectors"), F.sum("id").alias("ids"))


@query("manifest_and_schema", "S6 S13 H6", """
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'other' END AS kind,
        0 AS attempt, 3 AS max_attempts FROM conversations""")
def manifest_and_schema(spark, root):
    """JSON text decoded with a default for bad input, then missing columns added."""
    c = read_table(spark, root, "conversations")
    text = F.when(F.col("role") == "user", F.to_json(F.struct(F.col("role").alias("kind")))) \
        .when(F.col("role") == "system", F.lit("")).otherwise(F.lit("{broken"))
    parsed = tx.json_or_default(text, "kind string", F.struct(F.lit("other").alias("kind")))
    out = c.select("conv_id", "turn", F.coalesce(parsed["kind"], F.lit("other")).alias("kind"))
    return tables.add_missing(out, tables.JOB_DEFAULTS).drop("last_failure_type")


_INGESTED = f"""named AS (SELECT DISTINCT source || '.txt' AS source, text,
        sha256(text) AS document_sha256 FROM documents),
    body AS (SELECT source, document_sha256, {s.strip('text')} AS text FROM named),
    {_windows(1200, 200, table='body')},
    c AS (SELECT *, row_number() OVER (PARTITION BY source, document_sha256 ORDER BY number)
        AS i FROM cut WHERE chunk_text <> '')"""


@query("ingest_stream", "R1 J6 J7 J8 T4", f"""
    WITH {_INGESTED}
    SELECT 'sha256:' || document_sha256 || '::' || source || '::p1::c' || i AS chunk_id,
        length(chunk_text) AS character_count FROM c""")
def ingest_stream_query(spark, root):
    """All documents delivered twice by a file stream; the second delivery adds nothing."""
    path = scratch_path(spark, "arrivals")
    docs = read_table(spark, root, "documents").select(
        F.concat("source", F.lit(".txt")).alias("source"), F.col("lang").alias("domain"), "text")
    for _ in range(2):
        docs.write.mode("append").parquet(f"{path}/in")
        arrivals = (spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", str(64 << 20))
                    .parquet(f"{path}/in"))
        ingestion.ingest_stream(arrivals, f"{path}/chunks", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/chunks").select("chunk_id", "character_count")


@query("ingest_corpus", "S1 S2 S3 P7 T4 J6 J7 J8 T14 S7 A16", f"""
    WITH body AS (SELECT sha256(text || chr(10)) AS document_sha256, {s.strip('text')} AS text, item_id FROM benchmark),
    {_windows(200, 50, table='body')},
    n AS (SELECT document_sha256, count(*) FILTER (WHERE chunk_text <> '') AS chunks FROM cut GROUP BY 1)
    SELECT run, document_sha256, status, chunks AS chunks_total, CASE WHEN status = 'created' THEN chunks ELSE 0 END
        AS chunks_indexed, verified FROM n,
        (VALUES ('1 first', 'created', TRUE), ('2 again', 'duplicate', TRUE), ('3 layout', 'conflict', NULL)) AS r(run, status, verified)
    WHERE run <> '3 layout' OR chunks > 1""")
def ingest_corpus(spark, root):
    """Files written, found, loaded, checked, cut, embedded and stored; run again; run with another layout.

    The second run adds nothing. With the other layout every document of several chunks stops.
    """
    path = scratch_path(spark, "corpus")
    items = read_table(spark, root, "benchmark")
    items.select(F.lit("bench").alias("area"), F.col("item_id").alias("item"), "text").write.partitionBy("area", "item") \
        .text(f"{path}/files")
    listing = corpus.read_corpus(spark, f"{path}/files", domains=("area=bench",))
    good, _ = corpus.load_documents(corpus.ingest_domain(listing, "area=bench", ("area=bench",)))
    # Spark names files anew in every write; the folder is what names the document
    docs = good.select(F.regexp_extract("path", "item=([^/]+)/", 1).alias("source"), "domain", "text")
    out = []
    for run, size, overlap in (("1 first", 200, 50), ("2 again", 200, 50), ("3 layout", 400, 50)):
        done = ingestion.ingest_documents(docs, f"{path}/vectors", size=size, overlap=overlap)
        known = done.outcome.join(done.verified.select("document_sha256", "verified"), "document_sha256", "left")
        out.append(cut_lineage(known.select(F.lit(run).alias("run"), "document_sha256", "status", "chunks_total",
                                            "chunks_indexed", "verified"), "run"))
    first, again, layout = out
    stopped = layout.where("status = 'conflict'").select("run", "document_sha256").join(
        first.select("document_sha256", "chunks_total"), "document_sha256").select(
        "run", "document_sha256", F.lit("conflict").alias("status"), "chunks_total", F.lit(0).cast("long").alias("chunks_indexed"),
        F.lit(None).cast("boolean").alias("verified"))
    return first.unionByName(again).unionByName(stopped)


@query("parsed_fields", "A19", """
    SELECT l_orderkey, count(*) AS numbers, round(sum(l_quantity), 4) AS total, count(*) AS triples,
        round(sum(l_discount), 4) AS third FROM lineitem GROUP BY 1""")
def parsed_fields(spark, root):
    """Field files as a solver writes them, made of the line items of an order, parsed again."""
    rows = read_table(spark, root, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.concat_ws(" ", F.collect_list(F.col("l_quantity").cast("string"))).alias("s"),
        F.concat_ws("", F.collect_list(F.format_string("(0 1e0 %s)", F.col("l_discount").cast("string")))).alias("v"))
    scalars = rules.parse_scalars(F.format_string("internalField   nonuniform List<scalar> %d (%s) ;", "n", "s"))
    vectors = rules.parse_vectors(F.format_string("internalField nonuniform List<vector> %d\n(%s)\n;", "n", "v"))
    add = lambda a, x: a + x
    out = rows.select("l_orderkey", scalars.alias("s"), vectors.alias("v"))
    return out.select(
        "l_orderkey", F.size("s").cast("long").alias("numbers"), F.round(F.aggregate("s", F.lit(0.0), add), 4).alias("total"),
        F.size("v").cast("long").alias("triples"),
        F.round(F.aggregate(F.transform("v", lambda t: t[2]), F.lit(0.0), add), 4).alias("third"))


@query("read_manifest", "S6", "SELECT item_id::VARCHAR AS item, length(text) AS letters FROM benchmark")
def read_manifest(spark, root):
    """Manifests written as JSON arrays, one file for each bucket of about a thousand rows, and read back."""
    path = scratch_path(spark, "manifest")
    items = read_table(spark, root, "benchmark")
    record = F.to_json(F.struct(F.col("item_id").cast("string").alias("item"), "text"))
    documents = tables.json_arrays(items.select("item_id", record.alias("record")), "item_id", "record", items.count())
    tables.write_documents(documents, path)
    return tables.read_manifest(spark, path, "item string, text string").select(
        "item", F.char_length("text").alias("letters"))


@query("open_fields", "H6 S12", """
    WITH p AS (SELECT event_id, CASE event_type WHEN 'error' THEN left(props, length(props) - 1)
            WHEN 'view' THEN '[' || event_id || ', {"page": "p' || user_id || '"}]'
            WHEN 'click' THEN '{"k": "' || event_id || '", "deep": {"list": [1, 2.5, "x"]}}'
            WHEN 'signup' THEN NULL ELSE props END AS props FROM events)
    SELECT event_id, CASE WHEN json_valid(props) THEN json_type(props) END AS kind,
        CASE WHEN json_valid(props) THEN try_cast(props ->> '$.k' AS BIGINT) END AS k,
        CASE WHEN json_valid(props) THEN props ->> '$[1].page' END AS page,
        CASE WHEN json_valid(props) THEN try_cast(props ->> '$.deep.list[1]' AS DOUBLE) END AS number,
        props IS NOT NULL AND NOT coalesce(json_valid(props), false) AS broken FROM p""")
def open_fields(spark, root):
    """Fields of JSON without a fixed schema: objects, arrays, nested values, nulls and broken text."""
    event = F.col("event_type")
    props = F.when(event == "error", F.expr("left(props, length(props) - 1)")) \
        .when(event == "view", F.format_string('[%d, {"page": "p%d"}]', "event_id", "user_id")) \
        .when(event == "click", F.format_string('{"k": "%d", "deep": {"list": [1, 2.5, "x"]}}', "event_id")) \
        .when(event == "signup", F.lit(None)).otherwise(F.col("props"))
    v = F.try_parse_json("props")
    whole = F.schema_of_variant("v")
    kind = F.when(whole.startswith("OBJECT"), "OBJECT").when(whole.startswith("ARRAY"), "ARRAY")
    return read_table(spark, root, "events").select("event_id", props.alias("props")).withColumn("v", v).select(
        "event_id", kind.alias("kind"), F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.try_variant_get("v", "$[1].page", "string").alias("page"),
        F.try_variant_get("v", "$.deep.list[1]", "double").alias("number"),
        (F.col("props").isNotNull() & F.col("v").isNull()).alias("broken"))


@query("stored_vector_upsert", "S7 S8 S12 A21", """
    WITH one AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 50 = 0
            UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 90 = 1),
    two AS (SELECT vec_id, label + 200 AS label FROM embeddings WHERE vec_id % 100 = 0
            UNION ALL SELECT vec_id + 1000000, label + 300 FROM embeddings WHERE vec_id % 180 = 1),
    every AS (SELECT vec_id, label, 0 AS seq FROM embeddings UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two)
    SELECT vec_id, arg_max(label, seq) AS label FROM every GROUP BY vec_id""")
def stored_vector_upsert(spark, root):
    """A stored vector table updated in place twice, each time with some rows replaced and some added."""
    e = read_table(spark, root, "embeddings").select("vec_id", "embedding", "label")
    table = stored.KeyedTable(spark, scratch_path(spark, "vectors"), e.schema, ("vec_id",))
    table.upsert(e, "label")
    new = F.col("vec_id") + 1000000
    for step, shift, more in ((1, 100, 0), (2, 200, 300)):
        table.upsert(e.where(f"vec_id % {50 * step} = 0").withColumn("label", (F.col("label") + shift).cast("int")).unionByName(
            e.where(f"vec_id % {90 * step} = 1").select(new.alias("vec_id"), "embedding", (F.col("label") + more).cast("int").alias("label"))),
            "label")
    return table.read().select("vec_id", "label")
