"""Answer scoring and benchmark statistics over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ... import vocab
from ...functions import text as tx
from ...operators import evaluate, route
from ...session import read_table, scratch_path
from ...sources import tables
from . import query
from . import sqltext as s
from .graphs import ALIASES, PATTERNS, route_sql

# --- inputs: assistant turns are answers, passages of `benchmark` are their claims ------------


def answers(spark, root):
    """Turns of one conversation are repetitions; they alternate between the two modes."""
    return read_table(spark, root, "conversations").where("role = 'assistant'").select(
        F.col("conv_id").alias("question_id"), F.col("turn").alias("repetition"),
        F.when(F.col("turn") % 4 < 2, F.lit("vector")).otherwise(F.lit("graph")).alias("mode"),
        F.col("text").alias("answer"))


def claims(spark, root):
    """Sentences of a passage are claims; each word, or the word reversed, is a term group."""
    b = read_table(spark, root, "benchmark")
    items = b.count()
    sentences = F.filter(F.transform(F.split("text", r"\."), lambda x: F.btrim(x)),
                         lambda x: x != "")
    claim = F.transform(sentences, lambda x, i: F.struct(
        F.concat(F.lit("c"), (i + 1).cast("string")).alias("claim_id"),
        F.transform(F.split(x, r"\s+"), lambda w: F.array(w, F.reverse(w))).alias("term_groups")))
    passages = b.select((F.col("item_id") % items).alias("item"), claim.alias("claims"))
    asked = read_table(spark, root, "conversations").select(
        F.col("conv_id").alias("question_id")).distinct()
    return asked.withColumn("item", F.col("question_id") % items).join(passages, "item").drop("item")


SCORED = f"""answers AS (SELECT conv_id AS question_id, turn AS repetition,
        CASE WHEN turn % 4 < 2 THEN 'vector' ELSE 'graph' END AS mode, text AS answer,
        {s.norm('text')} AS body FROM conversations WHERE role = 'assistant'),
    sentences AS (SELECT item_id, list_filter(list_transform(string_split(text, '.'),
        lambda x: trim(x)), lambda x: x <> '') AS ss FROM benchmark),
    claimed AS (SELECT item_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS c
        FROM sentences),
    words AS (SELECT item_id, c, unnest(string_split_regex(sentence, '\\s+')) AS w,
        generate_subscripts(string_split_regex(sentence, '\\s+'), 1) AS g FROM claimed),
    marks AS (SELECT a.question_id, a.repetition, a.mode, w.c, w.g,
        contains(a.body, {s.norm('w.w')}) OR contains(a.body, {s.norm('reverse(w.w)')}) AS ok
        FROM answers a JOIN words w
        ON w.item_id = a.question_id % (SELECT count(*) FROM benchmark)),
    per_claim AS (SELECT question_id, repetition, mode, c, bool_and(ok) AS ok FROM marks
        GROUP BY 1, 2, 3, 4),
    claim_sums AS (SELECT question_id, repetition, mode,
        string_agg('c' || c, ' ' ORDER BY c) FILTER (WHERE ok) AS claims_passed,
        count(*) AS claims_total, count(*) FILTER (WHERE ok) / count(*) AS claim_coverage
        FROM per_claim GROUP BY 1, 2, 3),
    group_sums AS (SELECT question_id, repetition, mode,
        string_agg('c' || c || ':' || g, ' ' ORDER BY c, g) FILTER (WHERE ok) AS groups_passed,
        count(*) AS claim_groups_total, count(*) FILTER (WHERE ok) / count(*)
        AS claim_group_coverage FROM marks GROUP BY 1, 2, 3),
    scored AS (SELECT * FROM claim_sums JOIN group_sums USING (question_id, repetition, mode)),
    runs AS (SELECT question_id, mode, repetition, claim_coverage, claim_group_coverage,
        claim_groups_total + repetition AS prompt_tokens,
        len(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS answer_tokens,
        length(answer) * 1.5::DOUBLE + repetition AS generation_latency_ms
        FROM scored JOIN answers USING (question_id, repetition, mode)),
    questions AS (SELECT conv_id AS question_id, CASE conv_id % 3 WHEN 0 THEN 'direct'
        WHEN 1 THEN 'cross_source' ELSE 'boundary' END AS category,
        CASE WHEN max(length(text)) > 600 THEN 'graph' ELSE 'vector' END AS selected_mode,
        count(*) FILTER (WHERE role = 'user') / count(*) AS recall FROM conversations GROUP BY 1),
    asked AS (SELECT *, CASE WHEN category = 'direct' THEN 'vector' ELSE 'graph' END
        AS expected_mode FROM questions)"""


def runs(spark, root):
    scored = evaluate.score_answers(answers(spark, root), claims(spark, root))
    return scored.select(
        "question_id", "mode", "repetition", "claim_coverage", "claim_group_coverage",
        (F.col("claim_groups_total") + F.col("repetition")).alias("prompt_tokens"),
        F.size(F.regexp_extract_all(F.lower("answer"), F.lit("[a-z0-9]+"), 0))
        .alias("answer_tokens"),
        (F.char_length("answer") * 1.5 + F.col("repetition")).alias("generation_latency_ms"))


def questions(spark, root):
    kind = F.col("question_id") % 3
    return read_table(spark, root, "conversations").groupBy(
        F.col("conv_id").alias("question_id")).agg(
            F.max(F.char_length("text")).alias("_longest"),
            F.avg((F.col("role") == "user").cast("int")).alias("recall")).select(
        "question_id", F.when(kind == 0, F.lit("direct")).when(kind == 1, F.lit("cross_source"))
        .otherwise(F.lit("boundary")).alias("category"),
        F.when(F.col("_longest") > 600, F.lit("graph")).otherwise(F.lit("vector"))
        .alias("selected_mode"), "recall").withColumn(
        "expected_mode", F.when(F.col("category") == "direct", F.lit("vector"))
        .otherwise(F.lit("graph")))


def _rounded(df, keys):
    return df.select(*keys, *[F.round(F.col(c).cast("double"), 6).alias(c)
                              for c in df.columns if c not in keys])


def _summary_sql():
    return ", ".join(f"round(avg({m})::DOUBLE, 6) AS {m}, "
                     f"round(stddev_pop({m})::DOUBLE, 6) AS {m}_stddev"
                     for m in vocab.RUN_METRICS)


# --- scoring ------------------------------------------------------------------------------

@query("score_answers", "A9 H3 M12", f"""
    WITH {SCORED} SELECT question_id, repetition, mode,
        coalesce(claims_passed, '') AS claims_passed, claims_total,
        coalesce(groups_passed, '') AS groups_passed, claim_groups_total,
        round(claim_coverage, 6) AS claim_coverage,
        round(claim_group_coverage, 6) AS claim_group_coverage FROM scored""")
def score_answers(spark, root):
    out = evaluate.score_answers(answers(spark, root), claims(spark, root))
    return out.select(
        "question_id", "repetition", "mode",
        F.array_join("claims_passed", " ").alias("claims_passed"),
        F.col("claims_total").cast("long").alias("claims_total"),
        F.array_join("claim_groups_passed", " ").alias("groups_passed"),
        F.col("claim_groups_total").cast("long").alias("claim_groups_total"),
        F.round("claim_coverage", 6).alias("claim_coverage"),
        F.round("claim_group_coverage", 6).alias("claim_group_coverage"))


@query("metric_summary", "A10 M14", f"""
    WITH {SCORED} SELECT mode, {_summary_sql()} FROM runs GROUP BY 1""")
def metric_summary(spark, root):
    return _rounded(evaluate.metric_summary(runs(spark, root), "mode"), ["mode"])


@query("run_dispersion", "A11", f"""
    WITH {SCORED}, per AS (SELECT mode, question_id, """
    + ", ".join(f"stddev_pop({m}) AS {m}" for m in vocab.RUN_METRICS)
    + " FROM runs GROUP BY 1, 2) SELECT mode, "
    + ", ".join(f"round(avg({m}), 6) AS {m}_stddev_mean, round(max({m}), 6) AS {m}_stddev_max, "
                f"round(median({m}), 6) AS {m}_stddev_median" for m in vocab.RUN_METRICS)
    + " FROM per GROUP BY 1")
def run_dispersion(spark, root):
    out = evaluate.dispersion(runs(spark, root))
    return _rounded(out, ["mode"])


@query("category_summary", "A13", f"""
    WITH {SCORED}, per AS (SELECT category, count(*) AS questions,
        round(avg(recall), 6) AS retrieval_source_recall FROM asked GROUP BY 1),
    sums AS (SELECT category, mode, {_summary_sql()} FROM runs JOIN asked USING (question_id)
        GROUP BY 1, 2)
    SELECT * FROM sums JOIN per USING (category)""")
def category_summary(spark, root):
    out = evaluate.category_summary(runs(spark, root), questions(spark, root))
    return _rounded(out, ["category", "mode", "questions"])


@query("router_selected_path", "A14", f"""
    WITH {SCORED} SELECT category, {_summary_sql()} FROM runs r JOIN asked a USING (question_id)
    WHERE r.mode = CASE WHEN a.category = 'direct' THEN 'vector' ELSE 'graph' END GROUP BY 1""")
def router_selected_path(spark, root):
    q = questions(spark, root)
    chosen = evaluate.routed_runs(runs(spark, root), q).join(
        q.select("question_id", "category"), "question_id")
    return _rounded(evaluate.metric_summary(chosen, "category"), ["category"])


# --- routing accuracy --------------------------------------------------------------------

_TURNS = """questions AS (SELECT conv_id || '-' || turn AS query_id, text AS question,
    CASE WHEN conv_id % 3 = 0 THEN 'vector' ELSE 'graph' END AS expected_mode
    FROM conversations)"""
_DECIDED = f"""{_TURNS}, {route_sql(ALIASES, PATTERNS)},
    decided AS (SELECT q.expected_mode, r.selected_mode FROM routed r
        JOIN questions q USING (query_id))"""


def _decided(spark, root):
    turns = read_table(spark, root, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
        .alias("query_id"), F.col("text").alias("question"),
        F.when(F.col("conv_id") % 3 == 0, F.lit("vector")).otherwise(F.lit("graph"))
        .alias("expected_mode"))
    return route.route(turns, ALIASES, PATTERNS)


@query("routing_confusion", "A12", f"""
    WITH {_DECIDED}, labels AS (SELECT unnest(['vector', 'graph']) AS expected_mode)
    SELECT l.expected_mode, count(*) FILTER (WHERE selected_mode = 'vector') AS vector,
        count(*) FILTER (WHERE selected_mode = 'graph') AS graph
    FROM labels l LEFT JOIN decided d USING (expected_mode) GROUP BY 1""")
def routing_confusion(spark, root):
    return evaluate.confusion(_decided(spark, root))


@query("routing_accuracy", "A12", f"""
    WITH {_DECIDED} SELECT count(*) FILTER (WHERE expected_mode = selected_mode) AS correct,
        count(*) AS questions, round(avg((expected_mode = selected_mode)::INT), 6) AS accuracy
    FROM decided""")
def routing_accuracy(spark, root):
    return evaluate.routing_summary(_decided(spark, root)).withColumn(
        "accuracy", F.round("accuracy", 6))


# --- review, checkpoint and result files ------------------------------------------------------

@query("review_tally", "A24", f"""
    WITH {SCORED}, r AS (SELECT mode, CASE WHEN claim_group_coverage > 0.5 THEN 'supported'
        WHEN claim_group_coverage > 0.25 THEN 'partial' ELSE 'unsupported' END AS judgement
        FROM scored)
    SELECT judgement, count(*) FILTER (WHERE mode = 'vector') AS vector,
        count(*) FILTER (WHERE mode = 'graph') AS graph FROM r GROUP BY 1""")
def review_tally(spark, root):
    share = F.col("claim_group_coverage")
    return evaluate.review_tally(runs(spark, root).withColumn(
        "judgement", F.when(share > 0.5, F.lit("supported")).when(share > 0.25, F.lit("partial"))
        .otherwise(F.lit("unsupported"))))


@query("pending_items", "J9 H6", """
    WITH items AS (SELECT DISTINCT conv_id AS question_id,
        sha256('{"question_id":' || conv_id || ',"top_k":6}') AS signature FROM conversations),
    done AS (SELECT conv_id AS question_id, sha256('{"question_id":' || conv_id || ',"top_k":'
        || CASE WHEN count(*) > 2 THEN 6 ELSE 5 END || '}') AS signature
        FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT * FROM items WHERE (question_id, signature) NOT IN (SELECT * FROM done)""")
def pending_items(spark, root):
    """Questions whose finished rows were made with other settings are still pending."""
    c = read_table(spark, root, "conversations").withColumnRenamed("conv_id", "question_id")
    items = c.select("question_id").distinct().withColumn("top_k", F.lit(6))
    done = c.where("role = 'assistant'").groupBy("question_id").agg(
        F.when(F.count("*") > 2, 6).otherwise(5).alias("top_k"))
    def signed(df):
        return evaluate.signature(df, "question_id", "top_k").drop("top_k")
    return evaluate.pending(signed(items), signed(done), signature_col="signature")


@query("checkpoint_problems", "J9", """
    WITH done AS (SELECT conv_id AS question_id FROM conversations WHERE role = 'system'
        UNION ALL SELECT conv_id + 90 FROM conversations WHERE turn = 0),
    counted AS (SELECT question_id, count(*) AS n FROM done GROUP BY 1)
    SELECT question_id, 'unknown' AS problem FROM counted
        WHERE question_id NOT IN (SELECT conv_id FROM conversations)
    UNION ALL SELECT question_id, 'duplicate' FROM counted WHERE n > 1""")
def checkpoint_problems(spark, root):
    c = read_table(spark, root, "conversations")
    items = c.select(F.col("conv_id").alias("question_id")).distinct()
    done = c.where("role = 'system'").select(F.col("conv_id").alias("question_id")).unionAll(
        c.where("turn = 0").select(F.col("conv_id") + 90))
    return evaluate.checkpoint_problems(items, done)


_WIDE = ", ".join(
    f"round(avg({m}) FILTER (WHERE mode = '{mode}')::DOUBLE, 6) AS {mode}_{name}" + (
        "" if m == "prompt_tokens" else
        f", round(stddev_pop({m}) FILTER (WHERE mode = '{mode}')::DOUBLE, 6) "
        f"AS {mode}_{name}_stddev")
    for mode in ("vector", "graph") for m, name in (
        ("claim_coverage", "claim_coverage"), ("claim_group_coverage", "claim_group_coverage"),
        ("prompt_tokens", "prompt_tokens"), ("generation_latency_ms", "latency_ms")))
_FLAT = f"""WITH {SCORED}, wide AS (SELECT question_id, {_WIDE} FROM runs GROUP BY 1)
    SELECT question_id, category, expected_mode, selected_mode,
        expected_mode = selected_mode AS router_correct, round(recall, 6) AS recall,
        wide.* EXCLUDE (question_id) FROM asked JOIN wide USING (question_id)"""
_KEYS = ["question_id", "category", "expected_mode", "selected_mode", "router_correct"]


@query("benchmark_table", "S11 M14", _FLAT)
def benchmark_table(spark, root):
    return _rounded(evaluate.benchmark_table(runs(spark, root), questions(spark, root)), _KEYS)


@query("results_round_trip", "S11", _FLAT)
def results_round_trip(spark, root):
    """The summary written as CSV with a header, next to the JSON details, and read back."""
    flat = benchmark_table(spark, root)
    path = scratch_path(spark, "results")
    tables.write_results(runs(spark, root), flat, path)
    return spark.read.schema(flat.schema).option("header", "true").csv(f"{path}/summary")


@query("token_overlap", "H3 H4", f"""
    SELECT conv_id, turn, len({s.tokens('text')}) AS important,
        md5({s.norm('text')}) AS normalized FROM conversations""")
def token_overlap(spark, root):
    return read_table(spark, root, "conversations").select(
        "conv_id", "turn", F.size(tx.important_tokens("text")).alias("important"),
        F.md5(tx.normalize("text")).alias("normalized"))
