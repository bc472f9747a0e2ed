"""Scoring of answers against claims and the statistics of benchmark runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..session import cut_lineage
from .segments import exact_median

LABELS = ("vector", "graph")


def source_recall(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of the distinct gold sources that were retrieved, per question.

    ``hits(query_id, source_id)`` and ``gold(query_id, source_id)``; blank ids do not count.
    """
    def ids(df, flag):
        return df.where(F.coalesce("source_id", F.lit("")) != "").select(
            "query_id", "source_id", F.lit(int(flag == "g")).alias("g"),
            F.lit(int(flag == "h")).alias("h"))
    sides = ids(gold, "g").unionAll(ids(hits, "h")).groupBy("query_id", "source_id").agg(
        F.max("g").alias("g"), F.max("h").alias("h"))
    out = sides.groupBy("query_id").agg(
        F.sum(F.col("g") * F.col("h")).alias("found"), F.sum("g").alias("gold"))
    return out.where(F.col("gold") > 0).withColumn(
        "recall", F.col("found") / F.col("gold"))


def score_answers(answers: DataFrame, claims: DataFrame, on: str = "question_id",
                  words: bool = False) -> DataFrame:
    """Claim and claim-group coverage of every answer.

    ``claims(question_id, claims array<struct<claim_id, term_groups array<array<string>>>>)``.
    A group passes when any alternative occurs in the answer, a claim when all groups pass;
    both sides are reduced to lower-case ASCII tokens first. Scoring stays inside the row.
    Answers of questions without claims keep their row with null scores. Alternatives match as
    substrings, or with ``words`` as whole words only.
    """
    def edged(tokens):
        return F.concat(F.lit(" "), tokens, F.lit(" ")) if words else tokens

    ready = claims.select(on, F.transform("claims", lambda c: F.struct(
        c["claim_id"].alias("claim_id"),
        F.transform(c["term_groups"], lambda g: F.transform(
            g, lambda t: edged(tx.normalize(t)))).alias("groups"),
    )).alias("_claims"))
    df = answers.join(ready, on, "left")
    df = df.withColumn("_marks", tx.bind(
        edged(tx.normalize(F.col("answer"))), lambda text: F.transform("_claims", lambda c: F.struct(
            c["claim_id"].alias("claim_id"),
            F.transform(c["groups"], lambda g: F.exists(
                g, lambda t: F.contains(text, t))).alias("passed")))))
    passed = F.transform(F.filter("_marks", lambda c: F.forall(c["passed"], lambda p: p)),
                         lambda c: c["claim_id"])
    groups = F.flatten(F.transform("_marks", lambda c: F.transform(
        c["passed"], lambda p, i: F.when(p, F.concat(
            c["claim_id"].cast("string"), F.lit(":"), (i + 1).cast("string"))))))
    df = (df.withColumn("claims_passed", passed)
          .withColumn("claims_total", F.size("_marks"))
          .withColumn("claim_groups_total", F.size(groups))
          .withColumn("claim_groups_passed", F.array_compact(groups)))
    return (
        df.withColumn("claim_coverage", F.try_divide(F.size("claims_passed"), "claims_total"))
        .withColumn("claim_group_coverage",
                    F.try_divide(F.size("claim_groups_passed"), "claim_groups_total"))
        .drop("_claims", "_marks")
    )


def metric_summary(runs: DataFrame, *by: str, metrics=vocab.RUN_METRICS) -> DataFrame:
    """Mean and population standard deviation of every metric, optionally per group."""
    aggregates = [a for m in metrics for a in (
        F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_stddev"))]
    return runs.groupBy(*by).agg(*aggregates) if by else runs.agg(*aggregates)


def dispersion(runs: DataFrame, metrics=vocab.RUN_METRICS) -> DataFrame:
    """Run-to-run spread per mode: mean, median and maximum of the per-question deviations."""
    per = runs.groupBy("mode", "question_id").agg(
        *[F.stddev_pop(m).alias(m) for m in metrics])
    long = cut_lineage(per.unpivot(["mode"], list(metrics), "metric", "value"), "deviations")
    stats = long.groupBy("mode", "metric").agg(
        F.avg("value").alias("mean"), F.max("value").alias("max"))
    middle = exact_median(long, ["mode", "metric"], "value", "median")
    both = stats.join(middle, ["mode", "metric"])
    return both.groupBy("mode").agg(*[
        F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{m}_stddev_{x}")
        for m in metrics for x in ("mean", "median", "max")])


def confusion(decisions: DataFrame) -> DataFrame:
    """Expected against selected mode with zero cells, as one row per expected mode."""
    counts = (decisions.groupBy("expected_mode").pivot("selected_mode", list(LABELS))
              .agg(F.count(F.lit(1))))
    labels = decisions.sparkSession.createDataFrame([(x,) for x in LABELS], "expected_mode string")
    return labels.join(counts, "expected_mode", "left").select(
        "expected_mode", *[F.coalesce(F.col(x), F.lit(0)).alias(x) for x in LABELS])


def routing_summary(decisions: DataFrame) -> DataFrame:
    """Correct decisions, questions and accuracy."""
    ok = (F.col("expected_mode") == F.col("selected_mode")).cast("int")
    return decisions.agg(F.sum(ok).alias("correct"), F.count("*").alias("questions"),
                         F.avg(ok).alias("accuracy"))


def category_summary(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Per category and mode: question count, mean source recall and the metric summary.

    ``questions(question_id, category, recall)`` has one row per question.
    """
    per = questions.groupBy("category").agg(
        F.count("*").alias("questions"), F.avg("recall").alias("retrieval_source_recall"))
    summary = metric_summary(runs.join(questions.select("question_id", "category"), "question_id"),
                             "category", "mode")
    return summary.join(per, "category")


def routed_runs(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """Runs of the router-selected path: vector for direct questions, graph for all others."""
    wanted = F.when(F.col("category") == "direct", F.lit("vector")).otherwise(F.lit("graph"))
    return runs.join(questions.select("question_id", wanted.alias("mode")),
                     ["question_id", "mode"])


def review_tally(reviews: DataFrame, judgements: list[str] | None = None) -> DataFrame:
    """Answers per judgement with one column per mode."""
    out = reviews.groupBy("judgement").pivot("mode", list(LABELS)).agg(F.count(F.lit(1)))
    if judgements:
        out = reviews.sparkSession.createDataFrame(
            [(j,) for j in judgements], "judgement string").join(out, "judgement", "left")
    return out.na.fill(0, list(LABELS))


def evidence_audit(hits: DataFrame) -> DataFrame:
    """The evidence behind an answer: id, distance, score, source and text."""
    def column(name, kind):
        return F.col(name) if name in hits.columns else F.lit(None).cast(kind)
    return hits.select(
        "query_id", "rank",
        F.coalesce(F.nullif(column("id", "string").cast("string"), F.lit("")),
                   column("chunk_id", "string")).alias("chunk_id"),
        column("distance", "double").alias("distance"),
        column("relevance_score", "double").alias("relevance_score"),
        column("source_id", "string").alias("source_id"),
        F.coalesce("text", F.lit("")).alias("text"))


def signature(df: DataFrame, *columns: str, name: str = "signature") -> DataFrame:
    """Adds a SHA-256 over the settings that must match before results are reused."""
    return df.withColumn(name, F.sha2(F.to_json(
        F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def pending(items: DataFrame, done: DataFrame, key: str = "question_id",
            signature_col: str | None = None) -> DataFrame:
    """Items that a matching checkpoint does not have yet."""
    on = [key, signature_col] if signature_col else [key]
    return items.join(done.select(*on), on, "left_anti")


def checkpoint_problems(items: DataFrame, done: DataFrame,
                        key: str = "question_id") -> DataFrame:
    """Checkpoint rows that forbid a resume: unknown ids and repeated ids."""
    counted = done.groupBy(key).agg(F.count("*").alias("rows"))
    unknown = counted.join(items.select(key), key, "left_anti").select(
        key, F.lit("unknown").alias("problem"))
    repeated = counted.where("rows > 1").select(key, F.lit("duplicate").alias("problem"))
    return unknown.unionAll(repeated)


def benchmark_table(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """The flat per-question summary: one column per mode and metric.

    ``questions`` carries category, expected and selected mode and the source recall.
    """
    short = {"claim_coverage": "claim_coverage", "claim_group_coverage": "claim_group_coverage",
             "prompt_tokens": "prompt_tokens", "generation_latency_ms": "latency_ms"}
    aggregates = []
    for mode in LABELS:
        here = F.col("mode") == mode
        for metric, name in short.items():
            aggregates.append(F.avg(F.when(here, F.col(metric))).alias(f"{mode}_{name}"))
            if metric != "prompt_tokens":
                aggregates.append(F.stddev_pop(F.when(here, F.col(metric)))
                                  .alias(f"{mode}_{name}_stddev"))
    wide = runs.groupBy("question_id").agg(*aggregates)
    columns = ["question_id", "category", "expected_mode", "selected_mode", "router_correct",
               "recall"]
    for name in ("claim_coverage", "claim_group_coverage"):
        columns += [f"{m}_{name}{s}" for m in LABELS for s in ("", "_stddev")]
    columns += [f"{m}_prompt_tokens" for m in LABELS]
    columns += [f"{m}_latency_ms{s}" for m in LABELS for s in ("", "_stddev")]
    return (questions.withColumn(
        "router_correct", F.col("expected_mode") == F.col("selected_mode"))
        .join(wide, "question_id").select(*columns))


