"""Pattern rules, numeric limits, scores in log text and metric maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import vectors as vx
from ..session import rule_rows


def scan_patterns(df: DataFrame, text_col: str = "text", rules=None,
                  flag_over: int | None = None) -> DataFrame:
    """Adds ``matched_rules``: names of the patterns found in the text, in rule order.

    Every text is searched to its end; a null text has no matches. Rules are rows
    ``(name, pattern)`` or ``(name, pattern, guard)``: a guard is a cheap pattern that each
    match contains, and keeps the costly one away from most texts. With ``flag_over`` a column
    ``oversized`` marks texts of more bytes, which are searched all the same.
    """
    rows = [(*r, None)[:3] for r in vocab.SECRET_PATTERNS] if rules is None else \
        rule_rows(rules, ("name", "pattern")) if isinstance(rules, DataFrame) else list(rules)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def found(pattern: str, guard: str | None = None):
        return text.rlike(guard) & text.rlike(pattern) if guard else text.rlike(pattern)

    names = [F.when(found(*rest), F.lit(name)) for name, *rest in rows]
    out = df.withColumn("matched_rules", F.array_compact(F.array(*names)) if names
                        else F.array().cast("array<string>"))
    return out if flag_over is None else out.withColumn(
        "oversized", F.coalesce(F.octet_length(text_col) > flag_over, F.lit(False)))


def violations(df: DataFrame, limits, prefix: str = "") -> DataFrame:
    """Adds the names of exceeded limits (strictly greater), their count and ``passed``.

    ``limits`` are (column, limit, name) rows.
    """
    rows = rule_rows(limits, ("column", "limit", "name"))
    names = F.array_compact(F.array(*[
        F.when(F.col(c) > float(v), F.lit(n)) for c, v, n in rows]))
    return (df.withColumn(prefix + "violations", names)
            .withColumn(prefix + "violation_count", F.size(prefix + "violations"))
            .withColumn(prefix + "passed", F.size(prefix + "violations") == 0))


def best_score(df: DataFrame, text_col: str = "text",
               pattern: str = vocab.SCORE_LINE) -> DataFrame:
    """Adds the scores found in log text and the lowest one (NULL when there is none)."""
    scores = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 1),
                         lambda x: x.cast("double"))
    return df.withColumn("scores", scores).withColumn("best_score", F.array_min("scores"))


def parse_scalars(text) -> F.Column:
    """Numbers of a ``nonuniform List<scalar>`` block."""
    body = F.regexp_extract(
        text, r"(?s)internalField\s+nonuniform\s+List<scalar>\s+\d+\s*\((.*?)\)\s*;", 1)
    return F.transform(F.regexp_extract_all(body, F.lit(r"[-+0-9.eE]+"), 0),
                       lambda x: x.try_cast("double"))


def parse_vectors(text) -> F.Column:
    """Triples of a ``nonuniform List<vector>`` block."""
    number = r"[-+0-9.eE]+"
    body = F.regexp_extract(
        text, r"(?s)internalField\s+nonuniform\s+List<vector>\s+\d+\s*\((.*?)\)\s*;", 1)
    triples = F.regexp_extract_all(
        body, F.lit(rf"\(\s*({number}\s+{number}\s+{number})\s*\)"), 1)
    return F.transform(triples, lambda t: F.transform(
        F.split(t, r"\s+"), lambda x: x.try_cast("double")))


def field_stats(df: DataFrame, by: list[str], vector: str = "embedding") -> DataFrame:
    """Count, minimum, maximum and mean magnitude of a vector column per group."""
    size = vx.norm(F.col(vector))
    return df.select(*by, size.alias("_m")).groupBy(*by).agg(
        F.count("*").alias("rows"), F.min("_m").alias("minimum"),
        F.max("_m").alias("maximum"), F.avg("_m").alias("mean"))


def latest_numeric(df: DataFrame, by: list[str], name_col: str) -> DataFrame:
    """Highest numeric name per group; names that are not numbers are ignored."""
    number = F.col(name_col).try_cast("double")
    return df.where(number.isNotNull()).groupBy(*by).agg(F.max(number).alias("latest"))


def regroup_metrics(df: DataFrame, map_col: str = "metrics", groups=None,
                    suffix: str = vocab.PERCENTILE_SUFFIX) -> DataFrame:
    """Split a metric map by suffix and assign the rest to named groups.

    Adds ``percentiles``, ``grouped`` (group -> metric -> value), ``unclassified`` and counts.
    """
    rows = rule_rows(vocab.METRIC_GROUPS if groups is None else groups, ("group", "metric"))
    names = list(dict.fromkeys(g for g, _ in rows))
    known = F.array(*[F.lit(m) for _, m in rows])
    metrics = F.col(map_col)
    base = F.map_filter(metrics, lambda k, v: ~k.endswith(suffix))
    cut = -len(suffix)
    percentiles = F.transform_keys(
        F.map_filter(metrics, lambda k, v: k.endswith(suffix)),
        lambda k, v: F.substr(k, F.lit(1), F.length(k) + cut))

    def members(group):
        wanted = F.array(*[F.lit(m) for g, m in rows if g == group])
        return F.map_filter(base, lambda k, v: F.array_contains(wanted, k))

    grouped = F.create_map(*[x for g in names for x in (F.lit(g), members(g))])
    out = (df.withColumn("percentiles", percentiles).withColumn("grouped", grouped)
           .withColumn("unclassified",
                       F.map_filter(base, lambda k, v: ~F.array_contains(known, k))))
    return (out.withColumn("percentile_count", F.size("percentiles"))
            .withColumn("base_count", F.size(base))
            .withColumn("unclassified_count", F.size("unclassified")))
