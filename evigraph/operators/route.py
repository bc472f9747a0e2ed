"""Entity matching and rule-based choice between vector and graph evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text as tx
from ..session import rule_rows

MODES = ("auto", "vector", "graph")
GROUPS = ("workflow", "relationship", "boundary", "direct")
# Unicode word boundaries, and '.' that stops at a newline only.
_FLAGS = "(?Ud)"
FROM_TO = r"\bfrom\b.+\bto\b"


def _from_to(lowered):
    """``FROM_TO`` in linear time: some line has its first "from" before its last "to"."""
    word = _FLAGS + r"\bfrom\b"

    def hit(line):
        rest = F.regexp_replace(line, r"(?Uds)^.*?\bfrom\b", "")
        return line.rlike(word) & rest.rlike(_FLAGS + r"^.+\bto\b")

    return F.contains(lowered, F.lit("from")) & F.contains(lowered, F.lit("to")) & F.exists(
        F.split(lowered, "\n"), hit)


def match_entities(questions: DataFrame, aliases, words: bool = False) -> DataFrame:
    """Adds ``entity_nodes``: sorted entities with an alias inside the lower-cased question.

    Aliases match as substrings, or with ``words`` as whole words only.
    """
    pairs = rule_rows(aliases, ("entity", "alias"))
    return questions.withColumn("entity_nodes", tx.matching_names(F.lower("question"), pairs, words))


def route(questions: DataFrame, aliases=None, patterns=None, mode: str = "auto",
          words: bool = False) -> DataFrame:
    """Adds the routing decision of every question.

    ``patterns`` are (group, regex) rows with groups workflow, relationship, boundary and
    direct. Blank questions get a NULL decision and ``routing_error``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    aliases = vocab.ALIASES if aliases is None else aliases
    rows = rule_rows(vocab.ROUTE_PATTERNS if patterns is None else patterns, ("group", "pattern"))
    df = match_entities(questions, aliases, words)
    blank = tx.is_blank("question")
    df = df.withColumn("requested_mode", F.lit(mode)).withColumn(
        "routing_error", F.when(blank, F.lit("question is blank")))
    if mode != "auto":
        return (df.withColumn("selected_mode", F.when(~blank, F.lit(mode)))
                .withColumn("confidence", F.when(~blank, F.lit(1.0)))
                .withColumn("signals", F.when(~blank, F.array(F.lit("explicit_override")))))

    df = df.withColumn("_lower", F.lower("question"))
    lowered = F.col("_lower")

    def hit(group: str):
        found = F.lit(False)
        for g, pattern in rows:
            if g == group:
                if pattern == FROM_TO:
                    found = found | _from_to(lowered)
                    continue
                start = tx.leading_literal(pattern)
                one = lowered.rlike(_FLAGS + pattern)
                found = found | (F.contains(lowered, F.lit(start)) & one if start else one)
        return found

    for group in GROUPS:
        df = df.withColumn("_" + group, hit(group))
    workflow, relationship, boundary, direct = (F.col("_" + g) for g in GROUPS)
    entities = F.size("entity_nodes")
    use_graph = (boundary | (workflow & (entities >= 1))
                 | (relationship & (entities >= 2) & ~direct)
                 | ((entities >= 3) & ~direct))
    signals = F.array_compact(F.array(
        F.when(workflow, F.lit("workflow_language")),
        F.when(relationship, F.lit("relationship_language")),
        F.when(boundary, F.lit("boundary_question")),
        F.when(direct, F.lit("direct_evidence_question")),
        F.when(entities >= 2, F.lit("multiple_question_entities")),
        F.when(~use_graph & ~(workflow | relationship | boundary | direct | (entities >= 2)),
               F.lit("conservative_vector_default"))))
    confidence = (
        F.when(use_graph, F.when(boundary, 0.9).when(workflow, 0.85).otherwise(0.75))
        .when(direct, 0.85).otherwise(0.65))
    return (
        df.withColumn("selected_mode", F.when(~blank, F.when(use_graph, F.lit("graph"))
                                              .otherwise(F.lit("vector"))))
        .withColumn("confidence", F.when(~blank, confidence))
        .withColumn("signals", F.when(~blank, signals))
        .drop("_lower", *["_" + g for g in GROUPS])
    )
