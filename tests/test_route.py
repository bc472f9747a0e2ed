import pytest

import re

from evigraph.operators import route


def decide(spark, text, **options):
    df = spark.createDataFrame([(text,)], "question string")
    return route.route(df, **options).first()


@pytest.mark.parametrize("text,mode,confidence", [
    ("Which command reports the RMSD of a trajectory?", "vector", 0.85),
    ("What does the RDKit toolkit offer?", "vector", 0.85),
    ("Tell me something", "vector", 0.65),
    ("How is herg related to toxicity?", "graph", 0.75),
    ("Describe the pipeline around smina", "graph", 0.85),
    ("Describe the pipeline", "vector", 0.65),
    ("Does a good docking score guarantee binding?", "graph", 0.9),
    ("Compare gromacs, rmsd and rmsf", "graph", 0.75),
    ("What is the relation: gromacs, rmsd, rmsf?", "vector", 0.85),
    ("From gromacs\nto the end", "vector", 0.65),
    ("from gromacs on to the end", "graph", 0.85)])
def test_decisions(spark, text, mode, confidence):
    row = decide(spark, text)
    assert (row["selected_mode"], row["confidence"]) == (mode, confidence)


def test_signals_entities_and_substring_aliases(spark):
    row = decide(spark, "After the heroes relate RMSD to RMSF, what is the default?")
    assert row["signals"] == ["workflow_language", "relationship_language",
                              "direct_evidence_question", "multiple_question_entities"]
    assert row["entity_nodes"] == ["rmsd", "rmsf", "rules_of_engagement"]
    assert decide(spark, "hello")["signals"] == ["conservative_vector_default"]


def test_word_boundaries_are_unicode(spark):
    assert "workflow_language" not in decide(spark, "\u00e9step by \u00e9after gromacs")["signals"]


def test_override_blank_and_bad_mode(spark):
    row = decide(spark, "anything about gromacs", mode="graph")
    assert (row["selected_mode"], row["confidence"], row["signals"]) == ("graph", 1.0, ["explicit_override"])
    assert row["entity_nodes"] == ["gromacs"]
    blank = decide(spark, " \t")
    assert blank["selected_mode"] is None and blank["routing_error"]
    with pytest.raises(ValueError):
        decide(spark, "x", mode="hybrid")


def test_many_aliases_and_whole_words(spark):
    """Fifty thousand aliases are one pass over the texts; words are an option."""
    rows = [(f"e{k % 999}", f"name{k:05d}") for k in range(50_000)] + [("roe", "roe"), ("any", "")]
    aliases = spark.createDataFrame(rows, "entity string, alias string")
    asked = spark.createDataFrame([(1, "Heroes of NAME00007 and name49999x"), (2, None), (3, "the roe.")],
                                  "query_id int, question string")
    got = {r["query_id"]: r["entity_nodes"] for r in route.match_entities(asked, aliases).collect()}
    assert got == {1: sorted({"e7", f"e{49999 % 999}", "roe", "any"}), 2: [] if got[2] == [] else None, 3: ["any", "roe"]}
    words = {r["query_id"]: r["entity_nodes"] for r in route.match_entities(asked, aliases, words=True).collect()}
    assert words[1] == sorted({"e7", "any"}) and words[3] == ["any", "roe"]


def test_from_to_in_one_line(spark):
    texts = ["from a to b", "to b from a", "from a\nto b", "x from to", "from  to", "fromage to b", "from a\nx from b to"]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "query_id int, question string")
    got = {r["query_id"]: "workflow_language" in r["signals"] for r in route.route(asked, [], [("workflow", route.FROM_TO)]).collect()}
    assert got == {k: bool(re.search(r"\bfrom\b.+\bto\b", t)) for k, t in enumerate(texts)}
