from evigraph.operators import evaluate, rerank

CLAIMS = "array<struct<claim_id:string,term_groups:array<array<string>>>>"


def test_scores_substrings_words_and_questions_without_claims(spark):
    answers = spark.createDataFrame([("a", "The heroes, here."), ("b", "No claims."), ("a", None)],
                                    "question_id string, answer string")
    claims = spark.createDataFrame([("a", [("c1", [["roe"], ["HERE!"]]), ("c2", [["heroes"]])])],
                                   f"question_id string, claims {CLAIMS}")

    def scores(**options):
        rows = evaluate.score_answers(answers, claims, **options).collect()
        return {(r["question_id"], r["answer"]): (r["claims_passed"], r["claim_coverage"]) for r in rows}

    got = scores()
    assert len(got) == 3 and got["a", "The heroes, here."] == (["c1", "c2"], 1.0)
    assert got["b", "No claims."][1] is None
    assert scores(words=True)["a", "The heroes, here."] == (["c2"], 0.5)


def test_rerank_orders_without_the_texts(spark):
    hits = spark.createDataFrame([("q", 1, 0.2, 1, "alpha beta"), ("q", 2, 0.1, 2, None), ("q", 3, 0.3, 3, "beta")],
                                 "query_id string, id int, distance double, rank int, text string")
    asked = spark.createDataFrame([("q", "alpha beta")], "query_id string, question string")
    out = rerank.rerank(asked, hits, keep=2)
    assert [(r["id"], r["text"]) for r in out.orderBy("rerank").collect()] == [(1, "alpha beta"), (3, "beta")]
    assert {r["text"] for r in rerank.rerank(asked, hits).collect()} == {"alpha beta", None, "beta"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("+- Window ["):]
    assert "text#" not in below[below.index("Project ["):].split("\n")[0].replace("_text#", "")
