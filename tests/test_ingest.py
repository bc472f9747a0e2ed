import json

import pytest
from pyspark.sql import functions as F

from evigraph.operators import evaluate, ingest, rules
from evigraph.plans import evidence
from evigraph.sources import corpus, tables


def test_read_corpus(spark, tmp_path):
    for name, body in {"chem/a.md": b"# Title\n text", "chem/deep/b.TXT": b"  plain  ",
                       "cad/c.pdf": b"no", "cad/d.md": b" \n", "else/e.txt": b"bad \xff byte"}.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    files = corpus.read_corpus(spark, str(tmp_path / "root"), domains=("chem", "cad"))
    got = {r["source"]: (r["domain"], r["extension"], r["known_domain"]) for r in files.collect()}
    assert got == {"a.md": ("chem", ".md", True), "b.TXT": ("chem", ".txt", True),
                   "d.md": ("cad", ".md", True), "e.txt": ("else", ".txt", False)}
    pages = {r["source"]: r["text"] for r in corpus.load_pages(files).collect()}
    assert pages["b.TXT"] == "plain" and pages["e.txt"] == "bad \ufffd byte"
    good, bad = corpus.load_documents(files)
    assert {r["source"] for r in good.collect()} == {"a.md", "b.TXT"}
    assert {r["source"]: r["reject_reason"] for r in bad.collect()} == {
        "d.md": "document is empty", "e.txt": "not valid UTF-8"}
    assert corpus.document_table(files).select(F.sum("page_count")).first()[0] == 4
    with pytest.raises(ValueError):
        corpus.ingest_domain(files, "other", ("chem",))
    assert corpus.ingest_domain(files, "chem", ("chem",)).count() == 2


def test_manifest_and_graph_files(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text(json.dumps([{"source_id": "s1", "url": "u"}, {"source_id": "s2", "url": "v"}]))
    assert tables.read_manifest(spark, str(path), "source_id string, url string").count() == 2
    doc = tmp_path / "graph.json"
    doc.write_text(json.dumps({"nodes": {"a": {"id": "a", "type": "t", "properties": {"domain": "d"}}},
                               "edges": [{"source": "a", "relation": "r", "target": "b", "properties": {}}]}))
    nodes, edges = tables.graph_from_json(spark, str(doc))
    assert nodes.first()["properties"] == {"domain": "d"} and edges.first()["target"] == "b"


def test_upsert_and_migration(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    got = tables.upsert_by_key(old, new, ["id"], "seq")
    assert {r["id"]: r["v"] for r in got.collect()} == {1: "a", 2: "y", 3: "z"}
    row = tables.add_missing(old, tables.JOB_DEFAULTS).first()
    assert (row["attempt"], row["max_attempts"], row["last_failure_type"]) == (0, 3, None)


def test_enrichment_stops_on_a_wrong_count(spark):
    df = spark.createDataFrame([("s", "old", None), ("s", "new", "v2"), ("t", "old", None)],
                               "source string, tool string, version string")
    updates = [("s", 2, "new", "v2")]
    report = ingest.enrich_report(df, updates, ("tool", "version"), apply=True).first()
    assert (report["records_found"], report["records_updated"], report["preflight_ok"]) == (2, 1, True)
    done = ingest.apply_enrichment(df, updates, ("tool", "version"))
    assert done.where("source = 's' AND tool = 'new' AND version = 'v2'").count() == 2
    assert done.count() == 3
    assert ingest.enrich_report(done, updates, ("tool", "version")).first()["already_current"]
    with pytest.raises(RuntimeError):
        ingest.apply_enrichment(df, [("s", 3, "new", "v2")], ("tool", "version"))


def test_rejects_and_outcome(spark):
    df = spark.createDataFrame([("t", "d", "s", "x", " Public ", "m"), (" ", "d", "s", "x", "public", "m"),
                                ("t", "d", "s", "x", "open", "m"), ("t", "d", "s", None, "private", "m")],
                               "text string, domain string, source string, subdomain string, "
                               "visibility string, document_type string")
    good, bad = ingest.split_rejects(df)
    assert good.count() == 1
    assert sorted(r["reject_reason"] for r in bad.collect()) == [
        "subdomain is blank", "text is blank", "visibility is not private or public"]
    ids = "document_sha256 string, chunk_id string"
    expected = spark.createDataFrame([("a", "a1"), ("a", "a2"), ("b", "b1"), ("c", "c1"), ("d", "d1")], ids)
    stored = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("d", "other"), ("z", "z1")], ids)
    got = {r["document_sha256"]: r["status"] for r in ingest.ingest_outcome(expected, stored).collect()}
    assert got == {"a": "resumed", "b": "duplicate", "c": "created", "d": "conflict"}
    assert [r["chunk_id"] for r in ingest.layout_conflicts(expected, stored).collect()] == ["other"]
    assert {r["chunk_id"] for r in ingest.missing_chunks(expected, stored).collect()} == {"a2", "c1", "d1"}
    ok = {r["document_sha256"]: r["verified"] for r in ingest.verify_ids(expected, stored).collect()}
    assert ok["b"] and not ok["a"] and not ok["d"] and not ok["z"]


def test_rules(spark):
    long = "x" * 3_000_000 + " password = 'abcdef'"
    df = spark.createDataFrame([("password = 'abcdef'\n",), ("a\x00b secret='12345'",), (None,), ("clean",), (long,)],
                               "text string")
    got = [(r["oversized"], r["matched_rules"]) for r in rules.scan_patterns(df, flag_over=1000).collect()]
    hit = ["credential_assignment"]
    assert got == [(False, hit), (False, hit), (False, []), (False, []), (True, hit)]
    guarded = rules.scan_patterns(df, rules=[("p", r"password\s*=", "="), ("x", "x+")]).collect()
    assert [r["matched_rules"] for r in guarded] == [["p"], [], [], [], ["p", "x"]]
    logs = spark.createDataFrame([("mode |\n   1   -7.5  0\n 2 -8.25\nx 3 -9\n",), ("",)], "text string")
    got = [(r["scores"], r["best_score"]) for r in rules.best_score(logs).collect()]
    assert got == [([-7.5, -8.25], -8.25), ([], None)]
    field = "internalField nonuniform List<vector> 2\n((1 0 0)(0 3e0 4))\n;"
    v = spark.createDataFrame([(field,)], "t string").select(rules.parse_vectors(F.col("t"))).first()[0]
    assert v == [[1.0, 0.0, 0.0], [0.0, 3.0, 4.0]]
    field = "internalField   nonuniform List<scalar> 3 (1 -2.5 1e2) ;"
    v = spark.createDataFrame([(field,)], "t string").select(rules.parse_scalars(F.col("t"))).first()[0]
    assert v == [1.0, -2.5, 100.0]
    m = spark.createDataFrame([({"QED": 0.5, "QED_drugbank_approved_percentile": 90.0, "odd": 1.0},)],
                              "metrics map<string,double>")
    row = rules.regroup_metrics(m).first()
    assert row["percentiles"] == {"QED": 90.0} and row["unclassified"] == {"odd": 1.0}
    assert row["grouped"]["physicochemical"] == {"QED": 0.5} and len(row["grouped"]) == 7
    mol = spark.createDataFrame([(500.0, 5.1, 6.0, 10.0)],
                                "molecular_weight double, log_p double, h_bond_donors double, h_bond_acceptors double")
    from evigraph import vocab
    assert rules.violations(mol, vocab.LIPINSKI_LIMITS).first()["violations"] == ["logp_gt_5", "h_bond_donors_gt_5"]


def test_scores_and_statistics(spark):
    claims = spark.createDataFrame(
        [("q", [("c1", [["RMSD", "r m s d"], ["8"]]), ("c2", [["absent"], ["stable"]])])],
        "question_id string, claims array<struct<claim_id:string,term_groups:array<array<string>>>>")
    answers = spark.createDataFrame([("q", "The R.M.S.D. is 18 and stable.")], "question_id string, answer string")
    row = evaluate.score_answers(answers, claims).first()
    assert row["claims_passed"] == ["c1"] and row["claim_groups_passed"] == ["c1:1", "c1:2", "c2:2"]
    assert (row["claim_coverage"], row["claim_group_coverage"]) == (0.5, 0.75)
    decided = spark.createDataFrame([("vector", "graph")], "expected_mode string, selected_mode string")
    got = {r["expected_mode"]: (r["vector"], r["graph"]) for r in evaluate.confusion(decided).collect()}
    assert got == {"vector": (0, 1), "graph": (0, 0)}


def test_reranked_context_text(spark):
    asked = spark.createDataFrame([("q", "what is the RMSD default?")], "query_id string, question string")
    hits = spark.createDataFrame([
        ("q", 1, "nothing here ", 0.2, "s1", 4), ("q", 2, "the default rmsd", 0.6, "s2", None),
        ("q", 3, "other", None, None, 1)],
        "query_id string, rank int, text string, distance double, source string, page int")
    text = evidence.reranked_context(asked, hits, keep=2).first()["context"]
    assert text == ("[EVIDENCE 1]\nSource: s2\nPage: unknown\nRerank score: 0.82\n"
                    "Matched query terms: ['default', 'rmsd']\nText:\nthe default rmsd\n\n"
                    "[EVIDENCE 2]\nSource: s1\nPage: 4\nRerank score: 0.24\n"
                    "Matched query terms: []\nText:\nnothing here")
