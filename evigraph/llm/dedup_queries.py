"""Queries of the deduplication operators."""

from __future__ import annotations

from ..session import read_table
from . import exact_dedup, multiset, simhash
from .queries import query

EXACT_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""


@query("op2_exact_dedup", EXACT_SQL)
def op2_exact_dedup(spark, root):
    return exact_dedup.exact_dedup(read_table(spark, root, "documents"))


@query("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, root):
    return simhash.near_duplicates(read_table(spark, root, "documents"))


@query("op6_multiset_fingerprints")
def op6_multiset_fingerprints(spark, root):
    return multiset.fingerprints_with_edits(read_table(spark, root, "documents"))
