"""Queries of the passage removal, the source audit and the repair of conversations, with SQL."""

from __future__ import annotations

from ..session import read_table
from . import conversations, divergence, passages
from .queries import query

PASSAGES_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     s AS (SELECT r, unnest(range(1, len(w) - {passages.WINDOW} + 2)) AS i FROM t WHERE len(w) >= {passages.WINDOW}),
     h AS (SELECT s.r, s.i, sha256(array_to_string(t.w[s.i:s.i + {passages.WINDOW - 1}], ' ')) AS h FROM s JOIN t ON t.r = s.r),
     again AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
     gone AS (SELECT DISTINCT r, unnest(range(i, i + {passages.WINDOW})) AS i FROM h JOIN again USING (h)),
     lost AS (SELECT r, list(i) AS lost, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
       n IS NOT NULL AS has_repeats,
       sha256(coalesce(array_to_string(CASE WHEN n IS NULL THEN w
              ELSE list_filter(w, lambda x, i: NOT list_contains(lost, i)) END, ' '), '')) AS kept_sha256
FROM t LEFT JOIN lost USING (r)
"""

DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  coalesce(text, '') AS text FROM documents),
     w AS (SELECT r, lang, source, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
     lt AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term
            HAVING count(DISTINCT r) >= {divergence.LEAST_DOCUMENTS}),
     l AS (SELECT lang, count(*) AS v, sum(n_lang)::BIGINT AS total FROM lt GROUP BY lang),
     gt AS (SELECT w.lang, source, term, count(*) AS n FROM w JOIN lt USING (lang, term) GROUP BY w.lang, source, term),
     g AS (SELECT x.lang, x.source, coalesce(y.total, 0) AS total, coalesce(l.v, 0) AS v, l.total AS total_lang
           FROM (SELECT DISTINCT lang, source FROM d) x
           LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM gt GROUP BY lang, source) y
                  ON x.lang = y.lang AND x.source = y.source
           LEFT JOIN l ON l.lang = x.lang),
     p AS (SELECT g.lang, g.source, lt.term, coalesce(gt.n, 0) AS n,
                  1 + {divergence.UNIT} * (coalesce(gt.n, 0) + 1) // (g.total + g.v) AS p,
                  1 + {divergence.UNIT} * (lt.n_lang + 1) // (g.total_lang + g.v) AS q
           FROM g JOIN lt ON g.lang = lt.lang
           LEFT JOIN gt ON gt.lang = g.lang AND gt.source = g.source AND gt.term = lt.term),
     pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
               FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
                          FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) x
                      ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
     both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
                    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
                FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""


@query("op11_passage_cover", PASSAGES_SQL)
def op11_passage_cover(spark, root):
    return passages.report(read_table(spark, root, "documents"))


@query("op12_source_divergence", DIVERGENCE_SQL)
def op12_source_divergence(spark, root):
    return divergence.audit(read_table(spark, root, "documents"))


CONVERSATIONS_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tb),
     raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
     kinds AS (SELECT raw.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                   lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM raw, crc),
     hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM hurt),
     marked AS (SELECT *, left(role, 1) AS i, CASE
                     WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
                     lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) AS pair FROM placed),
     sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                     count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
              FROM marked GROUP BY conv_id),
     togo AS (SELECT conv_id, n + 1 AS k, {c: 0, a: ''} AS v0, {c: 10, a: 'II'} AS v1, {c: 5, a: 'I'} AS v2, {c: 0, a: ''} AS v3 FROM sums
              UNION ALL
              SELECT conv_id, k, list_min([b0, {c: 5 + w2.c, a: 'I' || w2.a}]), list_min([b1, {c: 5 + w2.c, a: 'I' || w2.a}]), w2, w3
              FROM (SELECT *, list_min([b2, {c: 5 + b3.c, a: 'I' || b3.a}]) AS w2, list_min([b3, {c: 5 + b2.c, a: 'I' || b2.a}]) AS w3
                    FROM (SELECT t.conv_id, m.k,
                      list_min([{c: 2 + v0.c, a: 'D' || v0.a}, CASE WHEN stay AND i = 's' THEN {c: t5 + v1.c, a: 'K' || v1.a}
                                WHEN stay AND i = 'u' THEN {c: t5 + v2.c, a: 'K' || v2.a} END,
                                CASE WHEN stay THEN {c: 1 + t5 + v2.c, a: 'R' || v2.a} END]) AS b0,
                      list_min([{c: 2 + v1.c, a: 'D' || v1.a}, CASE WHEN stay AND i = 'u' THEN {c: t5 + v2.c, a: 'K' || v2.a} END,
                                CASE WHEN stay THEN {c: 1 + t5 + v2.c, a: 'R' || v2.a} END]) AS b1,
                      list_min([{c: 2 + v2.c, a: 'D' || v2.a}, CASE WHEN stay AND i = 'a' THEN {c: t5 + v3.c, a: 'K' || v3.a} END,
                                CASE WHEN stay THEN {c: 1 + t5 + v3.c, a: 'R' || v3.a} END]) AS b2,
                      list_min([{c: 2 + v3.c, a: 'D' || v3.a}, CASE WHEN stay AND i = 'u' THEN {c: t5 + v2.c, a: 'K' || v2.a} END,
                                CASE WHEN stay THEN {c: 1 + t5 + v2.c, a: 'R' || v2.a} END]) AS b3
                    FROM togo t JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS stay,
                                             CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t5 FROM marked) m
                      ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.k = t.k - 1))),
     best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM togo WHERE k = 1),
     steps AS (SELECT conv_id, s, substr(audit, s, 1) AS letter,
                      length(regexp_replace(left(audit, s), 'I', '', 'g')) AS k,
                      length(regexp_replace(left(audit, s), 'D', '', 'g')) AS o
               FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS s FROM best)),
     kept AS (SELECT s.*, m.role, m.text, m.i FROM steps s LEFT JOIN marked m
                ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.k = s.k AND s.letter <> 'I' WHERE s.letter <> 'D'),
     led AS (SELECT *, coalesce(max(CASE WHEN o = 1 AND letter = 'K' AND i = 's' THEN 1 ELSE 0 END)
                                OVER (PARTITION BY conv_id), 0) AS led FROM kept),
     mended AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role
                         WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                         CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS body FROM led GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_conversation_repair", CONVERSATIONS_SQL)
def op13_conversation_repair(spark, root):
    turns = read_table(spark, root, "conversations")
    return conversations.report(conversations.damage(turns), turns)
