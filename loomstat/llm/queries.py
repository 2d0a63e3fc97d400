"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, lang_id, line_dedup, mixing, near_dedup, periodic, quality, secret_scan, sharding, token_counts, vector_codes

QUERIES = {
    "op1_lang_id": lang_id.op1_lang_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op8_packed_blocks": mixing.op8_packed_blocks,
    "op9_quality": quality.op9_quality,
    "op10_sharding": sharding.op10_sharding,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
#: Near duplicates by the definition: all pairs that share a shingle, and what links connect.
OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT doc_id, unnest(list_distinct(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM t),
n AS (SELECT doc_id, count(s) AS n FROM t LEFT JOIN h USING (doc_id) GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
z AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, z.b FROM r JOIN z ON r.y = z.a),
g AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN g ON x = doc_id
"""
SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op5_near_dedup": OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op9_quality": quality.OP9_SQL,
    "op10_sharding": sharding.OP10_SQL,
    "op11_periodic_runs": periodic.OP11_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
}
