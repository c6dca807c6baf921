"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontam, divergence, gam, licenses, minhash, mixing, phrases, sharding, urls, warc


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
#: Shingles by word pairs, links by counting common ones, components by following links.
OP8_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
b AS (SELECT a.doc_id AS x, o.doc_id AS y, count(*) AS k FROM s a JOIN s o ON a.g = o.g AND a.doc_id < o.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.c + q.c - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, z) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.z),
c AS (SELECT a, min(z) AS m FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, coalesce(c.m, w.doc_id) AS component_id, coalesce(c.m, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""


def queries() -> dict:
    import corpus_pipeline

    found = [sharding.op1_sharding, divergence.op2_divergence, phrases.op3_prefix_free, decontam.op4_wu_manber, gam.op5_gam, licenses.op6_licenses, warc.op7_warc, minhash.op8_minhash, mixing.op9_raking, urls.op10_temporal]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_wu_manber": decontam.OP4_SQL, "op7_warc": warc.OP7_SQL, "op8_minhash": OP8_SQL, "op10_temporal": urls.OP10_SQL}
