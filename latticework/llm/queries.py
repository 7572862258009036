"""The queries of this subpackage, and SQL for those that SQL can express."""

from .bpe import op4_byte_bpe
from .embeddings import op10_embedding_near_dedup
from .jaccard import op2_ngram_jaccard
from .langid import op7_language_id
from .lm import op8_lm_score
from .packing import op9_packing
from .pii import op1_pii
from .quality import op6_quality
from .secrets import op3_secrets
from .suffix import op5_suffix_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_ngram_jaccard,
        op3_secrets,
        op4_byte_bpe,
        op5_suffix_dedup,
        op6_quality,
        op7_language_id,
        op8_lm_score,
        op9_packing,
        op10_embedding_near_dedup,
    )
}

ORACLES = {
    "op2_ngram_jaccard": r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(32))] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2])) END AS g FROM t),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least_b FROM r GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_b, doc_id)) AS component_id FROM s LEFT JOIN c ON c.a = s.doc_id""",
    "op10_embedding_near_dedup": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
o AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS least_b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(least_b, vec_id)) AS component_id, least(vec_id, coalesce(least_b, vec_id)) = vec_id AS kept FROM v LEFT JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
}
