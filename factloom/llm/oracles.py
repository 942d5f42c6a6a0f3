"""DuckDB SQL for the operators that SQL can express, by plain means.

The others can't be expressed: the encoders (2, 4, 7) and the trained models (3, 8)
for what they compute, mixing (5) for the hash that its draws come from.  Tests
hold those against brute force, round trips and held-out rows.
"""

from __future__ import annotations

from .bm25 import K1, QUERY_MODULUS, TOP, B
from .embeddings import COSINE
from .merkle import OP9_SQL
from .minhash import PERCENT, WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_OF = f"regexp_extract_all({_FOLD.format('text')}, '{_WORD}')"

OP1_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS_OF}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(1, len(w) - {WORDS} + 2), lambda i: array_to_string(w[i:i + {WORDS} - 1], ' ')) WHEN len(w) > 0 THEN ['short: ' || array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b WHERE 100 * c.n >= {PERCENT} * (x.n + y.n - c.n)),
r AS (SELECT doc_id AS i, doc_id AS c FROM documents UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.i)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT i, min(c) AS c FROM r GROUP BY i) m ON m.i = d.doc_id"""

OP6_SQL = f"""WITH d AS (SELECT doc_id, coalesce({_WORDS_OF}, []) AS w FROM documents), size AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM d),
t AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY doc_id, term), f AS (SELECT term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t CROSS JOIN size GROUP BY term),
s AS (SELECT q.doc_id AS query_id, t.doc_id, sum(f.idf * t.tf * {K1 + 1}::DOUBLE / (t.tf + {K1}::DOUBLE * ({1 - B}::DOUBLE + {B}::DOUBLE * len(d.w) / size.mean))) AS score
  FROM t q JOIN t ON t.term = q.term JOIN f ON f.term = q.term JOIN d ON d.doc_id = t.doc_id CROSS JOIN size WHERE q.doc_id % {QUERY_MODULUS} = 0 GROUP BY q.doc_id, t.doc_id),
p AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS place, doc_id, round(score, 6) AS score FROM s)
SELECT * FROM p WHERE place <= {TOP}"""

OP10_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
r AS (SELECT vec_id AS i, vec_id AS c FROM embeddings UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.i)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id, e.vec_id = m.c AS kept FROM embeddings e JOIN (SELECT i, min(c) AS c FROM r GROUP BY i) m ON m.i = e.vec_id"""

SQL = {"op1_minhash_near_duplicates": OP1_SQL, "op6_bm25_top_k": OP6_SQL, "op9_warc_fixity_audit": OP9_SQL, "op10_embedding_near_duplicates": OP10_SQL}
