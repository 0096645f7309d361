"""SQL with the same results as the queries, where SQL can express them."""

_READINGS = """
r AS (
  SELECT DISTINCT s.library_id,
    CASE WHEN starts_with(s.item_key, concat(s.library_id, ':')) THEN substr(s.item_key, length(concat(s.library_id, ':')) + 1) ELSE s.item_key END AS paper,
    t.concept_id
  FROM wiki_concept_term_sources s JOIN (SELECT DISTINCT term_id, concept_id FROM wiki_concept_terms) t USING (term_id)
  WHERE s.library_id IS NOT NULL AND s.item_key IS NOT NULL
),
v AS (SELECT * FROM r WHERE paper <> ''),
n AS (SELECT library_id, count(DISTINCT paper) AS n FROM v GROUP BY 1),
c AS (SELECT library_id, concept_id, count(*) AS k FROM v GROUP BY 1, 2),
p AS (
  SELECT x.library_id, x.concept_id AS concept_a, y.concept_id AS concept_b, count(*) AS n_ab
  FROM v x JOIN v y ON x.library_id = y.library_id AND x.paper = y.paper AND x.concept_id < y.concept_id GROUP BY 1, 2, 3
),
z AS (
  SELECT p.library_id, p.concept_a, p.concept_b, p.n_ab, a.k AS n_a, b.k AS n_b, n.n AS n_papers
  FROM p JOIN n USING (library_id)
  JOIN c a ON a.library_id = p.library_id AND a.concept_id = p.concept_a
  JOIN c b ON b.library_id = p.library_id AND b.concept_id = p.concept_b
)
"""

_TRIM = "trim(text, chr(32) || chr(9) || chr(12) || chr(13) || chr(10))"

_WINDOWS = "WITH a AS (SELECT doc_id, i, substr(text, i, 100) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 98)) AS i FROM documents WHERE length(text) >= 100)), w AS (SELECT DISTINCT doc_id, s FROM a)"

ORACLE = {
    "p2_found": f"""
SELECT row_id FROM (SELECT row_id, {_TRIM} AS t FROM chunks)
WHERE length(t) + length(regexp_replace(t, '[\\x{{0}}-\\x{{FFFF}}]', '', 'g')) > 1500
""",
    "p3_found": f"WITH {_READINGS} SELECT library_id, concept_a, concept_b FROM z WHERE n_ab >= 4 AND n_ab * n_papers >= 4 * n_a * n_b",
    "p3_pairs": f"""WITH {_READINGS} SELECT library_id, concept_a, concept_b, n_ab, n_a, n_b, n_papers,
  round(n_ab::double * n_papers::double / (n_a::double * n_b::double), 6) AS lift,
  round(CASE WHEN n_ab < n_a THEN (1 - n_b::double / n_papers::double) / (1 - n_ab::double / n_a::double) END, 6) AS conviction FROM z""",
    "p5_found": """WITH v AS (SELECT id, min(vector) AS vector FROM vectors_f32 WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY 1),
n AS (SELECT id, list_transform(vector, lambda x: x::double / sqrt(list_dot_product(vector::double[], vector::double[]))) AS u FROM v), p AS (SELECT a.id AS x, b.id AS y, list_dot_product(a.u, b.u) AS c FROM n a JOIN n b ON a.id <> b.id),
k AS (SELECT x, y FROM p WHERE c >= 0.90 QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(c, 9) DESC, y) <= 3) SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM k""",
    "p8_found": f"{_WINDOWS} SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id",
    "p8_shared": f"""{_WINDOWS}, r AS (SELECT s FROM w GROUP BY 1 HAVING count(*) > 1), c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 100)) AS p FROM a JOIN r USING (s)) GROUP BY 1),
o AS (SELECT text, min(doc_id) AS class_id FROM documents WHERE length(text) >= 100 GROUP BY 1), j AS (SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(length(text), 0)::bigint AS n_chars, coalesce(n, 0)::bigint AS shared_chars FROM documents LEFT JOIN o USING (text) LEFT JOIN c USING (doc_id))
SELECT *, CASE WHEN n_chars > 0 THEN shared_chars / n_chars ELSE 0 END AS share FROM j""",
}
