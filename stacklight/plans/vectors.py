"""Vector queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.operators import vectors as V
from stacklight.sources.tables import spread, table

DOC = ["library_id", "item_key"]


def _vectors(spark, d):
    return spread(table(spark, d, "vectors_f32").dropna(subset=["id", *DOC, "chunk_id"]), "id")


def _queries(spark, d):
    """Searches from every usable vector whose id is divisible by 50, against all vectors."""
    return V.usable(_vectors(spark, d), "vector", 64).filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", *DOC)


def _scan(spark, d, best=None):
    return V.scan(_vectors(spark, d), _queries(spark, d), ["id", *DOC, "chunk_id"], best=best)


def cosine_topk(spark, d):
    hits = V.top_k(_scan(spark, d, 50).filter("id <> query_id"), 10, "id")
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def int8_quantize(spark, d):
    v = V.usable(_vectors(spark, d), "vector", 64)
    q, scale = V.quantize(F.col("vector"))
    v = v.select("id", q.alias("q"), scale.alias("scale"))
    return v.select("id", F.round("scale", 6).alias("scale"), F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), V.int_dot(F.col("q"), F.col("q")).alias("squares"))


def int8_cosine_topk(spark, d):
    hits = V.scan(_vectors(spark, d), _queries(spark, d), ["id"], best=50, int8=True).filter("id <> query_id")
    return V.top_k(hits, 10, "id").select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def int8_recall(spark, d):
    """Share of the float top ten that the int8 top ten holds."""
    f, i = cosine_topk(spark, d), int8_cosine_topk(spark, d)
    both = f.select("query_id", "id").join(i.select("query_id", "id"), ["query_id", "id"]).agg(F.count(F.lit(1)).alias("hit"))
    return both.join(f.agg(F.count(F.lit(1)).alias("n"))).select(F.round(F.col("hit") / F.col("n"), 6).alias("recall"))


def grouped_topk(spark, d):
    g = V.grouped_scan(_vectors(spark, d), _queries(spark, d), DOC, "id", 2, 5)
    return g.select("query_id", *DOC, "document_rank", "rank", "id", F.round("score", 6).alias("score"))


def multi_query_topk(spark, d):
    return V.scan_documents(_vectors(spark, d), _queries(spark, d), DOC, 3, "id", digits=6).select("query_id", *DOC, "rank", "id", "score")


def find_similar(spark, d):
    """Documents similar to each snapshot's paper, at or above the snapshot's floor, twenty a page; the paper itself is left out."""
    s = table(spark, d, "similar_snapshots").select(F.col("snapshot_id").alias("search"), *DOC, F.col("applied_min_score").alias("floor"), "query_chunk_ids")
    asked = s.select("search", *DOC, F.explode("query_chunk_ids").alias("chunk_id")).distinct()
    v = V.usable(_vectors(spark, d), "vector", 64)
    one = v.join(asked.select(*DOC, "chunk_id").distinct(), [*DOC, "chunk_id"]).groupBy(*DOC, "chunk_id").agg(F.min("id").alias("query_id"), F.min_by("vector", "id").alias("vector"))
    floors = s.groupBy("search").agg(F.min("floor").alias("floor"))
    of = asked.join(one, [*DOC, "chunk_id"]).select("search", "query_id", "vector", *[F.col(c).alias(f"own_{c}") for c in DOC]).join(floors, "search")
    out = V.similar_scan(_vectors(spark, d), of, DOC, "chunk_id", "id")
    return out.select(F.col("search").alias("snapshot_id"), *DOC, "score", "matched", "best_chunk", "evidence", "rank", (F.floor((F.col("rank") - 1) / 20) + 1).alias("page"))


def scan_score_stats(spark, d):
    return V.scan_stats(_vectors(spark, d), _queries(spark, d))


def dimension_guard(spark, d):
    """Rows of each dimension, and whether a scan of 64 may read them."""
    v = table(spark, d, "vectors_f32")
    g = v.groupBy(F.when(F.col("vector").isNull(), -1).otherwise(F.size("vector")).alias("dimension")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("fits", F.col("dimension") == 64)


def embedding_groups(spark, d):
    """The two best rows of each label for every vector whose id is divisible by 50."""
    e = table(spark, d, "embeddings")
    q = V.usable(e, "embedding", 64).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = V.scan(e, q, ["vec_id", "label"], "embedding", per=(["label"], 2))
    return V.top_k(hits, 2, "vec_id", ["query_id", "label"]).select("query_id", "label", "rank", "vec_id", F.round("score", 6).alias("score"))


QUERIES = [cosine_topk, int8_quantize, int8_cosine_topk, int8_recall, grouped_topk, multi_query_topk, find_similar, scan_score_stats, dimension_guard, embedding_groups]

_DOT = "list_dot_product({a}::double[], {b}::double[])"
_OK = "v AS (SELECT * FROM vectors_f32 WHERE id IS NOT NULL AND library_id IS NOT NULL AND item_key IS NOT NULL AND chunk_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
_ASK = f"{_OK}, q AS (SELECT id AS query_id, vector AS qv, library_id AS ql, item_key AS qi FROM v WHERE id % 50 = 0)"
_COS = f"round({_DOT.format(a='qv', b='vector')} / (sqrt({_DOT.format(a='qv', b='qv')}) * sqrt({_DOT.format(a='vector', b='vector')})), 12)"
_H = f"{_ASK}, h AS (SELECT query_id, id, library_id, item_key, chunk_id, {_COS} AS score FROM v, q)"
_Q8 = "list_transform({v}, lambda x: floor(x::double * (127.0 / list_max(list_transform({v}, lambda y: abs(y::double)))) + 0.5)::bigint)"
_I = f"{_ASK}, v8 AS (SELECT id, {_Q8.format(v='vector')} AS a FROM v), q8 AS (SELECT query_id, {_Q8.format(v='qv')} AS b FROM q), i AS (SELECT query_id, id, round(list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) / sqrt((list_sum(list_transform(a, lambda z: z * z)) * list_sum(list_transform(b, lambda z: z * z)))::double), 12) AS score FROM v8, q8 WHERE id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"
_F = "f AS (SELECT query_id, id, score FROM h WHERE id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"

SQL = {
    "cosine_topk": f"WITH {_H} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM h WHERE id <> query_id QUALIFY rank <= 10",
    "int8_quantize": f"WITH {_OK}, a AS (SELECT id, 127.0 / list_max(list_transform(vector, lambda y: abs(y::double))) AS scale, {_Q8.format(v='vector')} AS q FROM v) SELECT id, round(scale, 6) AS scale, list_sum(q)::bigint AS total, list_sum(list_transform(q, lambda z: z * z))::bigint AS squares FROM a",
    "int8_cosine_topk": f"WITH {_I} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM i",
    "int8_recall": f"WITH {_I}, h AS (SELECT query_id, id, {_COS} AS score FROM v, q), {_F} SELECT round((SELECT count(*) FROM f JOIN i USING (query_id, id)) / (SELECT count(*) FROM f), 6) AS recall",
    "grouped_topk": f"""WITH {_H}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, library_id, item_key ORDER BY score DESC, id) AS rank FROM h QUALIFY rank <= 2),
b AS (SELECT query_id, library_id, item_key, max(score) AS best FROM k GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best DESC, library_id, item_key) AS document_rank FROM b QUALIFY document_rank <= 5)
SELECT query_id, library_id, item_key, document_rank, rank, id, round(score, 6) AS score FROM k JOIN c USING (query_id, library_id, item_key)""",
    "multi_query_topk": f"WITH {_H} SELECT query_id, library_id, item_key, row_number() OVER (PARTITION BY query_id, library_id, item_key ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM h QUALIFY rank <= 3",
    "find_similar": f"""WITH {_OK}, s AS (SELECT DISTINCT snapshot_id, library_id, item_key, applied_min_score AS floor FROM similar_snapshots), asked AS (SELECT DISTINCT snapshot_id, library_id, item_key, unnest(query_chunk_ids) AS chunk_id FROM similar_snapshots),
q AS (SELECT snapshot_id, library_id AS ql, item_key AS qi, min(id) AS query_id, arg_min(vector, id) AS qv FROM v JOIN asked USING (library_id, item_key, chunk_id) GROUP BY snapshot_id, library_id, item_key, chunk_id),
u AS (SELECT DISTINCT query_id, qv, ql, qi FROM q),
h0 AS (SELECT query_id, id, library_id, item_key, chunk_id, {_COS} AS score FROM v, u WHERE NOT (ql = library_id AND qi = item_key) QUALIFY row_number() OVER (PARTITION BY query_id, library_id, item_key ORDER BY score DESC, id) <= 3),
h AS (SELECT snapshot_id, query_id, id, library_id, item_key, chunk_id, greatest(0, least(1, score)) AS s FROM h0 JOIN q USING (query_id)),
t AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY snapshot_id, query_id, library_id, item_key ORDER BY s DESC, chunk_id) <= 2),
p AS (SELECT snapshot_id, query_id, library_id, item_key, avg(s) AS a FROM t GROUP BY ALL), nq AS (SELECT snapshot_id, count(*) AS n FROM q GROUP BY 1),
d AS (SELECT snapshot_id, library_id, item_key, greatest(0, least(1, round(0.75 * sum(a) / any_value(n) + 0.25 * max(a), 6))) AS score, count(*) FILTER (a > 0) AS matched FROM p JOIN nq USING (snapshot_id) GROUP BY ALL),
c AS (SELECT snapshot_id, library_id, item_key, chunk_id, max(s) AS s FROM h GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, library_id, item_key ORDER BY s DESC, chunk_id) AS r FROM c QUALIFY r <= 5),
f AS (SELECT snapshot_id, library_id, item_key, any_value(score) AS score, any_value(matched) AS matched, round(max(s), 6) AS best_chunk, string_agg(chunk_id::varchar, ',' ORDER BY r) AS evidence FROM d JOIN e USING (snapshot_id, library_id, item_key) GROUP BY ALL)
SELECT snapshot_id, library_id, item_key, score, matched, best_chunk, evidence, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, best_chunk DESC, library_id, item_key) AS rank, (rank - 1) // 20 + 1 AS page FROM f JOIN (SELECT snapshot_id, min(floor) AS floor FROM s GROUP BY 1) USING (snapshot_id) WHERE score >= coalesce(floor, 0)""",
    "scan_score_stats": f"WITH {_H} SELECT query_id, round(min(score), 6) AS low, round(max(score), 6) AS high, round(avg(score), 6) AS mean, count(*) AS n FROM h GROUP BY 1",
    "dimension_guard": "SELECT CASE WHEN vector IS NULL THEN -1 ELSE len(vector) END AS dimension, count(*) AS n, dimension = 64 AS fits FROM vectors_f32 GROUP BY 1",
    "embedding_groups": f"WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0), h AS (SELECT query_id, vec_id, label, {_COS.replace('vector', 'embedding')} AS score FROM embeddings, q) SELECT query_id, label, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score FROM h QUALIFY rank <= 2",
}
