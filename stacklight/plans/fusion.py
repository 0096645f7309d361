"""Fusion queries and their SQL. A query is a set of keywords and a stored vector, for no model runs here."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import fusion as X
from stacklight.operators import lexical as L
from stacklight.operators import vectors as V
from stacklight.plans import graph as PG
from stacklight.plans import lexical as PL
from stacklight.plans import vectors as PV
from stacklight.sources.tables import table

KEY = L.KEY


def _keyword(spark, d):
    return L.bm25f(PL.texts(spark, d), PL.PROBES).select(*KEY, F.col("normalized").alias("score"))


def _semantic(spark, d):
    """Best chunk per document for the vectors whose id is divisible by 50, which stand for the query."""
    return V.scan(PV._vectors(spark, d), PV._queries(spark, d), KEY, per=(KEY, 1)).groupBy(*KEY).agg(F.round(F.max("score"), 6).alias("score"))


def _graph(spark, d):
    """Papers that read the concepts most read: the share of the three most read concepts a paper has."""
    r = PG._readings(spark, d)
    top = r.groupBy("concept_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "concept_id").limit(3)
    return r.join(F.broadcast(top), "concept_id").groupBy(*KEY).agg(F.round(F.count(F.lit(1)) / 3, 6).alias("score"))


def _branches(spark, d):
    return {
        "keyword": (X.admitted(_keyword(spark, d), KEY, 0.2), 1.0),
        "semantic": (X.admitted(_semantic(spark, d), KEY, 0.2), 1.0),
        "wiki": (X.admitted(_graph(spark, d), KEY, 0.3), 0.5),
    }


def rrf_fusion(spark, d):
    return X.rrf(_branches(spark, d), KEY).withColumn("rrf", F.round("rrf", 6))


def hybrid_search(spark, d):
    """The first page, with what is shown of a document fetched for its rows only."""
    p = X.first_rows(X.fused(_branches(spark, d), KEY), KEY, 0, 20)
    items = table(spark, d, "items").dropna(subset=KEY).groupBy(*KEY).agg(F.max("title").alias("t"), F.max("pub_year").cast("string").alias("y"))
    shown = X.candidate(F.col("t"), F.col("y"), F.col("rrf"), F.col("rrf"))
    return p.join(items, KEY, "left").select(*KEY, "rank", shown["rank_score"].alias("rank_score"), "matched_by", "total", "has_more", shown["title"].alias("title"), shown["year"].alias("year"))


def evidence_trim(spark, d):
    """The two best passages of each paper for a keyword query, cut to what is shown."""
    e = PL.keyword_evidence_rows(spark, d)
    g = e.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "occurrences", "text"))).alias("ps"))  # three passages at most
    p = g.select(*KEY, F.explode(X.trimmed_evidence(F.col("ps"))).alias("p"))
    return p.select(*KEY, "p.rank", "p.chunk_id", "p.occurrences", "p.text")


def single_branch(spark, d):
    """The keyword and the semantic branch, each shown alone."""
    k = L.bm25f(PL.texts(spark, d), PL.PROBES).select(*KEY, F.lit("keyword").alias("branch"), F.round(X.shown_score(F.col("score"), "keyword"), 4).alias("score"))
    return k.unionByName(_semantic(spark, d).select(*KEY, F.lit("semantic").alias("branch"), F.round(X.shown_score(F.col("score"), "semantic"), 4).alias("score")))


def page_window(spark, d):
    return X.page(X.rrf(_branches(spark, d), KEY), 40, 10).select(*KEY, "rank", "total", "has_more")


def overlap_sets(spark, d):
    b = _branches(spark, d)
    return X.overlap(b["wiki"][0], b["keyword"][0], b["semantic"][0], KEY)


def threshold_sweep(spark, d):
    """The keyword branch against papers tagged at all, at floors from 0.1 to 0.6."""
    tags = table(spark, d, "items").dropna(subset=KEY).groupBy(*KEY).agg(F.bool_or(F.coalesce(F.size("tags") > 0, F.lit(False))).alias("relevant"))
    s = tags.join(_keyword(spark, d), KEY, "left").select(F.coalesce("score", F.lit(0.0)).alias("score"), "relevant")
    return X.threshold_sweep(s, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])


QUERIES = [rrf_fusion, hybrid_search, evidence_trim, single_branch, page_window, overlap_sets, threshold_sweep]

_BM = PL.SQL["bm25f_two_regime"]
_FUSE = f"""kw0 AS (SELECT library_id, item_key, normalized AS score FROM ({_BM})),
{PV._ASK},
se0 AS (SELECT library_id, item_key, round(max({PV._COS}), 6) AS score FROM v, q GROUP BY ALL),
{PG._R}, rd AS (SELECT * FROM r),
tp AS (SELECT concept_id FROM rd GROUP BY 1 ORDER BY count(*) DESC, concept_id LIMIT 3),
wk0 AS (SELECT library_id, item_key, round(count(*) / 3, 6) AS score FROM rd JOIN tp USING (concept_id) GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (ORDER BY score DESC, library_id, item_key) AS rank FROM kw0 WHERE score >= 0.2),
se AS (SELECT *, row_number() OVER (ORDER BY score DESC, library_id, item_key) AS rank FROM se0 WHERE score >= 0.2),
wk AS (SELECT *, row_number() OVER (ORDER BY score DESC, library_id, item_key) AS rank FROM wk0 WHERE score >= 0.3),
al AS (SELECT library_id, item_key, 'keyword' AS br, 1.0::double AS w, rank FROM kw UNION ALL SELECT library_id, item_key, 'semantic', 1.0, rank FROM se UNION ALL SELECT library_id, item_key, 'wiki', 0.5, rank FROM wk),
fu AS (SELECT library_id, item_key, round(sum(w / (60 + rank)), 9) AS rrf, count(*) AS sources, min(rank) AS best_rank, string_agg(br, '+' ORDER BY br) AS matched_by FROM al GROUP BY library_id, item_key),
ra AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, sources DESC, best_rank, library_id, item_key) AS rank FROM fu)"""
SQL = {
    "rrf_fusion": f"WITH {_FUSE} SELECT library_id, item_key, round(rrf, 6) AS rrf, sources, best_rank, matched_by, rank FROM ra",
    "hybrid_search": f"""WITH {_FUSE}, it AS (SELECT library_id, item_key, max(title) AS t, max(pub_year) AS year FROM items GROUP BY ALL), ev AS (SELECT *, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS x FROM it)
SELECT library_id, item_key, rank, round(rrf, 6) AS rank_score, matched_by, (SELECT count(*) FROM ra) AS total, (SELECT count(*) FROM ra) > 20 AS has_more, CASE WHEN length(x) > 60 THEN rtrim(substr(x, 1, 60)) || '…' ELSE x END AS title, year::varchar AS year FROM ra LEFT JOIN ev USING (library_id, item_key) WHERE rank <= 20""",
    "page_window": f"WITH {_FUSE} SELECT library_id, item_key, rank, (SELECT count(*) FROM ra) AS total, (SELECT count(*) FROM ra) > 50 AS has_more FROM ra WHERE rank > 40 AND rank <= 50",
    "overlap_sets": f"""WITH {_FUSE}, g AS (SELECT DISTINCT library_id, item_key FROM wk), k AS (SELECT DISTINCT library_id, item_key FROM kw), s AS (SELECT DISTINCT library_id, item_key FROM se)
SELECT 'novel' AS part, count(*) AS n FROM (SELECT * FROM g EXCEPT (SELECT * FROM k UNION SELECT * FROM s)) UNION ALL SELECT 'with_keyword', count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM k) UNION ALL SELECT 'with_semantic', count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM s)""",
    "threshold_sweep": f"""WITH kw AS (SELECT library_id, item_key, normalized AS score FROM ({_BM})), tg AS (SELECT library_id, item_key, bool_or(coalesce(len(tags) > 0, false)) AS relevant FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY ALL),
x AS (SELECT coalesce(score, 0) AS score, relevant, unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6])::double AS threshold FROM tg LEFT JOIN kw USING (library_id, item_key)),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND relevant) AS tp, count(*) FILTER (score >= threshold AND NOT relevant) AS fp, count(*) FILTER (score < threshold AND relevant) AS fn FROM x GROUP BY 1),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT threshold, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 OR r > 0 THEN 1.25 * p * r / (0.25 * p + r) ELSE 0 END, 6) AS f_beta FROM p""",
    "evidence_trim": f"SELECT library_id, item_key, rank, chunk_id, occurrences, passage AS text FROM ({PL.SQL['keyword_evidence']}) WHERE rank <= 2",
    "single_branch": f"WITH {_FUSE} SELECT library_id, item_key, 'keyword' AS branch, round(score, 4) AS score FROM kw0 UNION ALL SELECT library_id, item_key, 'semantic', round(greatest(0, least(1, score)), 4) FROM se0",
}
