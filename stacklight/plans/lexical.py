"""Lexical queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import lexical as L
from stacklight.plans import duck
from stacklight.session import cut
from stacklight.sources.tables import spread, table

PROBES = [("viscosity", 1.0), ("heat-treated", 0.9), ("surface diffusion", 0.8), ("晶界", 0.7), ("β-stabilized", 0.6)]


def texts(spark: SparkSession, d: str) -> DataFrame:
    return L.field_texts(table(spark, d, "items"), spread(table(spark, d, "chunks"), "row_id"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text").filter(F.length("text") > 0), "doc_id")


def tokenize_counts(spark, d):
    return L.postings(documents(spark, d), "doc_id")


def field_lengths(spark, d):
    return L.lengths(L.postings(texts(spark, d), *L.KEY, "field"), *L.KEY, "field")


def corpus_stats(spark, d):
    t = texts(spark, d)
    n = t.agg(F.count_distinct(*L.KEY).alias("n"), F.count_distinct(*[F.when(F.col("field") == "body", F.col(k)) for k in L.KEY]).alias("n_body"))
    s = L.lengths(L.postings(t, *L.KEY, "field"), *L.KEY, "field").groupBy("field").agg(F.sum("len").alias("total"))
    return s.join(F.broadcast(n)).select("field", "n", "n_body", "total", F.round(F.col("total") / F.col("n"), 6).alias("mean_len"))


def df_terms(spark, d):
    p = texts(spark, d).select(*L.KEY, "field", F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term")).distinct()
    one = p.groupBy("term", *L.KEY).agg(F.bool_or(F.col("field") != "body").alias("m"), F.bool_or(F.col("field") == "body").alias("b"))
    return one.groupBy("term").agg(F.count_if("m").alias("df_meta"), F.count_if("b").alias("df_body"), F.count(F.lit(1)).alias("df"))


def posting_lookup(spark, d):
    return L.postings(texts(spark, d), *L.KEY, "field", "chunk_id", terms=["viscosity"])


def posting_budget(spark, d):
    asked = ["viscosity", "boundary", "the", "membrane"]
    return L.within_budget(L.postings(texts(spark, d), *L.KEY, "field", "chunk_id", terms=asked), spark.createDataFrame([(t,) for t in asked], "term string"), 2000)


def postings_conjunction(spark, d):
    place = [*L.KEY, "field", "chunk_id"]
    return L.conjunction(L.postings(texts(spark, d), *place, terms=L.asked_terms(PROBES)), L.plans(spark, PROBES), *place).drop("weight")


def phrase_verify(spark, d):
    place, t = [*L.KEY, "field", "chunk_id"], texts(spark, d)
    return L.verified(L.conjunction(L.postings(t, *place, terms=L.asked_terms(PROBES)), L.plans(spark, PROBES), *place), t, *place).select(*place, "probe", "tf")


def bm25_body_topk(spark, d, k: int = 20):
    asked = ["viscosity", "membrane", "grain"]
    terms = spark.createDataFrame([(t,) for t in asked], "term string")
    # One pass over the texts: of each the number of tokens and the few that are asked.
    tokens = T.index_tokens(F.col("text"))
    docs = cut(documents(spark, d).select("doc_id", F.size(tokens).cast("long").alias("len"), F.filter(tokens, lambda t: t.isin(asked)).alias("asked")))
    posted = docs.select("doc_id", F.explode("asked").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    size = docs.filter("len > 0").select("doc_id", "len")
    stats = size.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    hit = posted.join(F.broadcast(terms), "term")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    x = hit.join(F.broadcast(df), "term").join(size, "doc_id").join(F.broadcast(stats))
    w = L.weighted_frequency(F.col("tf"), F.col("len"), F.col("mean"), F.lit(1.4), F.lit(0.75))
    s = x.groupBy("doc_id").agg(F.round(F.sum(L.idf(F.col("n"), F.col("df")) * w / (L.K1 + w)), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    return s.orderBy(F.desc("score"), F.desc("matched"), "doc_id").limit(k)


def bm25f_two_regime(spark, d):
    return L.bm25f(texts(spark, d), PROBES)


def keyword_search(spark, d):
    """The first page of a keyword search over metadata and bodies."""
    p = L.keyword_page(bm25f_two_regime(spark, d), 20)
    return p.select(*L.KEY, "rank", "score", "normalized", "matched", "coverage")


def keyword_evidence_rows(spark, d):
    place, t = [*L.KEY, "field", "chunk_id"], texts(spark, d)
    best = L.best_evidence(L.verified(L.conjunction(L.postings(t, *place, terms=L.asked_terms(PROBES)), L.plans(spark, PROBES), *place), t, *place))
    # Texts are fetched for the winners only.
    return best.join(t.filter("field = 'body'"), [*L.KEY, "chunk_id"])


def keyword_evidence(spark, d):
    return keyword_evidence_rows(spark, d).select(*L.KEY, "chunk_id", "rank", "probes", "occurrences", T.cut_evidence(F.col("text")).alias("passage"))


def lexical_rank(spark, d):
    return L.lexical_rank(L.field_texts(table(spark, d, "items")), [("nucleation", 1.0), ("surface", 0.9), ("影响", 0.5)])


def probe_df(spark, d):
    place, t = [*L.KEY, "field", "chunk_id"], texts(spark, d)
    v = L.verified(L.conjunction(L.postings(t, *place, terms=L.asked_terms(PROBES)), L.plans(spark, PROBES), *place), t, *place)
    one = v.groupBy("probe", *L.KEY).agg(F.bool_or(F.col("field") != "body").alias("m"), F.bool_or(F.col("field") == "body").alias("b"))
    return one.groupBy("probe").agg(F.count_if("m").alias("df_meta"), F.count_if("b").alias("df_body"))


def index_report(spark, d):
    t = texts(spark, d)
    p = L.postings(t, *L.KEY, "field", "chunk_id")
    docs = t.groupBy(*L.KEY).agg(F.bool_or(F.col("field") == "body").alias("b")).agg(F.count(F.lit(1)).alias("docs"), F.count_if("b").alias("with_body"), F.count_if(~F.col("b")).alias("metadata_only"))
    terms = p.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("postings"))
    chunks = t.filter("field = 'body'").agg(F.count(F.lit(1)).alias("chunks"))
    dead = table(spark, d, "items").dropna(subset=L.KEY).agg((F.count(F.lit(1)) - F.count_distinct(*L.KEY)).alias("tombstones"))
    return docs.join(terms).join(chunks).join(dead)


def _index_docs(spark, d):
    """Every exported row of an item is a document of its own, the newest of which is alive."""
    i = table(spark, d, "items").dropna(subset=L.KEY)
    return i.select(*L.KEY, F.xxhash64(*L.KEY, "date_modified", "title").alias("h"), F.unix_micros("date_modified").alias("doc_id"), F.col("title").alias("text"))


def compact_index(spark, d):
    docs = _index_docs(spark, d).groupBy(*L.KEY, "doc_id").agg(F.min("text").alias("text"))
    docs = docs.withColumn("doc_id", F.concat_ws(":", "library_id", "item_key", F.lpad(F.col("doc_id").cast("string"), 20, "0")))
    index = L.postings(docs, "doc_id")
    return L.compact(index, docs).groupBy("term").agg(F.count(F.lit(1)).alias("postings"))


QUERIES = [tokenize_counts, field_lengths, corpus_stats, df_terms, posting_lookup, posting_budget, postings_conjunction, phrase_verify, bm25_body_topk, bm25f_two_regime, keyword_search, keyword_evidence, lexical_rank, probe_df, index_report, compact_index]


def _plans_sql(probes) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({q(k)}, {w}, {n}, {q(t)}, {len(ts)}, {str(v).lower()}, {q(ph)})" for k, w in probes for n, ts, v, ph in L.plan(k) for t in ts]
    return f"plans AS (SELECT * FROM (VALUES {', '.join(rows)}) t(probe, weight, plan_no, term, n_terms, verify, phrase))"


_MATCH = """hits AS (
  SELECT library_id, item_key, field, chunk_id, probe, weight, plan_no, verify, phrase, min(tf) AS tf
  FROM posted JOIN plans USING (term)
  GROUP BY library_id, item_key, field, chunk_id, probe, weight, plan_no, verify, phrase, n_terms HAVING count(*) = n_terms
  QUALIFY row_number() OVER (PARTITION BY library_id, item_key, field, chunk_id, probe ORDER BY plan_no) = 1
),
proved AS (
  SELECT h.* FROM hits h JOIN texts_ t USING (library_id, item_key, field, chunk_id)
  WHERE NOT verify OR contains(FOLDED, phrase)
)""".replace("FOLDED", duck.fold("t.text"))
_HITS_ALL = f"{duck.POSTED}, {_plans_sql(PROBES)}, {_MATCH}"
# Where only the asked terms count, the others go before anything is counted.
_HITS = f"{duck.TEXTS}, {_plans_sql(PROBES)}, {duck.posted_terms('(SELECT term FROM plans)')}, {_MATCH}"
_ONE = "('viscosity')"
_SIZE = "size AS (SELECT library_id, item_key, field, sum(tf) AS len FROM posted GROUP BY ALL), ns AS (SELECT count(DISTINCT (library_id, item_key)) AS n, count(DISTINCT CASE WHEN field = 'body' THEN (library_id, item_key) END) AS n_body FROM texts_)"
_PARAMS = "params AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', {a}, {b})" for f, a, b in L.FIELDS) + ") p(field, boost, b))"
_DOCS = f"posted AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({duck.index_tokens('text')}) AS term FROM documents WHERE length(text) > 0) GROUP BY ALL)"


def _strength(k: str) -> str:
    han = any(ord(c) > 0x3400 for c in k)
    n = f"least((length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)}, 4)"
    edge = "true" if han else f"regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}_]){k}(?:[^\\p{{L}}\\p{{N}}_]|$)')"
    return f"CASE WHEN {n} > 0 THEN (CASE WHEN {edge} THEN 1.0 ELSE 0.45 END) * (1 + 0.25 * ln({n})) * (CASE WHEN lower(text) = '{k}' THEN 1.25 ELSE 1.0 END) ELSE 0 END"


_LEX = " UNION ALL ".join(f"SELECT library_id, item_key, field, '{k}' AS probe, {w} AS weight, {_strength(k)} AS s FROM texts_ WHERE field <> 'body'" for k, w in (("nucleation", 1.0), ("surface", 0.9), ("影响", 0.5)))

SQL = {
    "tokenize_counts": f"WITH {_DOCS} SELECT * FROM posted",
    "field_lengths": f"WITH {duck.POSTED} SELECT library_id, item_key, field, sum(tf)::bigint AS len FROM posted GROUP BY ALL",
    "corpus_stats": f"WITH {duck.POSTED}, {_SIZE} SELECT field, any_value(n) AS n, any_value(n_body) AS n_body, sum(len)::bigint AS total, round(sum(len) / any_value(n), 6) AS mean_len FROM size, ns GROUP BY field",
    "df_terms": f"WITH {duck.POSTED}, one AS (SELECT term, library_id, item_key, bool_or(field <> 'body') AS m, bool_or(field = 'body') AS b FROM posted GROUP BY ALL) SELECT term, count(*) FILTER (m) AS df_meta, count(*) FILTER (b) AS df_body, count(*) AS df FROM one GROUP BY term",
    "posting_lookup": f"WITH {duck.TEXTS}, {duck.posted_terms(_ONE)} SELECT * FROM posted",
    "posting_budget": f"WITH {duck.POSTED}, n AS (SELECT term, count(*) AS postings FROM posted WHERE term IN ('viscosity', 'boundary', 'the', 'membrane') GROUP BY 1) SELECT term, postings, sum(postings) OVER (ORDER BY postings, term) > 2000 AS truncated FROM n",
    "postings_conjunction": f"WITH {_HITS} SELECT library_id, item_key, field, chunk_id, probe, plan_no, verify, phrase, tf FROM hits",
    "phrase_verify": f"WITH {_HITS} SELECT library_id, item_key, field, chunk_id, probe, tf FROM proved",
    "bm25_body_topk": f"""WITH {_DOCS}, size AS (SELECT doc_id, sum(tf) AS len FROM posted GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS mean FROM size),
h AS (SELECT * FROM posted WHERE term IN ('viscosity', 'membrane', 'grain')), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
w AS (SELECT doc_id, greatest(0, ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf, 1.4 * tf / (1 - 0.75 + 0.75 * len / mean) AS w FROM h JOIN f USING (term) JOIN size USING (doc_id), st)
SELECT doc_id, round(sum(idf * w / (1.2 + w)), 6) AS score, count(*) AS matched FROM w GROUP BY 1 ORDER BY score DESC, matched DESC, doc_id LIMIT 20""",
    "bm25f_two_regime": f"""WITH {_HITS_ALL}, {_SIZE}, {_PARAMS},
mean AS (SELECT field, sum(len) / any_value(n) AS mean FROM size, ns GROUP BY field),
pf AS (SELECT library_id, item_key, field, probe, weight, sum(tf) AS tf FROM proved GROUP BY ALL),
rg AS (SELECT library_id, item_key, probe, weight, field = 'body' AS body, sum(boost * tf / (1 - b + b * len / mean)) AS w FROM pf JOIN size USING (library_id, item_key, field) JOIN mean USING (field) JOIN params USING (field) GROUP BY ALL),
f AS (SELECT probe, body, count(*) AS df FROM rg GROUP BY ALL),
sc AS (SELECT library_id, item_key, round(sum(greatest(0, ln(1 + (least(df, nn) * -1 + nn + 0.5) / (least(df, nn) + 0.5))) * w / (1.2 + w) * weight), 6) AS score, count(DISTINCT probe) AS matched
  FROM (SELECT rg.*, f.df, CASE WHEN body THEN n_body ELSE n END AS nn FROM rg JOIN f USING (probe, body), ns) GROUP BY ALL)
SELECT library_id, item_key, score, matched, round(CASE WHEN score > 0 THEN score / (score + 4) ELSE 0 END, 6) AS normalized, round(least(1, matched / 5), 6) AS coverage FROM sc""",
    "keyword_evidence": f"""WITH {_HITS}, g AS (SELECT library_id, item_key, chunk_id, count(DISTINCT probe) AS probes, sum(tf)::bigint AS occurrences FROM proved WHERE field = 'body' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY library_id, item_key ORDER BY probes DESC, occurrences DESC, chunk_id) AS rank FROM g QUALIFY rank <= 3),
s AS (SELECT r.*, trim(regexp_replace(t.text, '\\s+', ' ', 'g')) AS x FROM r JOIN texts_ t ON t.field = 'body' AND t.library_id = r.library_id AND t.item_key = r.item_key AND t.chunk_id = r.chunk_id)
SELECT library_id, item_key, chunk_id, rank, probes, occurrences, CASE WHEN length(x) > 220 THEN rtrim(substr(x, 1, 220)) || '…' ELSE x END AS passage FROM s""",
    "lexical_rank": f"""WITH {duck.TEXTS}, fw AS (SELECT * FROM (VALUES {', '.join(f"('{f}', {v})" for f, v in L.LEXICAL_WEIGHTS)}) t(field, fw)),
l AS (SELECT * FROM ({_LEX}) JOIN fw USING (field) WHERE s > 0), p AS (SELECT library_id, item_key, probe, weight, sum(fw * s) AS k FROM l GROUP BY ALL),
nf AS (SELECT library_id, item_key, count(DISTINCT field) AS fields FROM l GROUP BY ALL), pool AS (SELECT count(*) AS pool FROM nf), f AS (SELECT probe, count(*) AS df FROM p GROUP BY 1),
b AS (SELECT library_id, item_key, sum(weight * least(1.0, ln(1 + pool / (1 + df)) / ln(1 + pool)) * k) AS base, count(*) AS matched FROM p JOIN f USING (probe), pool GROUP BY ALL)
SELECT library_id, item_key, round(base * (1 + 0.2 * (matched - 1)) * (1 + 0.08 * (fields - 1)), 6) AS score, matched, fields FROM b JOIN nf USING (library_id, item_key)""",
    "probe_df": f"WITH {_HITS}, one AS (SELECT probe, library_id, item_key, bool_or(field <> 'body') AS m, bool_or(field = 'body') AS b FROM proved GROUP BY ALL) SELECT probe, count(*) FILTER (m) AS df_meta, count(*) FILTER (b) AS df_body FROM one GROUP BY probe",
    "index_report": f"""WITH {duck.POSTED}, dd AS (SELECT library_id, item_key, bool_or(field = 'body') AS b FROM texts_ GROUP BY ALL)
SELECT (SELECT count(*) FROM dd) AS docs, (SELECT count(*) FROM dd WHERE b) AS with_body, (SELECT count(*) FROM dd WHERE NOT b) AS metadata_only,
 (SELECT count(DISTINCT term) FROM posted) AS terms, (SELECT count(*) FROM posted) AS postings, (SELECT count(*) FROM texts_ WHERE field = 'body') AS chunks,
 (SELECT count(*) - count(DISTINCT (library_id, item_key)) FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL) AS tombstones""",
    "compact_index": f"""WITH a AS (SELECT library_id, item_key, date_modified, min(title) AS text FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY library_id, item_key, date_modified QUALIFY row_number() OVER (PARTITION BY library_id, item_key ORDER BY date_modified DESC) = 1),
p AS (SELECT DISTINCT library_id, item_key, unnest({duck.index_tokens('text')}) AS term FROM a) SELECT term, count(*) AS postings FROM p GROUP BY term""",
}
SQL["keyword_search"] = f"SELECT library_id, item_key, row_number() OVER (ORDER BY score DESC, matched DESC, library_id, item_key) AS rank, score, normalized, matched, coverage FROM ({SQL['bm25f_two_regime']}) QUALIFY rank <= 20"
