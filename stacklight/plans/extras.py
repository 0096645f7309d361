"""Queries of small operators: attachments, colours, circuits, prefixes, keywords, batches, quotes, filtered scans, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.operators import lexical as L
from stacklight.operators import maintenance as M
from stacklight.operators import notes as N
from stacklight.operators import structured as S
from stacklight.operators import textprep as P
from stacklight.operators import vectors as V
from stacklight.plans import duck
from stacklight.plans import vectors as PV
from stacklight.sources.tables import spread, table

KEY = ["library_id", "item_key"]
NOW = 1706745600  # 2024-02-01 00:00 UTC
HEX = ("#ffd400", "#ff6666", "#5fb236", "#2ea8e5", "#a28ae5", "#e56eee", "#f19837", "#aaaaaa")


def attachment_choice(spark, d):
    """Documents as attachments of their paper: the one that can be read and isn't generated, or how many there are."""
    t = table(spark, d, "documents").dropna(subset=KEY)
    rows = t.select(*KEY, F.col("doc_id").alias("attachment"), (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("readable"), F.coalesce(F.lower(F.trim("source")) == "ocr_fulltext", F.lit(False)).alias("generated"))
    return M.attachment(rows, KEY).withColumn("attachment", F.coalesce("attachment", F.lit(-1)))


def colour_match(spark, d):
    """Annotations of a colour that is asked by name; colours are dealt by number."""
    colour = F.array(*map(F.lit, HEX))[(F.col("doc_id") % 8).cast("int")]
    return table(spark, d, "documents").select("doc_id", S.colour_matches(colour, "yellow").alias("yellow"), S.colour_matches(colour, "#FF6666").alias("red"), S.colour_name(colour).alias("name"))


def circuit_states(spark, d):
    """A branch for each user: its failures, and how long ago the last was."""
    e = table(spark, d, "events").filter("event_type = 'error'").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    g = e.groupBy("user_id").agg((F.count(F.lit(1)) % 7).alias("failures"), F.pmod(F.lit(NOW) - F.max("at"), F.lit(500)).alias("opened_for"))
    return g.select("user_id", "failures", "opened_for", M.circuit(F.col("failures"), F.col("opened_for")).alias("state"))


def longest_prefix(spark, d):
    """How much of an excerpt its chunk still has: the first half of every fiftieth chunk's opening, with a wrong ending."""
    c = table(spark, d, "chunks").filter("length(text) > 80 and row_id % 50 = 0")
    return P.table_of(c, ["row_id"], "text", lambda s: [(P.longest_prefix(s[10:40] + "\u0001" + s[40:60], s),)], "n int")


def keyword_entries(spark, d):
    """The keywords that each title would be searched by."""
    i = table(spark, d, "items").dropna(subset=[*KEY, "title"]).groupBy(*KEY).agg(F.max("title").alias("title"))
    return P.table_of(i, KEY, "title", lambda s: [(k, *x) for k, x in enumerate(N.keyword_source([], s)[1])], "k int, keyword string, weight double, origin string")


def quote_matches(spark, d):
    """Quotes from the middle of each document, spaced otherwise, found in it again."""

    def f(s):
        q = " ".join(s[len(s) // 3 : len(s) // 3 + 60].split())
        at = N.find_quote(s, q) if q else None
        return [at if at else (-1, -1)]

    docs = spread(table(spark, d, "documents").filter("length(text) between 200 and 20000"), "doc_id")
    return P.table_of(docs, ["doc_id"], "text", f, "start int, stop int")


def filtered_topk(spark, d):
    """The scan behind filters: chunks in Chinese of papers that aren't in the trash."""
    zh = L.live_chunks(table(spark, d, "chunks")).filter("chunk_lang = 'zh'").select(*KEY, "chunk_id")
    kept = table(spark, d, "items").dropna(subset=KEY).groupBy(*KEY).agg(F.bool_or(F.coalesce("in_trash", F.lit(False))).alias("t")).filter("not t").select(*KEY)
    index = PV._vectors(spark, d).join(zh, [*KEY, "chunk_id"], "left_semi").join(kept, KEY, "left_semi")
    hits = V.top_k(V.scan(index, PV._queries(spark, d), ["id"], best=50).filter("id <> query_id"), 5, "id")
    return hits.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def vector_coverage(spark, d):
    """Chunks by language with and without a usable vector, and the share that small integers hold well."""
    c = L.live_chunks(table(spark, d, "chunks")).select(*KEY, "chunk_id", F.coalesce("chunk_lang", F.lit("none")).alias("lang"))
    v = V.usable(PV._vectors(spark, d), "vector", 64)
    q, scale = V.quantize(F.col("vector"))
    back = V.cosine(F.col("vector"), F.transform(q, lambda x: x.cast("double")))
    v = v.groupBy(*KEY, "chunk_id").agg(F.bool_and(F.round(back, 9) > 0.9999).alias("fine"))
    g = c.join(v, [*KEY, "chunk_id"], "left").groupBy("lang")
    return g.agg(F.count(F.lit(1)).alias("chunks"), F.count("fine").alias("with_vector"), F.count_if("fine").alias("int8_fine"))


def body_states(spark, d):
    """Papers by the state of their text: indexed, parse_failed, not_indexed, no_source, unknown."""
    c = table(spark, d, "chunks").dropna(subset=KEY).groupBy(*KEY).agg(F.count_if(F.length("text") > 0).alias("n"))
    s = table(spark, d, "documents").dropna(subset=KEY).groupBy(*KEY).agg(F.count_if(F.length("text") > 0).alias("m"))
    i = table(spark, d, "items").select(*KEY, F.coalesce("in_trash", F.lit(False)).alias("trash")).distinct()
    i = i.groupBy(*KEY).agg(F.bool_or("trash").alias("trash")).join(c, KEY, "left").join(s, KEY, "left")
    state = F.when(F.col("library_id").isNull() | F.col("item_key").isNull() | F.col("trash"), "unknown").when(F.col("n") > 0, "indexed").when(F.col("n") == 0, "parse_failed").when(F.col("m") > 0, "not_indexed").otherwise("no_source")
    return i.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("papers"))


def listing_guard(spark, d):
    """Items by library, listed whole: an incomplete listing raises."""
    i = table(spark, d, "items").dropna(subset=KEY).select(*KEY).distinct()
    return M.assert_complete(i, 1).groupBy("library_id").agg(F.count(F.lit(1)).alias("items"))


QUERIES = [attachment_choice, colour_match, circuit_states, longest_prefix, keyword_entries, quote_matches, filtered_topk, vector_coverage, body_states, listing_guard]

_hex = "[" + ", ".join(f"'{h}'" for h in HEX) + "][doc_id % 8 + 1]"
_name = "CASE " + " ".join(f"WHEN h = '{h}' THEN '{ns[0]}'" for h, ns in S.COLOURS) + " ELSE h END"
SQL = {
    "attachment_choice": """WITH t AS (SELECT library_id, item_key, doc_id, coalesce(length(text), 0) > 0 AND coalesce(lower(trim(source)), '') <> 'ocr_fulltext' AS ok FROM documents WHERE library_id IS NOT NULL AND item_key IS NOT NULL)
SELECT library_id, item_key, count(*) FILTER (ok) AS candidates, CASE WHEN count(*) FILTER (ok) = 1 THEN min(doc_id) FILTER (ok) ELSE -1 END AS attachment FROM t GROUP BY ALL""",
    "colour_match": f"SELECT doc_id, h = '#ffd400' AS yellow, h = '#ff6666' AS red, {_name} AS name FROM (SELECT doc_id, {_hex} AS h FROM documents)",
    "circuit_states": f"""WITH e AS (SELECT user_id, count(*) % 7 AS failures, ({NOW} - max(floor(epoch(ts))::bigint)) % 500 AS o FROM events WHERE event_type = 'error' GROUP BY 1), f AS (SELECT user_id, failures, CASE WHEN o < 0 THEN o + 500 ELSE o END AS opened_for FROM e)
SELECT user_id, failures, opened_for, CASE WHEN failures < 3 THEN 'closed' WHEN opened_for < least(60 * power(2, failures - 3), 600) THEN 'open' ELSE 'half-open' END AS state FROM f""",
    "longest_prefix": "SELECT row_id, list_max(list_filter(range(0, 52), lambda k: contains(text, substr(substr(text, 11, 30) || chr(1) || substr(text, 41, 20), 1, k)))) AS n FROM chunks WHERE length(text) > 80 AND row_id % 50 = 0",
    "filtered_topk": f"""WITH {PV._OK}, {duck.LIVE}, q AS (SELECT id AS query_id, vector AS qv FROM v WHERE id % 50 = 0), f AS (SELECT * FROM v WHERE (library_id, item_key, chunk_id) IN (SELECT (library_id, item_key, chunk_id) FROM chunks_ WHERE chunk_lang = 'zh')
 AND (library_id, item_key) IN (SELECT (library_id, item_key) FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY library_id, item_key HAVING NOT bool_or(coalesce(in_trash, false)))),
h AS (SELECT query_id, id, {PV._COS} AS score FROM f AS v, q WHERE id <> query_id) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, id, round(score, 6) AS score FROM h QUALIFY rank <= 5""",
    "vector_coverage": f"""WITH {PV._OK}, {duck.LIVE}, w AS (SELECT library_id, item_key, chunk_id, {PV._Q8.format(v='vector')} AS q, vector FROM v),
f AS (SELECT library_id, item_key, chunk_id, bool_and(round({PV._DOT.format(a='vector', b='q')} / sqrt({PV._DOT.format(a='vector', b='vector')} * {PV._DOT.format(a='q', b='q')}), 9) > 0.9999) AS fine FROM w GROUP BY ALL)
SELECT coalesce(chunk_lang, 'none') AS lang, count(*) AS chunks, count(fine) AS with_vector, count(*) FILTER (fine) AS int8_fine FROM chunks_ c LEFT JOIN f ON c.library_id = f.library_id AND c.item_key = f.item_key AND c.chunk_id = f.chunk_id GROUP BY 1""",
    "body_states": """WITH c AS (SELECT library_id, item_key, count(*) FILTER (length(text) > 0) AS n FROM chunks WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY ALL), s AS (SELECT library_id, item_key, count(*) FILTER (length(text) > 0) AS m FROM documents WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY ALL),
i AS (SELECT library_id, item_key, bool_or(coalesce(in_trash, false)) AS trash FROM items GROUP BY ALL)
SELECT CASE WHEN library_id IS NULL OR item_key IS NULL OR trash THEN 'unknown' WHEN n > 0 THEN 'indexed' WHEN n = 0 THEN 'parse_failed' WHEN m > 0 THEN 'not_indexed' ELSE 'no_source' END AS state, count(*) AS papers FROM i LEFT JOIN c USING (library_id, item_key) LEFT JOIN s USING (library_id, item_key) GROUP BY 1""",
    "listing_guard": "SELECT library_id, count(DISTINCT item_key) AS items FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY 1",
}
