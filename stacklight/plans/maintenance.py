"""Maintenance queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import maintenance as M
from stacklight.operators.ranking import positions
from stacklight.sources.tables import table

KEY = ["library_id", "item_key"]
NOW = 1706745600  # 2024-02-01 00:00 UTC


def _mutations(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value", F.when(F.col("event_type") == "error", "delete").otherwise("refresh").alias("op"))


def refresh_coalesce(spark, d):
    return M.coalesced(_mutations(spark, d), ["user_id"], "op", "ts", "event_id").select("user_id", "operation", F.unix_micros("at").alias("queued_at"))


def refresh_drain(spark, d):
    """Every third key fails once more; attempts so far are the key's errors modulo nine."""
    q = M.coalesced(_mutations(spark, d), ["user_id"], "op", "ts", "event_id").select("user_id", "operation", (F.col("user_id") % 9).cast("int").alias("attempts"))
    return M.drained(q, F.col("user_id") % 3 == 0, F.lit(NOW).cast("long")).withColumn("next_at", F.coalesce("next_at", F.lit(-1)))


def queue_due(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("key"), (F.col("event_id") % 7).cast("int").alias("attempts"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return M.due(e.withColumn("next_at", F.col("at") + M.embed_delay(F.col("attempts"))), F.lit(1705000000), 100).select("key", "attempts", "next_at")


def change_detection(spark, d):
    """Items against the index of their chunks: version and rules by library, hash over the newest title."""
    i = table(spark, d, "items").dropna(subset=KEY).groupBy(*KEY).agg(F.max("date_modified").alias("modified"), F.max("title").alias("title"), F.min("title").alias("old"))
    c = table(spark, d, "chunks").dropna(subset=KEY).groupBy(*KEY).agg(F.max("created_at").alias("indexed_at"))
    s = i.join(c, KEY, "left")
    why = M.change({"indexed_at": F.col("indexed_at"), "version": F.when(F.col("library_id") == 4, 1).otherwise(2), "modified": F.col("modified"), "hash": F.md5("title"), "indexed_hash": F.md5("old"), "rules": F.lit("v6"), "indexed_rules": F.when(F.col("library_id") == 3, "v5").otherwise("v6"), "space": F.lit("m64"), "indexed_space": F.lit("m64")})
    return s.select(*KEY, F.coalesce(why, F.lit("unchanged")).alias("why"))


def rate_window(spark, d):
    return M.rate_window(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value"), "user_id", "ts", "value", 86400).select("event_id", "requests", F.round("tokens", 4).alias("tokens"))


def replace_diff(spark, d):
    """The first delivery of the chunks against the newest."""
    c = table(spark, d, "chunks").dropna(subset=[*KEY, "chunk_id"])
    k = [*KEY, "chunk_id"]
    old = c.filter("chunk_id % 10 <> 3").groupBy(*k).agg(F.min(F.struct("row_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))).alias("m")).select(*k, F.col("m.h").alias("h"))
    new = c.filter("chunk_id % 10 <> 7").groupBy(*k).agg(F.max(F.struct("row_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))).alias("m")).select(*k, F.col("m.h").alias("h"))
    return M.index_diff(old, new, k, "h")


def store_statistics(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy(F.coalesce("chunk_lang", F.lit("none")).alias("lang")).agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(*KEY).alias("documents"), F.count_if("enable_ocr").alias("scanned"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


def fulltext_coverage(spark, d):
    """Availability of each paper's text."""
    c = table(spark, d, "chunks").groupBy(*KEY).agg(F.count_if(F.length("text") > 0).alias("n"))
    i = table(spark, d, "items").dropna(subset=KEY).select(*KEY).distinct().join(c, KEY, "left")
    v = F.when(F.col("n").isNull(), "not_indexed").when(F.col("n") == 0, "parse_failed").otherwise("indexed")
    return i.groupBy(v.alias("availability")).agg(F.count(F.lit(1)).alias("papers"))


def source_precedence(spark, d):
    """The text that stands for a paper: full text, else supplement, else note, else abstract, the longest of its kind."""
    s = F.lower(F.trim("source"))
    rank = F.when(s == "fulltext", 1).when(s == "ocr_fulltext", 2).when(s == "supplement", 3).when(s == "note", 4).otherwise(5)
    t = table(spark, d, "documents").filter("item_key is not null and length(text) > 0").select(*KEY, "doc_id", rank.alias("p"), F.length("text").alias("n"))
    return t.groupBy(*KEY).agg(F.min(F.struct("p", (-F.col("n")).alias("n"), "doc_id")).alias("m")).select(*KEY, F.col("m.doc_id").alias("doc_id"), F.col("m.p").alias("precedence"))


def timing_summary(spark, d):
    return M.timing(table(spark, d, "events").select((F.col("value") * 10).alias("ms")), "ms")


def chunk_page(spark, d):
    """Chunks 8 to 15 of each paper by position, and the revision they belong to."""
    c = positions(table(spark, d, "chunks").dropna(subset=[*KEY, "chunk_id"]), KEY, "chunk_id", "row_id")
    return c.filter("position between 8 and 15").select(*KEY, "row_id", "position", F.sha2(T.squeeze(F.coalesce("text", F.lit(""))), 256).alias("revision"))


def build_targets(spark, d):
    """State of a resumable build by library."""
    s = table(spark, d, "wiki_reading_sessions").distinct()
    state = F.when(F.col("closed_at").isNotNull(), "succeeded").when(F.col("session_state") == "abandoned", "failed").otherwise("pending")
    return s.groupBy("library_id").agg(*[F.count_if(state == k).alias(k) for k in ("pending", "succeeded", "failed")])


def session_gaps(spark, d):
    """Pages that live 15 minutes after the last use: sessions of a user's events."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("new", (F.unix_micros(F.col("ts").cast("timestamp")) - F.coalesce(F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w), F.lit(0)) > 900_000_000).cast("int"))
    e = e.withColumn("s", F.sum("new").over(w))
    return e.groupBy("user_id", "s").agg(F.count(F.lit(1)).alias("uses")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("uses").alias("most"))


QUERIES = [refresh_coalesce, refresh_drain, queue_due, change_detection, rate_window, replace_diff, store_statistics, fulltext_coverage, source_precedence, timing_summary, chunk_page, build_targets, session_gaps]

_MU = "mu AS (SELECT event_id, user_id, ts, value, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'refresh' END AS op FROM events), co AS (SELECT user_id, op AS operation, ts AS qt FROM mu QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY op = 'delete' DESC, ts DESC, event_id DESC) = 1)"
_H = "md5(coalesce(text, ''))"
SQL = {
    "refresh_coalesce": f"WITH {_MU} SELECT user_id, operation, epoch_us(qt) AS queued_at FROM co",
    "refresh_drain": f"""WITH {_MU}, q AS (SELECT user_id, operation, (user_id % 9)::int + (CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS attempts, user_id % 3 = 0 AS failed FROM co),
s AS (SELECT *, CASE WHEN NOT failed THEN 'done' WHEN operation <> 'delete' AND attempts >= 8 THEN 'dropped' ELSE 'retry' END AS state FROM q) SELECT user_id, operation, attempts, state, CASE WHEN state = 'retry' THEN {NOW} + least(60 * pow(2, greatest(attempts - 1, 0)), 600)::bigint ELSE -1 END AS next_at FROM s""",
    "queue_due": "WITH q AS (SELECT event_id AS key, (event_id % 7)::int AS attempts, floor(epoch(ts))::bigint + ([0, 30, 120, 600, 1800, 7200])[least((event_id % 7) + 1, 6)::int] AS next_at FROM events) SELECT * FROM q WHERE next_at <= 1705000000 AND attempts < 6 ORDER BY next_at, key LIMIT 100",
    "change_detection": """WITH i AS (SELECT library_id, item_key, max(date_modified) AS m, max(title) AS t, min(title) AS o FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY ALL), c AS (SELECT library_id, item_key, max(created_at) AS x FROM chunks GROUP BY ALL)
SELECT library_id, item_key, CASE WHEN x IS NULL THEN 'new' WHEN library_id = 4 THEN 'version' WHEN m > x THEN 'modified' WHEN t <> o THEN 'content' WHEN library_id = 3 THEN 'rules' ELSE 'unchanged' END AS why FROM i LEFT JOIN c USING (library_id, item_key)""",
    "rate_window": "SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW)",
    "replace_diff": f"""WITH o AS (SELECT library_id, item_key, chunk_id, arg_min({_H}, row_id) AS o FROM chunks WHERE library_id IS NOT NULL AND item_key IS NOT NULL AND chunk_id % 10 <> 3 GROUP BY ALL), n AS (SELECT library_id, item_key, chunk_id, arg_max({_H}, row_id) AS n FROM chunks WHERE library_id IS NOT NULL AND item_key IS NOT NULL AND chunk_id % 10 <> 7 GROUP BY ALL)
SELECT library_id, item_key, chunk_id, CASE WHEN o IS NULL THEN 'insert' WHEN n IS NULL THEN 'delete' WHEN o <> n THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN n USING (library_id, item_key, chunk_id)""",
    "store_statistics": "SELECT coalesce(chunk_lang, 'none') AS lang, count(*) AS chunks, count(DISTINCT (library_id, item_key)) AS documents, count(*) FILTER (enable_ocr) AS scanned, coalesce(sum(length(text)), 0)::bigint AS chars FROM chunks GROUP BY 1",
    "fulltext_coverage": "WITH c AS (SELECT library_id, item_key, count(*) FILTER (length(text) > 0) AS n FROM chunks GROUP BY ALL), i AS (SELECT DISTINCT library_id, item_key FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL) SELECT CASE WHEN n IS NULL THEN 'not_indexed' WHEN n = 0 THEN 'parse_failed' ELSE 'indexed' END AS availability, count(*) AS papers FROM i LEFT JOIN c USING (library_id, item_key) GROUP BY 1",
    "source_precedence": "SELECT library_id, item_key, doc_id, p AS precedence FROM (SELECT *, CASE lower(trim(source)) WHEN 'fulltext' THEN 1 WHEN 'ocr_fulltext' THEN 2 WHEN 'supplement' THEN 3 WHEN 'note' THEN 4 ELSE 5 END AS p FROM documents WHERE item_key IS NOT NULL AND length(text) > 0) QUALIFY row_number() OVER (PARTITION BY library_id, item_key ORDER BY p, length(text) DESC, doc_id) = 1",
    "timing_summary": "WITH g AS (SELECT round(min(value * 10), 6) AS low, round(avg(value * 10), 6) AS mean, round(max(value * 10), 6) AS high FROM events) SELECT *, ceil(greatest(2 * high, high + 3 * (high - mean), 3000))::bigint AS allow FROM g",
    "chunk_page": "SELECT library_id, item_key, row_id, position, sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')) AS revision FROM (SELECT *, row_number() OVER (PARTITION BY library_id, item_key ORDER BY chunk_id, row_id) - 1 AS position FROM chunks WHERE library_id IS NOT NULL AND item_key IS NOT NULL AND chunk_id IS NOT NULL) WHERE position BETWEEN 8 AND 15",
    "build_targets": "WITH s AS (SELECT DISTINCT * FROM wiki_reading_sessions), x AS (SELECT library_id, CASE WHEN closed_at IS NOT NULL THEN 'succeeded' WHEN session_state = 'abandoned' THEN 'failed' ELSE 'pending' END AS k FROM s) SELECT library_id, count(*) FILTER (k = 'pending') AS pending, count(*) FILTER (k = 'succeeded') AS succeeded, count(*) FILTER (k = 'failed') AS failed FROM x GROUP BY 1",
    "session_gaps": "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER w, 0) > 900000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM e), u AS (SELECT user_id, s, count(*) AS uses FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(uses) AS most FROM u GROUP BY 1",
}
