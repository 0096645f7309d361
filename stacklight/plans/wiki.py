"""Queries of concepts, evidence, reviews and annotation orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import graph as G
from stacklight.operators import lexical as L
from stacklight.operators import structured as S
from stacklight.operators import wiki as W
from stacklight.plans import duck
from stacklight.plans import graph as PG
from stacklight.plans import structured as PS
from stacklight.sources.tables import table

KEY = ["library_id", "item_key"]
WORDS = ["creep", "weld"]
CUT = "2023-01-01"


def wiki_search(spark, d):
    """Concepts by name, description and terms or by a neighbour read in the same few papers; then papers by their best concept."""
    terms = table(spark, d, "wiki_concept_terms")
    names = terms.select("concept_id", F.explode(F.array("name_en", "name_zh", "abbreviation")).alias("term")).filter("term <> ''")
    concepts = table(spark, d, "wiki_concepts").select("concept_id", F.col("canonical_name").alias("name"), F.coalesce("description", F.lit("")).alias("text"))
    r = PG._readings(spark, d)
    e = G.concept_edges(r.select(F.lit(0).alias("g"), F.col("concept_id").alias("doc"), F.concat_ws(":", *KEY).alias("c")), "g", "doc", "c", 30)
    s = table(spark, d, "wiki_concept_term_sources").filter("library_id is not null and item_key <> ''").join(terms.select("term_id", "concept_id", "confidence"), "term_id")
    depth = F.when(F.col("write_path") == "concept", 2).when(F.col("write_path") == "attach", 1).otherwise(0)
    evidence = s.select("concept_id", "library_id", F.element_at(F.split("item_key", ":"), -1).alias("item_key"), "confidence", depth.alias("depth"))
    out = W.documents_of(W.concept_scores(concepts, names, e.select("a", "b"), WORDS), evidence, KEY)
    return out.select(*KEY, F.round("score", 6).alias("score"), "concepts", "direct", F.round("confidence", 6).alias("confidence"), "depth")


def merge_target(spark, d):
    """Of each entry the concept that its names would be merged into."""
    i = table(spark, d, "wiki_concept_inputs").select("input_id", F.explode(F.array("canonical_name", "alias_text")).alias("name")).filter("name <> ''").distinct()
    t = table(spark, d, "wiki_concept_terms")
    norm = lambda c: F.lower(T.squeeze(c))
    names = t.select("concept_id", norm(F.col("name_en")).alias("term")).union(t.select("concept_id", norm(F.col("name_zh")))).filter("term <> ''").distinct()
    m = i.select(F.col("input_id").alias("key"), norm(F.col("name")).alias("term")).distinct().join(names, "term")
    return W.merge_target(m, table(spark, d, "wiki_concepts").select("concept_id", F.col("primary_term_locked").alias("locked")), G.primary_terms(t).select("concept_id", "completeness"))


def evidence_states(spark, d):
    """The state of each reading's chunk: whether its paper and its chunk are still there."""
    s = table(spark, d, "wiki_concept_term_sources").filter("library_id is not null and item_key <> ''").select("source_id", "library_id", F.element_at(F.split("item_key", ":"), -1).alias("item_key"), F.col("chunk_id_snapshot").alias("chunk_id")).distinct()
    c = L.live_chunks(table(spark, d, "chunks"))
    per = c.groupBy(*KEY).agg(F.count(F.lit(1)).alias("chunks"))
    alive = table(spark, d, "items").dropna(subset=KEY).select(*KEY).distinct().withColumn("there", F.lit(True))
    j = s.join(alive, KEY, "left").join(per, KEY, "left").join(c.select(*KEY, "chunk_id", F.lit(True).alias("hit")), [*KEY, "chunk_id"], "left")
    no = lambda x: F.coalesce(x, F.lit(False))
    state = W.evidence_state(no(F.col("there")), F.coalesce("chunks", F.lit(0)), no(F.col("hit")))
    return j.select("source_id", state.alias("state")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def review_stats(spark, d):
    """Readings by kind, and concepts whose readings have changed since a day."""
    s = table(spark, d, "wiki_concept_term_sources").join(table(spark, d, "wiki_concept_terms").select("term_id", "concept_id"), "term_id")
    row = ["source_id", "library_id", "item_key", "chunk_id_snapshot", "write_path"]
    v = W.revalidated(W.dependency(s.filter(F.col("created_at") < CUT), "concept_id", row), W.dependency(s, "concept_id", row), "concept_id")
    kinds = v.groupBy(F.col("validity").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    states = table(spark, d, "wiki_reading_sessions").distinct().groupBy(F.col("session_state").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.unionByName(states)


def scan_queue(spark, d):
    """Reading sessions as a queue of scans: what waits after a restart, and what is due."""
    s = table(spark, d, "wiki_reading_sessions").distinct()
    n = L.live_chunks(table(spark, d, "chunks")).groupBy(*KEY).agg(F.count(F.lit(1)).alias("actual"))
    kind = F.when(F.col("session_state") == "reading", "running").when(F.col("session_state") == "finished", "done").when(F.col("session_state") == "abandoned", "failed").otherwise("queued")
    q = s.join(n, KEY, "left").select("session_id", kind.alias("state"), F.pmod(F.col("delivered_batches"), F.lit(5)).alias("attempts"), F.col("total_chunks").cast("long").alias("seen"), F.col("actual"), F.col("started_at").alias("enqueued_at"))
    return W.scan_queue(q.filter("enqueued_at is not null"), F.lit(CUT).cast("timestamp")).select("session_id", "state", "after", "due", "next_at")


def item_sorts(spark, d):
    """The first twenty items by every sort key, both ways."""
    i = PS._items(spark, d)
    keys = {"date": F.coalesce(F.col("pub_year").cast("string"), F.lit("")), "title": F.lower(F.coalesce("title", F.lit(""))), "creator": F.lower(F.coalesce("publication_title", F.lit(""))), "dateAdded": F.coalesce(F.unix_micros("date_added"), F.lit(0)), "dateModified": F.coalesce(F.unix_micros("date_modified"), F.lit(0))}
    orders = {f"{n}-{way}": [c.asc() if way == "asc" else c.desc(), *[F.col(k) for k in KEY]] for n, c in keys.items() for way in ("asc", "desc")}
    return W.first_by(i, orders, 20).select("sort", "rank", *KEY)


def annotation_sorts(spark, d):
    """The first fifty notes and annotations by date, place in the text and kind; pages are counted from the number."""
    n = PS._notes(spark, d).withColumn("position", W.annotation_position(F.col("doc_id") % 300, F.col("doc_id") % 7))
    added = F.coalesce(F.unix_micros("added_at"), F.lit(0))
    orders = {"dateAdded": [added.desc(), F.col("doc_id")], "position": [F.col("position"), F.col("doc_id")], "type": [F.col("kind"), F.col("doc_id")]}
    return W.first_by(n, orders, 50).select("sort", "rank", "doc_id", "position")


def annotation_keys(spark, d):
    """Keys of notes and annotations; every second annotation stands in an attachment."""
    n = PS._notes(spark, d)
    attachment = F.when((F.col("kind") == "annotation") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("A"), F.col("doc_id").cast("string")))
    k = W.annotation_keys(F.col("doc_id").cast("string"), attachment, F.col("item_key"), F.when(F.col("kind") == "note", F.col("item_key")))
    return n.select(*[c.alias(name) for name, c in k.items()])


QUERIES = [wiki_search, merge_target, evidence_states, review_stats, scan_queue, item_sorts, annotation_sorts, annotation_keys]

_share = lambda x: f"(((CASE WHEN contains(lower({x}), 'creep') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(lower({x}), 'weld') THEN 1.0 ELSE 0 END)) / 2)::double"
_KEYS = {"date": "coalesce(pub_year::varchar, '')", "title": "lower(coalesce(title, ''))", "creator": "lower(coalesce(publication_title, ''))", "dateAdded": "coalesce(epoch_us(date_added), 0)", "dateModified": "coalesce(epoch_us(date_modified), 0)"}
_NOTES = "n AS (SELECT doc_id, lower(trim(source)) AS kind, item_key, coalesce(epoch_us(added_at), 0) AS added, (doc_id % 300) * 1000 + doc_id % 7 AS position FROM documents WHERE lower(trim(source)) IN ('note', 'annotation') AND length(text) > 0)"
_top = lambda name, o, k, src, cols: f"(SELECT '{name}' AS sort, row_number() OVER (ORDER BY {o}) AS rank, {cols} FROM {src} QUALIFY rank <= {k})"
SQL = {
    "wiki_search": f"""WITH {PG._R}, rr AS (SELECT DISTINCT 0 AS g, concept_id AS d, library_id || ':' || item_key AS c FROM r), {PG._EDGE('rr', 30)},
tm AS (SELECT concept_id, string_agg(DISTINCT n, ' ' ORDER BY n) AS terms FROM (SELECT concept_id, unnest([name_en, name_zh, abbreviation]) AS n FROM wiki_concept_terms) WHERE n <> '' GROUP BY 1),
di AS (SELECT concept_id AS node, greatest({_share("concat_ws(' ', coalesce(description, ''), canonical_name, terms)")}, {_share("coalesce(description, '')")}, {_share('canonical_name')}) AS score FROM wiki_concepts LEFT JOIN tm USING (concept_id)), dd AS (SELECT * FROM di WHERE score > 0),
al AS (SELECT node, score, 0 AS hop FROM dd UNION ALL SELECT b, dd.score * 0.72, 1 FROM ed JOIN dd ON node = a UNION ALL SELECT a, dd.score * 0.72, 1 FROM ed JOIN dd ON node = b), sc AS (SELECT node AS concept_id, round(max(score), 6) AS score, node IN (SELECT node FROM dd) AS direct FROM al GROUP BY node),
ev AS (SELECT concept_id, s.library_id, string_split(item_key, ':')[-1] AS item_key, max(confidence) AS confidence, max(CASE write_path WHEN 'concept' THEN 2 WHEN 'attach' THEN 1 ELSE 0 END) AS depth FROM wiki_concept_term_sources s JOIN wiki_concept_terms USING (term_id) WHERE s.library_id IS NOT NULL AND item_key <> '' GROUP BY ALL)
SELECT library_id, item_key, round(max(score), 6) AS score, count(*) AS concepts, count(*) FILTER (direct) AS direct, round(max(confidence), 6) AS confidence, max(depth) AS depth FROM ev JOIN sc USING (concept_id) GROUP BY ALL""",
    "merge_target": f"""WITH {PG._PT}, i AS (SELECT DISTINCT input_id AS key, {PG._n('name')} AS term FROM (SELECT input_id, unnest([canonical_name, alias_text]) AS name FROM wiki_concept_inputs) WHERE name <> ''),
t AS (SELECT concept_id, {PG._n('name_en')} AS term FROM wiki_concept_terms UNION SELECT concept_id, {PG._n('name_zh')} FROM wiki_concept_terms), y AS (SELECT key, concept_id, count(*) AS tally FROM i JOIN t USING (term) WHERE term <> '' GROUP BY ALL)
SELECT key, concept_id AS target, count(*) OVER (PARTITION BY key) AS candidates, CASE WHEN candidates > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict FROM y JOIN wiki_concepts USING (concept_id) LEFT JOIN pt USING (concept_id)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(primary_term_locked, false) DESC, tally DESC, coalesce(completeness, 0) DESC, concept_id) = 1""",
    "evidence_states": f"""WITH {duck.LIVE}, s AS (SELECT DISTINCT source_id, library_id, string_split(item_key, ':')[-1] AS item_key, chunk_id_snapshot AS chunk_id FROM wiki_concept_term_sources WHERE library_id IS NOT NULL AND item_key <> '')
SELECT CASE WHEN (library_id, item_key) NOT IN (SELECT (library_id, item_key) FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL) THEN 'source_deleted' WHEN (library_id, item_key) NOT IN (SELECT (library_id, item_key) FROM chunks_) THEN 'pending_relink'
 WHEN (library_id, item_key, chunk_id) IN (SELECT (library_id, item_key, chunk_id) FROM chunks_) THEN 'valid' ELSE 'stale' END AS state, count(*) AS n FROM s GROUP BY 1""",
    "review_stats": f"""WITH s AS (SELECT concept_id, created_at < '{CUT}' AS old FROM wiki_concept_term_sources JOIN wiki_concept_terms USING (term_id)), c AS (SELECT concept_id, count(*) AS n, count(*) FILTER (old) AS o FROM s GROUP BY 1)
SELECT CASE WHEN n = o THEN 'valid' ELSE 'needs_revalidation' END AS kind, count(*) AS n FROM c WHERE o > 0 GROUP BY 1 UNION ALL SELECT session_state, count(*) FROM (SELECT DISTINCT * FROM wiki_reading_sessions) GROUP BY 1""",
    "scan_queue": f"""WITH {duck.LIVE}, k AS (SELECT library_id, item_key, count(*) AS actual FROM chunks_ GROUP BY ALL),
q AS (SELECT session_id, CASE session_state WHEN 'reading' THEN 'running' WHEN 'finished' THEN 'done' WHEN 'abandoned' THEN 'failed' ELSE 'queued' END AS state, delivered_batches % 5 AS attempts, total_chunks AS seen, actual, started_at FROM (SELECT DISTINCT * FROM wiki_reading_sessions) LEFT JOIN k USING (library_id, item_key) WHERE started_at IS NOT NULL),
a AS (SELECT *, CASE WHEN state = 'running' OR (state = 'done' AND seen IS DISTINCT FROM actual) OR (state = 'failed' AND attempts < 3) THEN 'queued' ELSE state END AS after, floor(epoch(started_at))::bigint + (CASE WHEN state = 'failed' THEN power(2, attempts) ELSE 0 END * 60)::bigint AS next_at FROM q)
SELECT session_id, state, after, after = 'queued' AND next_at <= epoch(TIMESTAMP '{CUT}') AS due, next_at FROM a""",
    "item_sorts": f"WITH {duck.NEWEST} " + " UNION ALL ".join(_top(f"{n}-{w}", f"{c} {w}, library_id, item_key", 20, "items_", "library_id, item_key") for n, c in _KEYS.items() for w in ("asc", "desc")),
    "annotation_sorts": f"WITH {_NOTES} " + " UNION ALL ".join(_top(n, o, 50, "n", "doc_id, position") for n, o in (("dateAdded", "added DESC, doc_id"), ("position", "position, doc_id"), ("type", "kind, doc_id"))),
    "annotation_keys": f"WITH {_NOTES}, a AS (SELECT *, CASE WHEN kind = 'annotation' AND doc_id % 2 = 0 THEN 'A' || doc_id END AS attachment_key, nullif(item_key, '') AS ik FROM n), b AS (SELECT doc_id::varchar AS annotation_key, attachment_key, CASE WHEN attachment_key IS NOT NULL OR kind = 'note' THEN ik END AS source_key FROM a) SELECT *, CASE WHEN source_key IS NULL THEN CASE WHEN attachment_key IS NOT NULL THEN 'standalone_attachment' ELSE 'standalone_note' END END AS reason FROM b",
}
