"""Structured queries and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import structured as S
from stacklight.operators.ranking import ranked, score_bucket, text_bucket
from stacklight.plans import duck
from stacklight.sources.tables import table

KEY = ["library_id", "item_key"]


def _items(spark, d):
    order = Window.partitionBy(*KEY).orderBy(F.desc("date_modified"), "title")
    return table(spark, d, "items").dropna(subset=KEY).withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def field_predicates(spark, d):
    i, tests = _items(spark, d), [("title", "oxide", "contains"), ("title", "printed", "startsWith"), ("title", "晶体的影响", "endsWith"), ("abstract", "", "contains"), ("publication_title", "annals of thermal matter", "exact"), ("title", "^(hollow|dense) [a-z]+", "regex")]
    parts = [i.filter(S.matches(F.col(f), q, op)).select(*KEY, F.lit(f"{f} {op}").alias("test")) for f, q, op in tests]
    return reduce(DataFrame.unionByName, parts)


def year_range(spark, d):
    i = _items(spark, d)
    parts = [i.filter(S.year_range(F.col("pub_year"), s)).agg(F.lit(s).alias("spec"), F.count(F.lit(1)).alias("n")) for s in ("2010-2015", "2015-", "-2000", "2012")]
    return reduce(DataFrame.unionByName, parts)


def instant_range(spark, d):
    return _items(spark, d).filter(S.instant_range(F.col("date_added"), "2022-01-01", "2022-12-31")).select(*KEY)


def numeric_range(spark, d):
    return table(spark, d, "part").filter(S.numeric_range(F.col("p_size"), 10, 20) & S.numeric_range(F.col("p_retailprice"), 0, 1500)).select("p_partkey", "p_size")


def substring_fields(spark, d):
    return _items(spark, d).filter(S.matches(F.col("item_lang"), "zh") & S.matches(F.col("publication_title"), "matter")).select(*KEY)


def candidate_scan(spark, d):
    i = _items(spark, d)
    return i.filter(S.any_contains([F.col("title"), F.col("abstract"), F.array_join("tags", ", ")], ["nickel", "晶界"])).select(*KEY)


def keyword_union(spark, d):
    i = _items(spark, d)
    return i.filter(S.any_contains([F.col("title")], ["zeolite"])).select(*KEY).union(i.filter(S.any_contains([F.col("abstract")], ["membrane"])).select(*KEY)).distinct()


def _tags(spark, d):
    """The two most used tags."""
    t = _items(spark, d).select(F.explode("tags").alias("t")).groupBy(F.lower("t").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return [r["t"] for r in t.orderBy(F.desc("n"), "t").limit(2).collect()]


def tag_modes(spark, d):
    i, asked = _items(spark, d), _tags(spark, d)
    parts = [i.filter(S.tag_filter(F.col("tags"), asked, m)).select(*KEY, F.lit(m).alias("mode"), F.array_join(S.tag_hits(F.col("tags"), asked), ",").alias("matched")) for m in ("any", "all", "none")]
    return reduce(DataFrame.unionByName, parts)


def matched_tag_stats(spark, d):
    asked = _tags(spark, d)
    return _items(spark, d).select(F.explode(S.tag_hits(F.col("tags"), asked)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _relevance(spark, d):
    f = {"title": F.col("title"), "abstract": F.col("abstract"), "publicationTitle": F.col("publication_title"), "tags": F.array_join("tags", " ")}
    return _items(spark, d).withColumn("score", S.relevance(f, "oxide strength in the printed matter", ("title",), title="oxide"))


def simple_relevance(spark, d):
    return _relevance(spark, d).filter("score > 0").select(*KEY, F.round("score", 6).alias("score"))


def relevance_stats(spark, d):
    return _relevance(spark, d).filter("score > 0").agg(F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("high"), F.min("score").alias("low"))


def sort_page(spark, d):
    r = ranked(_items(spark, d), text_bucket(F.lower("title")), F.asc_nulls_last(F.lower("title")), *KEY)
    n = r.agg(F.count(F.lit(1)).alias("total"))
    return r.filter("rank > 10 and rank <= 30").join(F.broadcast(n)).select(*KEY, "rank", "total", (F.col("total") > 30).alias("has_more"))


def search_library(spark, d):
    """Predicates, tags, years, relevance, order and page in one plan."""
    r = _relevance(spark, d).filter((F.col("score") > 0) & ~F.coalesce("in_trash", F.lit(False)) & S.year_range(F.col("pub_year"), "2000-"))
    return ranked(r, score_bucket(F.col("score")), F.desc("score"), *KEY).filter("rank <= 25").select(*KEY, "rank", F.round("score", 6).alias("score"))


def item_projection(spark, d):
    return _items(spark, d).select(*KEY, F.col("pub_year").cast("string").alias("year"), T.cut_evidence(F.col("abstract")).alias("abstract"), F.array_join("tags", ", ").alias("tags"), F.coalesce("in_trash", F.lit(False)).alias("in_trash"))


def json_envelope(spark, d):
    """Rows and paging of a page of titles as one JSON text."""
    r = ranked(_items(spark, d), text_bucket(F.lower("title")), F.asc_nulls_last(F.lower("title")), *KEY)
    n = r.agg(F.count(F.lit(1)).alias("total"))
    rows = r.filter("rank <= 5").agg(F.array_sort(F.collect_list(F.struct("rank", "item_key"))).alias("rows"))  # one page
    return rows.join(n).select(F.to_json(F.struct(F.transform("rows", lambda x: x["item_key"]).alias("results"), "total", F.lit(5).alias("returned"), (F.col("total") > 5).alias("hasMore"))).alias("body"))


def _nodes(spark, d):
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    nodes = r.select(tag("r", F.col("r_regionkey")).alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(n.select(tag("n", F.col("n_nationkey")).alias("node"), tag("r", F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name")))
    return nodes, c.select(tag("n", F.col("c_nationkey")).alias("node"), F.col("c_custkey").alias("item"))


def collection_scope(spark, d):
    """Items below two regions, once each."""
    nodes, items = _nodes(spark, d)
    roots = nodes.filter("node in ('r1', 'r2')")
    return S.descendants(nodes.filter("parent is not null"), roots).join(items, "node").select("item").distinct()


def collection_browse(spark, d):
    """Own and total numbers of items of each collection."""
    nodes, items = _nodes(spark, d)
    own = items.groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    below = S.descendants(nodes.filter("parent is not null"), nodes)
    total = below.join(own, "node", "left").groupBy("root").agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"), (F.count(F.lit(1)) - 1).alias("subcollections"))
    return total.join(own.withColumnRenamed("node", "root"), "root", "left").select(F.col("root").alias("node"), F.coalesce("own", F.lit(0)).alias("own"), "total", "subcollections")


def collection_by_path(spark, d):
    """A collection resolved by its path, case aside, and the items below it; the library where that is empty or too large."""
    nodes, items = _nodes(spark, d)
    roots = nodes.filter(F.col("node").isin(*S.resolved(S.paths(nodes), "europe/Nation_3")))
    return S.scope(S.descendants(nodes.filter("parent is not null"), roots), items, items)


def quick_search(spark, d):
    """Words in title, publication or tags, a kind, a year, papers with text and with notes, not in the trash."""
    i = _items(spark, d)
    has = table(spark, d, "chunks").dropna(subset=KEY).select(*KEY).distinct()
    noted = table(spark, d, "documents").filter(F.lower(F.trim("source")).isin("note", "annotation")).dropna(subset=KEY).select(*KEY).distinct().withColumn("noted", F.lit(True))
    q = S.matches(F.col("title"), "surface") | S.matches(F.col("publication_title"), "surface") | S.matches(F.array_join("tags", ", "), "surface")
    i = i.filter(q & S.matches(F.col("item_lang"), "en", "exact") & ~F.coalesce("in_trash", F.lit(False)) & (F.col("pub_year") >= 1990))
    return i.join(has, KEY, "left_semi").join(noted, KEY, "left").select(*KEY, F.coalesce("noted", F.lit(False)).alias("noted"))


def merge_gains(spark, d):
    """What merging the exported rows of a paper moves: its documents come with the row they were added to last before."""
    i = table(spark, d, "items").dropna(subset=KEY).select(*KEY, F.unix_micros("date_modified").alias("row"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).groupBy(*KEY, "row").agg(F.max("tags").alias("tags"))
    n = i.groupBy(*KEY).agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    plan = i.join(n, KEY).select(*KEY, "row", "tags", (F.col("row") == F.col("last")).alias("master"))
    a = table(spark, d, "documents").dropna(subset=KEY).join(n, KEY).join(i.select(*KEY, "row"), KEY).filter((F.col("row") <= F.unix_micros("added_at")) | (F.col("row") < F.col("last"))).groupBy(*KEY, "doc_id").agg(F.min("row").alias("row"))
    return S.merge_gains(plan, a, KEY)


def collection_names(spark, d):
    """Collections and libraries whose name holds a word, case aside."""
    nodes, _ = _nodes(spark, d)
    return nodes.filter(S.matches(F.col("name"), "ric")).select("node", "name")


def collection_paths(spark, d):
    return S.paths(_nodes(spark, d)[0])


def name_search(spark, d):
    t = table(spark, d, "wiki_concept_terms")
    hit = t.filter(S.matches(F.col("name_en"), "creep") | S.matches(F.col("name_zh"), "蠕变") | S.matches(F.col("abbreviation"), "cc", "exact"))
    return hit.select("concept_id").distinct()


def _notes(spark, d):
    n = table(spark, d, "documents").filter(F.lower(F.trim("source")).isin("note", "annotation") & (F.length("text") > 0))
    return n.select("doc_id", F.lower(F.trim("source")).alias("kind"), "text", "added_at", *KEY)


def annotation_search(spark, d):
    """Notes and annotations that hold the query, by .7 relevance and .3 importance; age is counted from a fixed day."""
    n = _notes(spark, d)
    age = F.datediff(F.lit("2025-01-01").cast("date"), F.col("added_at").cast("date")).cast("double")
    none = F.lit(None).cast("string")
    n = n.withColumn("importance", S.importance(F.col("text"), F.col("kind"), none, F.greatest(age, F.lit(0.0)))).withColumn("relevance", S.annotation_relevance(F.col("text"), none, "surface strength"))
    n = n.filter("relevance > 0").withColumn("score", F.round(0.7 * F.col("relevance") + 0.3 * F.col("importance"), 6))
    return ranked(n, score_bucket(F.col("score")), F.desc("score"), "doc_id").filter("rank <= 100").select("doc_id", "rank", "score")


def annotation_filter(spark, d):
    n = _notes(spark, d)
    return n.filter((F.col("kind") == "annotation") & S.instant_range(F.col("added_at"), "2022-06-01", None) & S.matches(F.col("text"), "the")).select("doc_id")


def keyword_freq(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^a-z0-9\s]", " "), r"\s+")).alias("word")).filter("length(word) > 1 and word not in ('the', 'of', 'in', 'to', 'and', 'for', 'at', 'by', 'with', 'on', 'is', 'was', 'as')")
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(50)


def merge_plan(spark, d):
    """Exported rows of one paper: which stays."""
    i = table(spark, d, "items").dropna(subset=KEY)
    full = S.completeness({"title": F.col("title"), "abstract": F.col("abstract"), "publicationTitle": F.col("publication_title"), "date": F.col("pub_year"), "lang": F.col("item_lang")})
    rows = i.select(*KEY, "date_added", "date_modified", full.alias("complete"), F.coalesce(F.size("tags"), F.lit(0)).alias("collections"), F.col("date_added").alias("added"))
    return S.merge_plan(rows, KEY, ["date_modified"]).select(*KEY, F.unix_micros("date_modified").alias("modified"), "complete", "master")


def merge_summary(spark, d):
    m = merge_plan(spark, d)
    return m.agg(F.count_distinct(*KEY).alias("groups"), F.count_if(~F.col("master")).alias("trashed"))


def move_plan(spark, d):
    c = table(spark, d, "customer")
    asked = c.filter("c_custkey % 50 = 0").select("c_custkey").union(c.filter("c_custkey % 100 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey")))
    member = c.select("c_custkey", F.col("c_nationkey").alias("collection"))
    return S.move_plan(asked, c, member, 7, ["c_custkey"])


def union_docs(spark, d):
    a, b = table(spark, d, "vectors_f32").select(*KEY), table(spark, d, "chunks").select(*KEY)
    return a.union(b).dropna().distinct().agg(F.count(F.lit(1)).alias("indexed"))


def scope_intersect(spark, d):
    return table(spark, d, "vectors_f32").select(*KEY).intersect(table(spark, d, "items").select(*KEY))


def exclude_items(spark, d):
    gone = table(spark, d, "items").filter("in_trash").select(*KEY)
    return table(spark, d, "chunks").select(*KEY).distinct().join(gone, KEY, "left_anti")


def library_groups(spark, d):
    s = table(spark, d, "wiki_concept_term_sources").filter("item_key <> ''")
    lib = F.when(F.contains("item_key", F.lit(":")), F.split_part(F.col("item_key"), F.lit(":"), F.lit(1)).cast("long")).otherwise(F.col("library_id"))
    return s.groupBy(lib.alias("library")).agg(F.count_distinct(F.element_at(F.split("item_key", ":"), -1)).alias("papers"))


QUERIES = [field_predicates, year_range, instant_range, numeric_range, substring_fields, candidate_scan, keyword_union, tag_modes, matched_tag_stats, simple_relevance, relevance_stats, sort_page, search_library, item_projection, json_envelope, collection_scope, collection_browse, collection_by_path, quick_search, merge_gains, collection_names, collection_paths, name_search, annotation_search, annotation_filter, keyword_freq, merge_plan, merge_summary, move_plan, union_docs, scope_intersect, exclude_items, library_groups]

_I = f"WITH {duck.NEWEST}"
_L = lambda c: f"lower(coalesce({c}, ''))"
_TAGS = "tg AS (SELECT lower(t) AS t FROM (SELECT unnest(tags) AS t FROM items_) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2), al AS (SELECT list(t ORDER BY o) AS asked FROM (SELECT t, row_number() OVER (ORDER BY n DESC, t) AS o FROM (SELECT lower(t) AS t, count(*) AS n FROM (SELECT unnest(tags) AS t FROM items_) GROUP BY 1) QUALIFY o <= 2))"
_HIT = "h AS (SELECT i.*, list_filter(asked, lambda a: list_contains(list_transform(coalesce(tags, []::varchar[]), lambda x: lower(x)), a)) AS hit, len(asked) AS n_asked FROM items_ i, al)"
_WORDS = ("oxide", "strength", "in", "the", "printed", "matter")
_rel = " + ".join([f"CASE WHEN contains({_L(c)}, '{w}') THEN {v} ELSE 0 END" for c, v in (("title", 6.0), ("abstract", 1.5), ("publication_title", 1.2), ("array_to_string(tags, ' ')", 1.0)) for w in _WORDS] + [f"CASE WHEN contains({_L('title')}, 'oxide') THEN 6.0 ELSE 0 END"])
_REL = f"{_I}, rl AS (SELECT *, ({_rel})::double AS score FROM items_)"
_NODES = "nodes AS (SELECT 'r' || r_regionkey AS node, NULL::varchar AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation), its AS (SELECT 'n' || c_nationkey AS node, c_custkey AS item FROM customer)"
_years = lambda s, c: f"SELECT '{s}' AS spec, count(*) AS n FROM items_ WHERE pub_year IS NULL OR ({c})"
_age = "greatest(date_diff('day', added_at::date, date '2025-01-01')::double, 0)"
_rlv = "least(1.0, 0.6 * (CASE WHEN contains(lower(text), 'surface strength') THEN 1 ELSE 0 END) + 0.3 * ((CASE WHEN contains(lower(text), 'surface') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'strength') THEN 1 ELSE 0 END)) / 2)"

SQL = {
    "field_predicates": f"""{_I} SELECT library_id, item_key, 'title contains' AS test FROM items_ WHERE contains({_L('title')}, 'oxide') UNION ALL SELECT library_id, item_key, 'title startsWith' FROM items_ WHERE starts_with({_L('title')}, 'printed')
UNION ALL SELECT library_id, item_key, 'title endsWith' FROM items_ WHERE ends_with({_L('title')}, '晶体的影响') UNION ALL SELECT library_id, item_key, 'abstract contains' FROM items_ WHERE {_L('abstract')} = ''
UNION ALL SELECT library_id, item_key, 'publication_title exact' FROM items_ WHERE {_L('publication_title')} = 'annals of thermal matter' UNION ALL SELECT library_id, item_key, 'title regex' FROM items_ WHERE regexp_matches({_L('title')}, '^(hollow|dense) [a-z]+')""",
    "year_range": f"{_I} {_years('2010-2015', 'pub_year BETWEEN 2010 AND 2015')} UNION ALL {_years('2015-', 'pub_year >= 2015')} UNION ALL {_years('-2000', 'pub_year <= 2000')} UNION ALL {_years('2012', 'pub_year = 2012')}",
    "instant_range": f"{_I} SELECT library_id, item_key FROM items_ WHERE date_added::timestamptz >= timestamptz '2022-01-01 00:00:00+00' AND date_added::timestamptz <= timestamptz '2022-12-31 00:00:00+00'",
    "numeric_range": "SELECT p_partkey, p_size FROM part WHERE coalesce(p_size, 0) BETWEEN 10 AND 20 AND coalesce(p_retailprice, 0) <= 1500",
    "substring_fields": f"{_I} SELECT library_id, item_key FROM items_ WHERE contains({_L('item_lang')}, 'zh') AND contains({_L('publication_title')}, 'matter')",
    "candidate_scan": f"{_I} SELECT library_id, item_key FROM items_ WHERE " + " OR ".join(f"contains({_L(c)}, '{w}')" for c in ("title", "abstract", "array_to_string(tags, ', ')") for w in ("nickel", "晶界")),
    "keyword_union": f"{_I} SELECT library_id, item_key FROM items_ WHERE contains({_L('title')}, 'zeolite') UNION SELECT library_id, item_key FROM items_ WHERE contains({_L('abstract')}, 'membrane')",
    "tag_modes": f"{_I}, {_TAGS}, {_HIT} SELECT library_id, item_key, 'any' AS mode, array_to_string(hit, ',') AS matched FROM h WHERE len(hit) > 0 UNION ALL SELECT library_id, item_key, 'all', array_to_string(hit, ',') FROM h WHERE len(hit) = n_asked UNION ALL SELECT library_id, item_key, 'none', array_to_string(hit, ',') FROM h WHERE len(hit) = 0",
    "matched_tag_stats": f"{_I}, {_TAGS}, {_HIT} SELECT tag, count(*) AS n FROM (SELECT unnest(hit) AS tag FROM h) GROUP BY 1",
    "simple_relevance": f"{_REL} SELECT library_id, item_key, round(score, 6) AS score FROM rl WHERE score > 0",
    "relevance_stats": f"{_REL} SELECT round(avg(score), 6) AS mean, max(score) AS high, min(score) AS low FROM rl WHERE score > 0",
    "sort_page": f"{_I} SELECT library_id, item_key, rank, total, total > 30 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY lower(title) NULLS LAST, library_id, item_key) AS rank, count(*) OVER () AS total FROM items_) WHERE rank > 10 AND rank <= 30",
    "search_library": f"{_REL} SELECT library_id, item_key, row_number() OVER (ORDER BY score DESC, library_id, item_key) AS rank, round(score, 6) AS score FROM rl WHERE score > 0 AND NOT coalesce(in_trash, false) AND (pub_year IS NULL OR pub_year >= 2000) QUALIFY rank <= 25",
    "item_projection": f"{_I}, x AS (SELECT *, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS a FROM items_) SELECT library_id, item_key, pub_year::varchar AS year, CASE WHEN length(a) > 220 THEN rtrim(substr(a, 1, 220)) || '…' ELSE a END AS abstract, array_to_string(tags, ', ') AS tags, coalesce(in_trash, false) AS in_trash FROM x",
    "json_envelope": f"""{_I}, r AS (SELECT item_key, row_number() OVER (ORDER BY lower(title) NULLS LAST, library_id, item_key) AS rank, count(*) OVER () AS total FROM items_)
SELECT '{{"results":[' || string_agg('"' || item_key || '"', ',' ORDER BY rank) || '],"total":' || any_value(total) || ',"returned":5,"hasMore":' || (any_value(total) > 5)::varchar || '}}' AS body FROM r WHERE rank <= 5""",
    "collection_scope": f"WITH RECURSIVE {_NODES}, w AS (SELECT node FROM nodes WHERE node IN ('r1', 'r2') UNION SELECT n.node FROM nodes n JOIN w ON n.parent = w.node) SELECT DISTINCT item FROM w JOIN its USING (node)",
    "collection_browse": f"WITH RECURSIVE {_NODES}, w AS (SELECT node AS root, node FROM nodes UNION SELECT w.root, n.node FROM nodes n JOIN w ON n.parent = w.node), o AS (SELECT node, count(*) AS own FROM its GROUP BY 1), t AS (SELECT root, coalesce(sum(own), 0)::bigint AS total, count(*) - 1 AS subcollections FROM w LEFT JOIN o USING (node) GROUP BY 1) SELECT root AS node, coalesce(own, 0) AS own, total, subcollections FROM t LEFT JOIN o ON o.node = t.root",
    "collection_paths": f"WITH {_NODES} SELECT c.node, CASE WHEN p.node IS NULL THEN c.name ELSE p.name || '/' || c.name END AS path FROM nodes c LEFT JOIN nodes p ON c.parent = p.node",
    "name_search": "SELECT DISTINCT concept_id FROM wiki_concept_terms WHERE contains(lower(name_en), 'creep') OR contains(lower(name_zh), '蠕变') OR lower(abbreviation) = 'cc'",
    "annotation_search": f"""WITH n AS (SELECT doc_id, lower(trim(source)) AS kind, text, added_at FROM documents WHERE lower(trim(source)) IN ('note', 'annotation') AND length(text) > 0),
s AS (SELECT doc_id, {_rlv} AS rv, least(1.0, least(length(text) / 500.0, 1.0) * 0.3 + (CASE kind WHEN 'note' THEN 0.4 ELSE 0.3 END) + greatest(0, 0.1 * (1 - least({_age}, 365.0) / 365.0))) AS im FROM n),
f AS (SELECT doc_id, round(0.7 * rv + 0.3 * im, 6) AS score FROM s WHERE rv > 0) SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, score FROM f QUALIFY rank <= 100""",
    "annotation_filter": "SELECT doc_id FROM documents WHERE lower(trim(source)) = 'annotation' AND length(text) > 0 AND added_at::timestamptz >= timestamptz '2022-06-01 00:00:00+00' AND contains(lower(text), 'the')",
    "keyword_freq": "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS word FROM documents) WHERE length(word) > 1 AND word NOT IN ('the', 'of', 'in', 'to', 'and', 'for', 'at', 'by', 'with', 'on', 'is', 'was', 'as') GROUP BY 1 ORDER BY n DESC, word LIMIT 50",
    "merge_plan": """WITH c AS (SELECT *, (CASE WHEN length(title) > 0 THEN 1 ELSE 0 END) + (CASE WHEN length(abstract) > 0 THEN 3 ELSE 0 END) + (CASE WHEN length(publication_title) > 0 THEN 3 ELSE 0 END) + (CASE WHEN pub_year IS NOT NULL THEN 2 ELSE 0 END) + (CASE WHEN length(item_lang) > 0 THEN 1 ELSE 0 END) AS complete FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL)
SELECT library_id, item_key, epoch_us(date_modified) AS modified, complete, r = 1 AS master FROM (SELECT *, count(*) OVER (PARTITION BY library_id, item_key) AS n, row_number() OVER (PARTITION BY library_id, item_key ORDER BY complete DESC, coalesce(len(tags), 0) DESC, date_added NULLS LAST, date_modified) AS r FROM c) WHERE n > 1""",
    "merge_summary": "SELECT count(*) AS groups, sum(n - 1)::bigint AS trashed FROM (SELECT count(*) AS n FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY library_id, item_key HAVING count(*) > 1)",
    "move_plan": "WITH a AS (SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0 UNION SELECT c_custkey + 10000000 FROM customer WHERE c_custkey % 100 = 0) SELECT a.c_custkey, CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN c_nationkey = 7 THEN 'already' ELSE 'moves' END AS state, CASE WHEN c_nationkey <> 7 THEN 1 ELSE 0 END AS leaves FROM a LEFT JOIN customer c ON a.c_custkey = c.c_custkey",
    "union_docs": "SELECT count(*) AS indexed FROM (SELECT library_id, item_key FROM vectors_f32 UNION SELECT library_id, item_key FROM chunks) WHERE library_id IS NOT NULL AND item_key IS NOT NULL",
    "scope_intersect": "SELECT library_id, item_key FROM vectors_f32 INTERSECT SELECT library_id, item_key FROM items",
    "exclude_items": "SELECT DISTINCT c.library_id, c.item_key FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM items i WHERE in_trash AND i.library_id = c.library_id AND i.item_key = c.item_key)",
    "library_groups": "SELECT CASE WHEN contains(item_key, ':') THEN split_part(item_key, ':', 1)::bigint ELSE library_id END AS library, count(DISTINCT string_split(item_key, ':')[-1]) AS papers FROM wiki_concept_term_sources WHERE item_key <> '' GROUP BY 1",
    "collection_by_path": "SELECT DISTINCT c_custkey AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'europe' AND lower(n_name) = 'nation_3' UNION SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE lower(r_name) = 'europe' AND lower(n_name) = 'nation_3')",
    "quick_search": f"""WITH {duck.NEWEST} SELECT library_id, item_key, (library_id, item_key) IN (SELECT (library_id, item_key) FROM documents WHERE lower(trim(source)) IN ('note', 'annotation') AND library_id IS NOT NULL AND item_key IS NOT NULL) AS noted FROM items_
WHERE (contains(lower(coalesce(title, '')), 'surface') OR contains(lower(coalesce(publication_title, '')), 'surface') OR contains(lower(coalesce(array_to_string(tags, ', '), '')), 'surface')) AND lower(item_lang) = 'en' AND NOT coalesce(in_trash, false) AND pub_year >= 1990
 AND (library_id, item_key) IN (SELECT (library_id, item_key) FROM chunks WHERE library_id IS NOT NULL AND item_key IS NOT NULL)""",
    "merge_gains": """WITH i AS (SELECT library_id, item_key, epoch_us(date_modified) AS row_, max(coalesce(tags, [])) AS tags FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL GROUP BY ALL), n AS (SELECT library_id, item_key, max(row_) AS last FROM i GROUP BY ALL HAVING count(*) > 1),
p AS (SELECT i.*, row_ = last AS master FROM i JOIN n USING (library_id, item_key)), a AS (SELECT d.library_id, d.item_key, doc_id, min(row_) AS row_ FROM documents d JOIN p ON p.library_id = d.library_id AND p.item_key = d.item_key WHERE row_ <= epoch_us(added_at) OR NOT master GROUP BY ALL),
t AS (SELECT library_id, item_key, t FROM (SELECT library_id, item_key, master, unnest(tags) AS t FROM p) GROUP BY ALL HAVING NOT bool_or(master)), g AS (SELECT library_id, item_key, count(*) AS gained FROM t GROUP BY ALL), m AS (SELECT library_id, item_key, count(*) AS moved FROM a JOIN p USING (library_id, item_key, row_) WHERE NOT master GROUP BY ALL)
SELECT library_id, item_key, count(*) FILTER (NOT master) AS trashed, coalesce(any_value(moved), 0) AS moved, coalesce(any_value(gained), 0) AS gained FROM p LEFT JOIN m USING (library_id, item_key) LEFT JOIN g USING (library_id, item_key) GROUP BY ALL""",
    "collection_names": "SELECT * FROM (SELECT 'r' || r_regionkey AS node, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation) WHERE contains(lower(name), 'ric')",
}
