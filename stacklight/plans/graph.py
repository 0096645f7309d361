"""Graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import graph as G
from stacklight.operators import lexical as L
from stacklight.operators import links as K
from stacklight.operators import vectors as V
from stacklight.plans import duck
from stacklight.plans import textprep as PT
from stacklight.plans import vectors as PV
from stacklight.sources.tables import table

KEY = ["library_id", "item_key"]


def _readings(spark, d):
    s = table(spark, d, "wiki_concept_term_sources").filter("library_id is not null and item_key <> ''")
    paper = F.element_at(F.split("item_key", ":"), -1)
    return s.join(table(spark, d, "wiki_concept_terms").select("term_id", "concept_id"), "term_id").select("library_id", paper.alias("item_key"), "concept_id").distinct()


def concept_edges(spark, d):
    e = G.concept_edges(_readings(spark, d), "library_id", "item_key", "concept_id")
    return e.select(F.col("g").alias("library_id"), "a", "b", "score", "shared", "strength")


def concept_edges_orders(spark, d):
    """The same over orders and the parts they hold."""
    r = table(spark, d, "lineitem").select(F.lit(1).alias("g"), "l_orderkey", "l_partkey")
    return G.concept_edges(r, "g", "l_orderkey", "l_partkey", 40).filter("shared >= 2").select("a", "b", "score", "shared")


def shared_rare_terms(spark, d):
    pairs = G.concept_edges(_readings(spark, d), "library_id", "item_key", "concept_id").select("g", "a", "b")
    texts = L.live_chunks(table(spark, d, "chunks")).filter(F.length("text") > 0).select(F.col("library_id").alias("g"), F.col("item_key").alias("d"), "chunk_id", "text")
    return G.shared_rare_terms(pairs, texts)


def usable_terms(spark, d):
    t = table(spark, d, "documents").select(F.explode(T.query_tokens(F.col("text"))).alias("t")).distinct()
    return t.filter(G.usable_term(F.col("t")))


def graph_links(spark, d):
    """Edges between papers with the most specific concept they share."""
    r, e = _readings(spark, d), G.concept_edges(_readings(spark, d), "library_id", "item_key", "concept_id")
    df = r.groupBy("library_id", "concept_id").agg(F.count(F.lit(1)).alias("df"))
    x = e.join(r.select(F.col("library_id").alias("g"), F.col("item_key").alias("a"), "concept_id"), ["g", "a"]).join(r.select(F.col("library_id").alias("g"), F.col("item_key").alias("b"), "concept_id"), ["g", "b", "concept_id"])
    x = x.join(df.withColumnRenamed("library_id", "g"), ["g", "concept_id"])
    return x.groupBy("g", "a", "b").agg(F.min(F.struct("df", "concept_id")).alias("m"), F.count(F.lit(1)).alias("common")).select(F.col("g").alias("library_id"), "a", "b", F.col("m.concept_id").alias("concept_id"), "common")


def doc_groups(spark, d):
    return G.document_groups(_readings(spark, d), KEY, "concept_id")


def one_hop(spark, d):
    """Concepts whose English name has "creep", and those read in the same few papers."""
    t = table(spark, d, "wiki_concept_terms").filter(F.contains(F.lower("name_en"), F.lit("creep"))).select(F.col("concept_id").alias("node")).distinct().withColumn("score", F.lit(1.0))
    e = G.concept_edges(_readings(spark, d).select(F.lit(0).alias("g"), F.col("concept_id").alias("doc"), F.concat_ws(":", "library_id", "item_key").alias("c")), "g", "doc", "c", 30)
    return G.one_hop(t, e.select("a", "b")).select(F.col("node").alias("concept_id"), "score", "hop")


def primary_term(spark, d):
    return G.primary_terms(table(spark, d, "wiki_concept_terms")).select("concept_id", "term_id", "completeness")


def concept_match(spark, d):
    n = table(spark, d, "wiki_concept_inputs").select(F.col("input_id").alias("key"), F.col("canonical_name").alias("name"))
    return G.concept_match(n, table(spark, d, "wiki_concept_terms"))


def name_classes(spark, d):
    n = table(spark, d, "wiki_concept_inputs").select(F.explode(F.array("canonical_name", "alias_text", "abbr")).alias("n")).filter("n <> ''").distinct()
    return n.groupBy(G.name_kind(F.col("n")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(G.name_units(F.col("n"))).alias("units"))


def concept_text(spark, d):
    """The text by which a concept is embedded."""
    t = table(spark, d, "wiki_concept_terms").select("concept_id", F.explode(F.array("name_en", "name_zh", "abbreviation")).alias("n")).filter("n <> ''")
    t = t.groupBy("concept_id").agg(F.array_sort(F.collect_set("n")).alias("ns"))
    c = table(spark, d, "wiki_concepts").join(t, "concept_id", "left")
    names = F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("ns", F.array().cast("array<string>"))))
    return c.select("concept_id", F.concat(F.array_join(names, " / "), F.lit(" ["), "concept_type", F.lit("]"), F.when(F.length("description") > 0, F.concat(F.lit(" "), "description")).otherwise("")).alias("text"))


def term_reconciliation(spark, d):
    """What the second term of a concept would do to its primary one."""
    t = table(spark, d, "wiki_concept_terms").select("concept_id", "term_role", "name_en", "name_zh", "abbreviation", "origin_en")
    p, a = t.filter("term_role = 'primary'"), t.filter("term_role = 'alias'").select("concept_id", *[F.col(c).alias(f"b_{c}") for c in ("name_en", "name_zh", "abbreviation", "origin_en")])
    j = p.join(a, "concept_id")
    r = {c: G.reconcile(F.col(c), F.col(f"b_{c}"), F.col("origin_en"), F.col("b_origin_en")) for c in ("name_en", "name_zh", "abbreviation")}
    verdict = F.array_contains(F.array(*r.values()), F.lit("conflict"))
    return j.select("concept_id", *[v.alias(k) for k, v in r.items()], verdict.alias("rejected"))


def merge_verdict(spark, d):
    """Concepts that share a name: how many a name leads to."""
    t = table(spark, d, "wiki_concept_terms")
    n = t.select("concept_id", F.explode(F.array(F.lower("name_en"), F.lower("name_zh"), F.lower("abbreviation"))).alias("name")).filter("name <> ''").distinct()
    g = n.groupBy("name").agg(F.count(F.lit(1)).alias("concepts"), F.min("concept_id").alias("target"))
    return g.select("name", "concepts", "target", F.when(F.col("concepts") > 1, "ambiguous").otherwise("ok").alias("verdict"))


def evidence_overview(spark, d):
    s = table(spark, d, "wiki_concept_term_sources").distinct().join(table(spark, d, "wiki_concept_terms").select("term_id", "concept_id"), "term_id")
    depth = F.when(F.col("write_path") == "concept", 2).when(F.col("write_path") == "attach", 1).otherwise(0)
    return s.withColumn("depth", depth).groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("readings"),
        F.count_if(F.col("write_path") == "concept").alias("by_concept"),
        F.count_if(F.col("write_path") == "attach").alias("by_attach"),
        F.max("depth").alias("deepest"),
        F.count_distinct(F.when(F.col("item_key") != "", F.struct("library_id", "item_key"))).alias("keys"),
        F.array_join(F.array_sort(F.collect_set("write_path")), ",").alias("roles"),
    )


def summary_claims(spark, d):
    """The five entries that stand for each matched concept: entries are its claims here."""
    i = table(spark, d, "wiki_concept_inputs").distinct()
    m = concept_match(spark, d).withColumnRenamed("key", "input_id")
    c = i.join(m, "input_id").groupBy("concept_id", "input_id").agg(F.max(F.struct("canonical_name", "confidence", "entry_source", "library_id", "abbr")).alias("x"))
    claims = c.select("concept_id", F.col("input_id").alias("claim_id"), F.concat(F.col("x.canonical_name"), F.lit("|"), F.col("input_id").cast("string")).alias("text"), F.col("x.confidence").alias("confidence"), F.coalesce("x.entry_source", F.lit("")).alias("kind"), F.col("x.library_id").cast("string").alias("source"), F.col("x.abbr").isNotNull().alias("limitation"))
    return G.summary_claims(claims).select("concept_id", "claim_id", "rank")


def link_status(spark, d):
    """The state of a paper from its sessions: reading is pending, finished accepted, abandoned rejected, answered stale."""
    s = table(spark, d, "wiki_reading_sessions").distinct()
    n = {k: F.count_if(F.col("session_state") == v) for k, v in (("pending", "reading"), ("accepted", "finished"), ("rejected", "abandoned"), ("stale", "answered"))}
    g = s.groupBy(*KEY).agg(*[c.alias(k) for k, c in n.items()])
    gone = table(spark, d, "items").dropna(subset=KEY).groupBy(*KEY).agg(F.bool_and(F.coalesce("in_trash", F.lit(False))).alias("trash"))
    g = g.join(gone, KEY, "left")
    return g.select(*KEY, G.link_status({k: F.col(k) for k in n}, F.coalesce("trash", F.lit(True))).alias("status"))


def link_stats(spark, d):
    s = table(spark, d, "wiki_reading_sessions").distinct()
    g = s.agg(*[F.count_if(F.col("session_state") == v).alias(v) for v in ("reading", "answered", "finished", "abandoned", "closed")])
    done = F.col("finished") + F.col("abandoned")
    return g.withColumn("rejected_rate", F.round(F.when(done > 0, F.col("abandoned") / done).otherwise(F.lit(0.0)), 6))


def neighbors(spark, d):
    a = table(spark, d, "similar_snapshots").select(*KEY, F.explode("query_chunk_ids").alias("chunk_id")).distinct()
    return G.neighbours(L.live_chunks(table(spark, d, "chunks")), a, KEY, 2).select(*KEY, "chunk_id", "distance")


def relocate(spark, d):
    """Excerpts of every fiftieth chunk found again in the chunks of its paper."""
    c = table(spark, d, "chunks").filter(F.length("text") > 80)
    e = c.filter("row_id % 50 = 0").select(F.col("row_id").alias("key"), *KEY, F.substring("text", 20, 60).alias("excerpt"))
    return G.relocate(e, c.select(*KEY, "row_id", "text"), KEY)


def _pool(spark, d):
    """Usable vectors without those of boilerplate chunks, but of a paper that has nothing else."""
    v = V.usable(PV._vectors(spark, d), "vector", 64).select("id", *KEY, "chunk_id", "vector")
    live = L.live_chunks(table(spark, d, "chunks"))
    odd = live.filter((F.length(F.trim(F.coalesce("text", F.lit("")))) == 0) | T.boundary(F.col("text")) | T.reference_list(F.col("text"))).select(*KEY, "chunk_id").distinct()
    v = v.join(odd.withColumn("odd", F.lit(True)), [*KEY, "chunk_id"], "left").withColumn("odd", F.coalesce("odd", F.lit(False)))
    only = v.groupBy(*KEY).agg(F.bool_and("odd").alias("only"))
    return v.join(only, KEY).filter(~F.col("odd") | F.col("only")).drop("odd", "only")


def _linked(spark, d, floors):
    v = V.usable(PV._vectors(spark, d), "vector", 64).select("id", F.col("library_id").alias("library"), F.concat_ws(":", *KEY).alias("document"), "vector")
    return K.linked(v, K.representatives(_pool(spark, d), KEY, "chunk_id", "vector"), v.filter("id % 50 = 0"), floors=floors)


def link_scan(spark, d):
    """Links of the papers that have a vector whose id is divisible by 50, to all papers of their library."""
    return _linked(spark, d, True)


def link_scores(spark, d):
    """The scores of all pairs that are compared in both directions, whether or not they make a link."""
    return _linked(spark, d, False)


def representatives(spark, d):
    return K.representatives(_pool(spark, d), KEY, "chunk_id", "vector")


def concepts_markdown(spark, d):
    """One line of Markdown per concept, to be written as text."""
    p = G.primary_terms(table(spark, d, "wiki_concept_terms"))
    return p.select("concept_id", F.concat(F.lit("- **"), "name_en", F.lit("**"), F.when(F.length("name_zh") > 0, F.concat(F.lit(" / "), "name_zh")).otherwise(""), F.when(F.length("abbreviation") > 0, F.concat(F.lit(" ("), "abbreviation", F.lit(")"))).otherwise("")).alias("line"))


QUERIES = [concept_edges, concept_edges_orders, shared_rare_terms, usable_terms, graph_links, doc_groups, one_hop, primary_term, concept_match, name_classes, concept_text, term_reconciliation, merge_verdict, evidence_overview, summary_claims, link_status, link_stats, neighbors, relocate, link_scan, link_scores, representatives, concepts_markdown]

_q = lambda xs: ", ".join("'" + x + "'" for x in xs)
_R = "r AS (SELECT DISTINCT s.library_id, string_split(item_key, ':')[-1] AS item_key, concept_id FROM wiki_concept_term_sources s JOIN wiki_concept_terms USING (term_id) WHERE s.library_id IS NOT NULL AND item_key <> '')"
_EDGE = lambda r, cap: f"""nn AS (SELECT g, count(DISTINCT d) AS n FROM {r} GROUP BY g), df AS (SELECT g, c, count(*) AS df FROM {r} GROUP BY ALL HAVING count(*) BETWEEN 2 AND {cap}),
kk AS (SELECT g, c, d, ln((n + 1) / (df + 1)) AS idf FROM {r} JOIN df USING (g, c) JOIN nn USING (g)),
ed AS (SELECT x.g, x.d AS a, y.d AS b, round(sum(x.idf), 6) AS score, count(*) AS shared FROM kk x JOIN kk y ON x.g = y.g AND x.c = y.c AND x.d < y.d GROUP BY ALL)"""  # noqa: E731
_E = f"WITH {_R}, rr AS (SELECT library_id AS g, item_key AS d, concept_id AS c FROM r), {_EDGE('rr', G.CLIQUE)}"
_QT = lambda x: f"list_concat({duck.latin(duck.fold(x))}, {duck.han(duck.fold(x))})"
_lt = "lower(regexp_replace(t, '[^\\p{L}]', '', 'g'))"
_USE = f"""(length({_lt}) > 0 AND NOT regexp_matches(t, '[{T.HAN}]') AND (length({_lt}) >= 3 OR (length({_lt}) >= 2 AND len(regexp_extract_all(t, '[0-9]')) >= 3)) AND lower(t) NOT IN ({_q(G.NO_SIGNAL)}) AND {_lt} NOT IN ({_q((*G.NO_UNIT, *G.NO_MARKUP, *G.NO_GREEK))})
 AND NOT regexp_matches({_lt}, '^[a-z]{{0,3}}(?:min|sec|hr|hrs|mpa|gpa|kpa|mol|rpm)$') AND NOT regexp_matches(lower(t), '^[a-z]{{1,3}}[/·-][a-z]{{1,4}}[0-9]*$'))"""
_n = lambda c: f"lower(trim(regexp_replace({c}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' '))"
_CM = f"cm AS (SELECT DISTINCT i.input_id AS key, t.concept_id FROM wiki_concept_inputs i JOIN (SELECT concept_id, {_n('name_en')} AS k FROM wiki_concept_terms UNION SELECT concept_id, {_n('name_zh')} FROM wiki_concept_terms) t ON {_n('i.canonical_name')} = t.k WHERE t.k <> '')"
_rk = lambda o: f"(CASE {o} WHEN 'user' THEN 3 WHEN 'literature' THEN 2 WHEN 'ai' THEN 1 ELSE 0 END)"
_rc = lambda c: f"CASE WHEN coalesce(b.{c}, '') = '' THEN 'keep' WHEN coalesce(a.{c}, '') = '' THEN 'fill' WHEN lower(a.{c}) = lower(b.{c}) AND {_rk('b.origin_en')} > {_rk('a.origin_en')} THEN 'promote' WHEN lower(a.{c}) = lower(b.{c}) THEN 'keep' WHEN {_rk('b.origin_en')} > {_rk('a.origin_en')} THEN 'correct' WHEN {_rk('b.origin_en')} < {_rk('a.origin_en')} THEN 'keep' ELSE 'conflict' END"
_comp = "(CASE WHEN length(name_zh) > 0 THEN 1 ELSE 0 END + CASE WHEN length(name_en) > 0 THEN 1 ELSE 0 END + CASE WHEN length(abbreviation) > 0 THEN 1 ELSE 0 END)"
_PT = f"pt AS (SELECT *, {_comp} AS completeness FROM wiki_concept_terms QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY completeness DESC, term_id) = 1)"

_cosr = lambda a, b, n: f"round(list_dot_product({a}::double[], {b}::double[]) / (sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[]))), {n})"
_REPS = f"""{PV._OK}, {duck.LIVE}, od AS (SELECT DISTINCT library_id, item_key, chunk_id FROM chunks_ WHERE length(trim(coalesce(text, ''))) = 0 OR row_id IN ({PT.SQL['boilerplate_chunks']})),
fl AS (SELECT v.*, od.chunk_id IS NOT NULL AS odd FROM v LEFT JOIN od ON v.library_id = od.library_id AND v.item_key = od.item_key AND v.chunk_id = od.chunk_id), po AS (SELECT * FROM fl QUALIFY NOT odd OR bool_and(odd) OVER (PARTITION BY library_id, item_key)),
pn AS (SELECT library_id, item_key, id, vector, row_number() OVER (PARTITION BY library_id, item_key ORDER BY chunk_id, id) - 1 AS pos, count(*) OVER (PARTITION BY library_id, item_key) AS n FROM po),
pt AS (SELECT *, CASE WHEN n < 12 THEN n ELSE least(20, greatest(12, ceil(sqrt(n))))::bigint END AS target FROM pn), bd AS (SELECT *, least(target - 1, (pos * target + target - 1) // n) AS band FROM pt WHERE n > target),
ce AS (SELECT library_id, item_key, band, list_transform(range(1, 65), lambda i: list_avg(list_transform(list(vector), lambda x: x[i]::double))) AS centre FROM bd GROUP BY ALL),
mp AS (SELECT bd.* FROM bd JOIN ce USING (library_id, item_key, band) QUALIFY row_number() OVER (PARTITION BY library_id, item_key, band ORDER BY {_cosr('centre', 'vector', 9)} DESC, pos) = 1),
th AS (SELECT library_id, item_key, any_value(target) AS target, list_reduce(list([{{'pos': pos, 'id': id, 'v': vector}}] ORDER BY pos), lambda a, x: CASE WHEN list_max(list_transform(a, lambda y: {_cosr('y.v', 'x[1].v', 9)})) >= 0.94 THEN a ELSE list_concat(a, x) END) AS kept FROM mp GROUP BY ALL),
al AS (SELECT library_id, item_key, list({{'pos': pos, 'id': id, 'v': vector}} ORDER BY pos) AS cs FROM bd GROUP BY ALL),
fi AS (SELECT library_id, item_key, list_reduce(list_concat([kept], list_transform(range(target - len(kept)), lambda i: kept[1:0])), lambda a, x: list_concat(a, list_transform(list_sort(list_filter(list_transform(cs, lambda c: {{'s': greatest(0, list_max(list_transform(a, lambda y: {_cosr('y.v', 'c.v', 9)}))), 'pos': c.pos, 'id': c.id, 'v': c.v}}), lambda f: f.s < 0.94))[1:1], lambda f: {{'pos': f.pos, 'id': f.id, 'v': f.v}}))) AS kept FROM th JOIN al USING (library_id, item_key)),
reps AS (SELECT library_id, item_key, r.id, r.pos FROM (SELECT library_id, item_key, unnest(kept) AS r FROM fi) UNION ALL SELECT library_id, item_key, id, pos FROM pt WHERE n <= target)"""
SQL = {
    "concept_edges": f"{_E} SELECT g AS library_id, a, b, score, shared, least(3.0, 1 + score) AS strength FROM ed",
    "concept_edges_orders": f"WITH rr AS (SELECT DISTINCT 1 AS g, l_orderkey AS d, l_partkey AS c FROM lineitem), {_EDGE("rr", 40)} SELECT a, b, score, shared FROM ed WHERE shared >= 2",
    "shared_rare_terms": f"""{_E}, {duck.LIVE}, tx AS (SELECT library_id AS g, item_key AS d, chunk_id, text FROM chunks_ WHERE length(text) > 0), w0 AS (SELECT g, d, t, min(chunk_id) AS chunk FROM (SELECT g, d, chunk_id, unnest({_QT('text')}) AS t FROM tx) GROUP BY ALL), wd AS (SELECT * FROM w0 WHERE {_USE}),
n2 AS (SELECT g, count(DISTINCT d) AS n FROM tx GROUP BY g), f2 AS (SELECT g, t, count(*) AS df FROM wd GROUP BY ALL), ra AS (SELECT g, d, t, chunk, n, df FROM wd JOIN f2 USING (g, t) JOIN n2 USING (g) WHERE df <= greatest(1, floor(n * 0.25))),
bo AS (SELECT e.g, e.a, e.b, x.t, round(least(1.0, ln((x.n + 1) / (x.df + 1)) / (ln(x.n + 1.0) * 0.85)), 6) AS score, x.chunk AS a_chunk, y.chunk AS b_chunk FROM ed e JOIN ra x ON x.g = e.g AND x.d = e.a JOIN ra y ON y.g = e.g AND y.d = e.b AND y.t = x.t)
SELECT g, a, b, t, score, row_number() OVER (PARTITION BY g, a, b ORDER BY score DESC, t) AS rank, a_chunk, b_chunk FROM bo QUALIFY rank <= 3""",
    "usable_terms": f"SELECT DISTINCT t FROM (SELECT unnest({_QT('text')}) AS t FROM documents) WHERE {_USE}",
    "graph_links": f"""{_E}, f1 AS (SELECT library_id, concept_id, count(*) AS df FROM r GROUP BY ALL), j AS (SELECT e.g, e.a, e.b, x.concept_id, df FROM ed e JOIN r x ON x.library_id = e.g AND x.item_key = e.a JOIN r y ON y.library_id = e.g AND y.item_key = e.b AND y.concept_id = x.concept_id JOIN f1 ON f1.library_id = e.g AND f1.concept_id = x.concept_id)
SELECT g AS library_id, a, b, arg_min(concept_id, (df, concept_id)) AS concept_id, count(*) AS common FROM j GROUP BY ALL""",
    "doc_groups": f"WITH {_R}, n AS (SELECT concept_id, count(DISTINCT (library_id, item_key)) AS supporters FROM r GROUP BY 1), o AS (SELECT library_id, item_key, concept_id, supporters FROM r JOIN n USING (concept_id) QUALIFY row_number() OVER (PARTITION BY library_id, item_key ORDER BY supporters, concept_id) = 1) SELECT *, dense_rank() OVER (ORDER BY concept_id) - 1 AS colour FROM o",
    "one_hop": f"""WITH {_R}, rr AS (SELECT DISTINCT 0 AS g, concept_id AS d, library_id || ':' || item_key AS c FROM r), {_EDGE('rr', 30)}, s AS (SELECT DISTINCT concept_id AS node FROM wiki_concept_terms WHERE contains(lower(name_en), 'creep')),
al AS (SELECT node, 1.0::double AS score, 0 AS hop FROM s UNION ALL SELECT b, 0.72, 1 FROM ed JOIN s ON s.node = a UNION ALL SELECT a, 0.72, 1 FROM ed JOIN s ON s.node = b) SELECT node AS concept_id, round(max(score), 6) AS score, arg_min(hop, -score) AS hop FROM al GROUP BY 1""",
    "primary_term": f"WITH {_PT} SELECT concept_id, term_id, completeness FROM pt",
    "concept_match": f"WITH {_CM} SELECT * FROM cm",
    "name_classes": f"""WITH n AS (SELECT DISTINCT unnest([canonical_name, alias_text, abbr]) AS n FROM wiki_concept_inputs), k AS (SELECT n, CASE WHEN regexp_matches(n, '[{T.HAN}]') THEN 'zh' WHEN regexp_matches(n, '^[A-Z][A-Z0-9-]{{1,9}}$') THEN 'abbreviation' ELSE 'en' END AS kind, length(regexp_replace(regexp_replace(n, '[ \\t\\n\\x0B\\f\\r]', '', 'g'), '[A-Za-z0-9]+', 'a', 'g')) AS u FROM n WHERE n <> '') SELECT kind, count(*) AS n, sum(u)::bigint AS units FROM k GROUP BY 1""",
    "concept_text": """WITH t AS (SELECT concept_id, list_sort(list(DISTINCT n)) AS ns FROM (SELECT concept_id, unnest([name_en, name_zh, abbreviation]) AS n FROM wiki_concept_terms) WHERE n <> '' GROUP BY 1)
SELECT concept_id, array_to_string(list_concat([canonical_name], list_filter(coalesce(ns, []), lambda x: x <> canonical_name)), ' / ') || ' [' || concept_type || ']' || (CASE WHEN length(description) > 0 THEN ' ' || description ELSE '' END) AS text FROM wiki_concepts LEFT JOIN t USING (concept_id)""",
    "term_reconciliation": f"SELECT concept_id, name_en, name_zh, abbreviation, (name_en = 'conflict' OR name_zh = 'conflict' OR abbreviation = 'conflict') AS rejected FROM (SELECT a.concept_id, {_rc('name_en')} AS name_en, {_rc('name_zh')} AS name_zh, {_rc('abbreviation')} AS abbreviation FROM wiki_concept_terms a JOIN wiki_concept_terms b ON a.concept_id = b.concept_id AND a.term_role = 'primary' AND b.term_role = 'alias')",
    "merge_verdict": "WITH n AS (SELECT DISTINCT concept_id, unnest([lower(name_en), lower(name_zh), lower(abbreviation)]) AS name FROM wiki_concept_terms) SELECT name, count(*) AS concepts, min(concept_id) AS target, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'ok' END AS verdict FROM n WHERE name <> '' GROUP BY 1",
    "evidence_overview": """SELECT concept_id, count(*) AS readings, count(*) FILTER (write_path = 'concept') AS by_concept, count(*) FILTER (write_path = 'attach') AS by_attach, max(CASE write_path WHEN 'concept' THEN 2 WHEN 'attach' THEN 1 ELSE 0 END) AS deepest,
 count(DISTINCT CASE WHEN item_key <> '' THEN (library_id, item_key) END) AS keys, string_agg(DISTINCT write_path, ',' ORDER BY write_path) AS roles FROM (SELECT DISTINCT * FROM wiki_concept_term_sources) JOIN wiki_concept_terms USING (term_id) GROUP BY 1""",
    "link_status": """WITH g AS (SELECT library_id, item_key, CASE WHEN count(*) FILTER (session_state = 'reading') > 0 THEN 'open' WHEN count(*) FILTER (session_state = 'finished') > 0 THEN 'resolved' WHEN count(*) FILTER (session_state = 'abandoned') > 0 THEN 'dismissed' WHEN count(*) FILTER (session_state = 'answered') > 0 THEN 'stale' ELSE 'open' END AS s
 FROM (SELECT DISTINCT * FROM wiki_reading_sessions) GROUP BY ALL), i AS (SELECT DISTINCT library_id, item_key FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL AND NOT coalesce(in_trash, false))
SELECT g.library_id, g.item_key, CASE WHEN i.item_key IS NULL THEN 'source_deleted' ELSE s END AS status FROM g LEFT JOIN i ON g.library_id = i.library_id AND g.item_key = i.item_key""",
    "link_stats": "WITH g AS (SELECT count(*) FILTER (session_state = 'reading') AS reading, count(*) FILTER (session_state = 'answered') AS answered, count(*) FILTER (session_state = 'finished') AS finished, count(*) FILTER (session_state = 'abandoned') AS abandoned, count(*) FILTER (session_state = 'closed') AS closed FROM (SELECT DISTINCT * FROM wiki_reading_sessions)) SELECT *, round(CASE WHEN finished + abandoned > 0 THEN abandoned / (finished + abandoned) ELSE 0 END, 6) AS rejected_rate FROM g",
    "neighbors": f"WITH {duck.LIVE}, a AS (SELECT DISTINCT library_id, item_key, unnest(query_chunk_ids) AS chunk_id FROM similar_snapshots), j AS (SELECT c.library_id, c.item_key, c.chunk_id, min(abs(c.chunk_id - a.chunk_id)) AS distance FROM chunks_ c JOIN a ON a.library_id = c.library_id AND a.item_key = c.item_key AND abs(c.chunk_id - a.chunk_id) <= 2 GROUP BY ALL) SELECT * FROM j WHERE distance > 0",
    "relocate": """WITH c AS (SELECT row_id, library_id, item_key, text FROM chunks WHERE length(text) > 80), e AS (SELECT row_id AS key, library_id, item_key, trim(regexp_replace(substr(text, 20, 60), '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ') AS a FROM c WHERE row_id % 50 = 0),
j AS (SELECT key, row_id, a, trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ') AS b FROM e JOIN c USING (library_id, item_key)),
g AS (SELECT key, row_id, a, b, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS y FROM j),
o AS (SELECT key, row_id, round(CASE WHEN length(a) > 0 AND contains(b, a) THEN 1.0 WHEN length(a) < 2 THEN 0.0 ELSE len(list_intersect(x, y)) / len(x) END, 6) AS overlap FROM g)
SELECT key, row_id, overlap, 'overlap' AS how FROM o WHERE overlap >= 0.72 QUALIFY row_number() OVER (PARTITION BY key ORDER BY overlap DESC, row_id) = 1""",
    "representatives": f"WITH {_REPS} SELECT library_id, item_key, id, pos FROM reps",
    "link_scan": f"""WITH {_REPS}, vd AS (SELECT id, library_id, library_id || ':' || item_key AS doc, vector FROM v), rp AS (SELECT vd.* FROM vd JOIN reps USING (id)), so AS (SELECT DISTINCT doc FROM vd WHERE id % 50 = 0),
nn AS (SELECT library_id, count(DISTINCT doc) AS n FROM vd GROUP BY 1), an AS (SELECT rp.*, n FROM rp JOIN so USING (doc) JOIN nn USING (library_id)),
fh AS (SELECT a.doc AS source, a.id AS anchor, b.doc AS target, {_cosr('a.vector', 'b.vector', 12)} AS s FROM an a JOIN vd b ON a.library_id = b.library_id AND a.doc <> b.doc QUALIFY row_number() OVER (PARTITION BY a.id, b.doc ORDER BY s DESC) <= 2),
ft AS (SELECT source, anchor, target, avg(s) AS score, max(s) AS best FROM fh GROUP BY ALL), br AS (SELECT anchor, count(*) FILTER (best >= 0.5) AS breadth FROM ft GROUP BY 1),
wt AS (SELECT doc AS source, id AS anchor, coalesce(breadth, 0) AS breadth, greatest(0, least(1, ln((n + 1) / (coalesce(breadth, 0) + 1)) / ln(n + 1))) AS w, greatest(3, floor(n * 0.3)) AS cap FROM an LEFT JOIN br ON anchor = id),
tt AS (SELECT source, sum(w) AS total FROM wt GROUP BY 1), fw AS (SELECT source, target, anchor, score, w * greatest(0, least(1, score)) AS ws, breadth <= cap AND w * greatest(0, least(1, score)) > 0 AS told, total FROM ft JOIN wt USING (source, anchor) JOIN tt USING (source)),
fo AS (SELECT source, target, round(greatest(0, least(1, 0.75 * coalesce(sum(ws) / max(total), 0) + 0.25 * coalesce(max(round(ws, 9)) FILTER (told), 0))), 9) AS forward, coalesce(arg_max(score, (round(ws, 9), -anchor)) FILTER (told), 0) AS fa FROM fw GROUP BY ALL),
pa AS (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY source ORDER BY forward DESC, target) <= 24),
bh AS (SELECT source, target, r.id AS anchor, {_cosr('r.vector', 'c.vector', 12)} AS s FROM pa JOIN rp r ON r.doc = target JOIN vd c ON c.doc = source QUALIFY row_number() OVER (PARTITION BY source, target, r.id ORDER BY s DESC) <= 2),
bt AS (SELECT source, target, anchor, greatest(0, least(1, avg(s))) AS c FROM bh GROUP BY ALL), re AS (SELECT source, target, round(0.75 * avg(c) + 0.25 * max(c), 9) AS reverse, max(c) AS ra FROM bt GROUP BY ALL),
sy AS (SELECT source, target, forward, reverse, round(sqrt(forward * least(1, reverse)), 9) AS "symmetric", fa, ra FROM pa JOIN re USING (source, target))
SELECT source, target, forward, reverse, "symmetric", row_number() OVER (PARTITION BY source ORDER BY "symmetric" DESC, target) AS rank FROM sy WHERE "symmetric" >= 0.45 AND (fa >= 0.35 OR ra >= 0.35) QUALIFY rank <= 8""",
    "concepts_markdown": f"WITH {_PT} SELECT concept_id, '- **' || name_en || '**' || (CASE WHEN length(name_zh) > 0 THEN ' / ' || name_zh ELSE '' END) || (CASE WHEN length(abbreviation) > 0 THEN ' (' || abbreviation || ')' ELSE '' END) AS line FROM pt",
}
SQL["link_scores"] = SQL["link_scan"].replace(' WHERE "symmetric" >= 0.45 AND (fa >= 0.35 OR ra >= 0.35) QUALIFY rank <= 8', "")
