"""Queries over notes, structured documents and single papers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stacklight.operators import blocks as B
from stacklight.operators import fusion as X
from stacklight.operators import lexical as L
from stacklight.operators import notes as N
from stacklight.operators import textprep as P
from stacklight.operators import vectors as V
from stacklight.plans import duck
from stacklight.plans import lexical as PL
from stacklight.plans import vectors as PV
from stacklight.sources.tables import spread, table

KEY = ["library_id", "item_key"]


def _notes(spark, d):
    n = table(spark, d, "documents").filter((F.lower(F.trim("source")) == "note") & F.col("item_key").isNotNull() & (F.length("text") > 0))
    return n.select(F.col("doc_id").alias("note"), *KEY, F.concat("text", F.lit(" (chunks 0-9)")).alias("text"))


def note_sentences(spark, d):
    return P.table_of(_notes(spark, d), ["note"], "text", lambda s: N.note_sentences(s), "block int, k int, sentence string, block_text string").drop("block_text")


def claim_risks(spark, d):
    """Sentences of notes against the chunks they cite of their paper."""
    n = _notes(spark, d)
    lines = P.table_of(n, ["note"], "text", lambda s: N.note_sentences(s), "block int, k int, sentence string, block_text string")
    c = L.live_chunks(table(spark, d, "chunks")).filter("length(text) > 0").select(*KEY, "chunk_id", "text")
    # Only cited chunks meet a note: a paper of many chunks and many notes isn't multiplied.
    asked = N.with_citations(lines).select("note", F.explode("cited").alias("chunk_id")).distinct().join(n.select("note", *KEY), "note")
    src = asked.join(c, [*KEY, "chunk_id"]).select("note", "chunk_id", "text")
    return N.audit(lines, src).select("note", "block", "k", F.array_join("risks", ",").alias("risks"))


def risk_flags(spark, d):
    """The wording tests alone, by document."""
    t = table(spark, d, "documents").filter("length(text) > 0")
    flags = (("absolute", N.ABSOLUTE), ("relation", N.RELATION), ("direction", N.DIRECTION), ("negation", N.NEGATION), ("hedge", N.HEDGE), ("condition", N.CONDITION))
    return t.select("doc_id", *[N.says(F.col("text"), w).alias(n) for n, w in flags])


def term_excerpts(spark, d):
    t = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("membrane")))
    return t.select("doc_id", N.excerpt(F.col("text"), "membrane").alias("excerpt"))


def typed_chunks(spark, d):
    docs = spread(table(spark, d, "documents").filter("length(text) > 0"), "doc_id")
    return P.table_of(docs, ["doc_id"], "text", lambda s: [(k, *u) for k, u in enumerate(N.structure(s))], "k int, type string, title string, unit string")


def structured_blocks(spark, d):
    """Documents turned to JSON blocks, a page for every four paragraphs, and put together again."""
    docs = table(spark, d, "documents").filter("length(text) > 0")
    parts = F.split("text", "\n\n+")
    cells = F.transform(parts, lambda p, i: F.struct(F.when(p.startswith("#"), "title").otherwise("text").alias("type"), F.floor(i / 4).cast("int").alias("page_idx"), F.lit(None).cast("int").alias("text_level"), p.alias("text"), F.lit(None).cast("string").alias("table_body")))
    return B.assemble(B.read(docs.select("doc_id", F.to_json(cells).alias("body")), ["doc_id"], "body"), ["doc_id"])


def structured_sources(spark, d):
    """Documents given in up to three forms of JSON: the best that each has, with its blocks by page."""
    docs = table(spark, d, "documents").filter("length(text) > 0")
    parts = F.filter(F.split("text", "\n\n+"), lambda p: F.length(p) > 0)
    flat = F.to_json(F.transform(parts, lambda p, i: F.struct(F.lit("text").alias("type"), F.floor(i / 4).cast("int").alias("page_idx"), p.alias("text"))))
    paged = F.to_json(F.array(F.transform(parts, lambda p: F.struct(F.lit("paragraph").alias("type"), F.struct(p.alias("text")).alias("content")))))
    files = docs.select("doc_id", F.explode(F.array(
        F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("a_content_list_v2.json").alias("name"), paged.alias("body"))),
        F.when(F.col("doc_id") % 2 == 0, F.struct(F.lit("a_content_list.json").alias("name"), flat.alias("body"))),
        F.struct(F.lit("model.json").alias("name"), paged.alias("body")),
    )).alias("f")).filter("f is not null").select("doc_id", "f.name", "f.body")
    b = B.read_best(files, ["doc_id"], "name", "body")
    return b.groupBy("doc_id", "format").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"), F.max("page").alias("last_page"))


def document_hybrid(spark, d):
    """Chunks of each search's paper: by words and by the likeness to the search's chunks, fused for each search."""
    s = table(spark, d, "similar_snapshots").select("snapshot_id", *KEY, "query_chunk_ids")
    searches = s.select("snapshot_id", *KEY).distinct()
    # The words of a paper are ranked once, not for each of its searches.
    mine = L.live_chunks(table(spark, d, "chunks")).filter("length(text) > 0").join(searches.select(*KEY).distinct(), KEY, "left_semi")
    own = [*KEY, "chunk_id"]
    words = L.lexical_rank(mine.select(*own, F.lit("chunkText").alias("field"), "text"), [("surface", 1.0), ("strength", 0.9)], (("chunkText", 6.0),), tuple(own), tuple(KEY))
    words = X.admitted(words.select(*own, "score"), own, 0.0, by=KEY).join(searches, KEY)
    paper = F.concat_ws(":", *KEY).alias("paper")
    v = V.usable(PV._vectors(spark, d), "vector", 64).select("id", *KEY, "chunk_id", "vector", paper)
    asked = v.join(s.select("snapshot_id", *KEY, F.explode("query_chunk_ids").alias("chunk_id")).distinct(), [*KEY, "chunk_id"])
    near = V.scan_own(v, asked.select(F.col("snapshot_id").alias("search"), "paper", "vector"), "paper", ["chunk_id"], 0.2)
    near = near.select(F.col("search").alias("snapshot_id"), "chunk_id", F.round("score", 6).alias("score"))
    by, keys = ["snapshot_id"], ["snapshot_id", "chunk_id"]
    branches = {"keyword": (words, 1.0), "semantic": (X.admitted(near, keys, 0.2, by=by), 1.0)}
    return X.rrf(branches, keys, by=by).select(*keys, F.round("rrf", 6).alias("rrf"), "matched_by", "rank")


def quantised_or_float(spark, d):
    """The int8 vector of each chunk where its values allow it, else the float one: the square of its length."""
    v = V.usable(PV._vectors(spark, d), "vector", 64)
    q, _ = V.quantize(F.col("vector"))
    small = v.filter("id % 3 <> 0").select(*KEY, "chunk_id", "id", V.int_dot(q, q).alias("q"))
    out = v.select(*KEY, "chunk_id", "id", F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("f")).join(small, [*KEY, "chunk_id", "id"], "left")
    return out.select("id", F.coalesce(F.col("q").cast("double"), F.col("f")).alias("value"), F.col("q").isNotNull().alias("quantised"))


QUERIES = [note_sentences, claim_risks, risk_flags, term_excerpts, typed_chunks, structured_blocks, structured_sources, document_hybrid, quantised_or_float]

_says = lambda w: f"regexp_matches(text, '{N.pattern(w)}')"
_lex = lambda k, w: f"SELECT snapshot_id, chunk_id, '{k}' AS probe, {w} AS weight, {PL._strength(k)} AS s FROM mine"
SQL = {
    "risk_flags": f"SELECT doc_id, {_says(N.ABSOLUTE)} AS absolute, {_says(N.RELATION)} AS relation, {_says(N.DIRECTION)} AS direction, {_says(N.NEGATION)} AS negation, {_says(N.HEDGE)} AS hedge, {_says(N.CONDITION)} AS condition FROM documents WHERE length(text) > 0",
    "term_excerpts": """WITH s AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ') AS s FROM documents WHERE contains(lower(text), 'membrane')), a AS (SELECT *, instr(lower(s), 'membrane') AS k FROM s), p AS (SELECT *, greatest(k - 90, 1) AS b, substr(s, greatest(k - 90, 1), least(k - 1, 90) + 98) AS part FROM a)
SELECT doc_id, (CASE WHEN b > 1 THEN '…' ELSE '' END) || part || (CASE WHEN b + length(part) <= length(s) THEN '…' ELSE '' END) AS excerpt FROM p""",
    "quantised_or_float": f"WITH {PV._OK}, q AS (SELECT id, {PV._Q8.format(v='vector')} AS q, vector FROM v) SELECT id, CASE WHEN id % 3 <> 0 THEN list_sum(list_transform(q, lambda z: z * z))::double ELSE round({PV._DOT.format(a='vector', b='vector')}, 6) END AS value, id % 3 <> 0 AS quantised FROM q",
    "document_hybrid": f"""WITH {duck.LIVE}, {PV._OK}, s AS (SELECT DISTINCT snapshot_id, library_id, item_key FROM similar_snapshots), mine AS (SELECT snapshot_id, chunk_id, text FROM chunks_ JOIN s USING (library_id, item_key) WHERE length(text) > 0),
l AS ({_lex('surface', 1.0)} UNION ALL {_lex('strength', 0.9)}), p AS (SELECT snapshot_id, chunk_id, probe, weight, 6.0 * sum(s) AS k FROM l WHERE s > 0 GROUP BY ALL), po AS (SELECT snapshot_id, count(DISTINCT chunk_id) AS pool FROM p GROUP BY 1), f AS (SELECT snapshot_id, probe, count(*) AS df FROM p GROUP BY ALL),
kw0 AS (SELECT snapshot_id, chunk_id, round(sum(weight * least(1.0, ln(1 + pool / (1 + df)) / ln(1 + pool)) * k) * (1 + 0.2 * (count(*) - 1)), 6) AS score FROM p JOIN f USING (snapshot_id, probe) JOIN po USING (snapshot_id) GROUP BY ALL),
ak AS (SELECT DISTINCT snapshot_id, library_id, item_key, unnest(query_chunk_ids) AS chunk_id FROM similar_snapshots), q AS (SELECT snapshot_id, library_id AS ql, item_key AS qi, vector AS qv FROM v JOIN ak USING (library_id, item_key, chunk_id)),
se0 AS (SELECT snapshot_id, chunk_id, round(max({PV._COS}), 6) AS score FROM q JOIN v ON v.library_id = ql AND v.item_key = qi GROUP BY ALL),
al AS (SELECT snapshot_id, chunk_id, 'keyword' AS br, row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, chunk_id) AS rank FROM kw0 UNION ALL SELECT snapshot_id, chunk_id, 'semantic', row_number() OVER (PARTITION BY snapshot_id ORDER BY score DESC, chunk_id) FROM se0 WHERE score >= 0.2),
fu AS (SELECT snapshot_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) AS rrf, count(*) AS sources, min(rank) AS best_rank, string_agg(br, '+' ORDER BY br) AS matched_by FROM al GROUP BY ALL)
SELECT snapshot_id, chunk_id, round(rrf, 6) AS rrf, matched_by, row_number() OVER (PARTITION BY snapshot_id ORDER BY rrf DESC, sources DESC, best_rank, chunk_id) AS rank FROM fu""",
    "structured_sources": """WITH p AS (SELECT doc_id, list_filter(string_split_regex(text, '\\n\\n+'), lambda x: length(x) > 0) AS ps FROM documents WHERE length(text) > 0)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'content_list_v2' WHEN doc_id % 2 = 0 THEN 'content_list' ELSE 'model' END AS format, len(ps) AS blocks, list_sum(list_transform(ps, lambda x: length(x)))::bigint AS chars, CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN (len(ps) - 1) // 4 ELSE 0 END AS last_page FROM p WHERE len(ps) > 0""",
}
