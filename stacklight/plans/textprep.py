"""Queries of text preparation and their SQL where the operator is an expression."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators import measures as X
from stacklight.operators import pages as H
from stacklight.operators import sections as S
from stacklight.operators import textprep as P
from stacklight.sources.tables import spread, table


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang").filter(F.length("text") > 0), "doc_id")


def _t(spark, d):
    return _docs(spark, d).withColumn("x", F.col("text"))


def text_quality(spark, d):
    return _docs(spark, d).select("doc_id", T.quality(T.clean_for_index(F.col("text"))).alias("score"), F.md5(T.clean_for_index(F.col("text"))).alias("clean"))


def html_to_text(spark, d):
    """Texts wrapped as pages and read back: headings, emphasis, lists, entities and scripts."""

    def f(s):
        from html import escape

        page = f"<html><head><style>p{{a:b}}</style><script>var x = 1;</script></head><body><h1>Title</h1><ol><li>one</li><li>two &amp; <b>three</b></li></ol><p>{escape(s)}</p><!-- end --></body></html>"
        return [(H.page_text(page),)]

    return P.table_of(_docs(spark, d), ["doc_id"], "text", f, "page string")


def pdf_cleanup(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.pdf_clean(F.col("text"))).alias("digest"))


def lang_detect(spark, d):
    return _docs(spark, d).select("doc_id", T.chunk_language(F.col("text")).alias("chunk_lang"), T.document_language(F.coalesce("lang", F.lit("")), F.col("text")).alias("document_lang"))


def token_estimate(spark, d):
    return _docs(spark, d).select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


def redact_paths(spark, d):
    """The whole text behind a sentence that names local paths and addresses."""
    t = F.concat(F.lit("see /home/ann/a b.txt, C:\\\\Users\\\\ann\\\\x.pdf and https://example.org/Users/ann/1 or /data/p"), F.col("doc_id").cast("string"), F.lit("/a.pdf; and/or 10.1/x "), F.translate("text", "/:\\", "   "))
    return _docs(spark, d).select("doc_id", T.redact(t).alias("t"))


def sentence_split(spark, d):
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: list(enumerate(P.sentences(s))), "k int, sentence string")


def paragraph_split(spark, d):
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: list(enumerate(P.paragraphs(s))), "k int, paragraph string")


def chunk_documents(spark, d):
    def f(s):
        parts = P.chunks(s)
        return [(k, p, at) for k, (p, at) in enumerate(zip(parts, P.positions(s, parts)))]

    return P.table_of(_docs(spark, d), ["doc_id"], "text", f, "chunk_id int, chunk string, position int")


def filter_body(spark, d):
    def f(s):
        body, gone = S.body_for_index(s)
        return [(body, *gone.values())]

    return P.table_of(_docs(spark, d), ["doc_id"], "text", f, "body string, references_chars int, boilerplate_chars int, image_chars int, opaque_chars int")


def front_matter(spark, d):
    key = ["library_id", "item_key"]
    i = table(spark, d, "items").dropna(subset=key).groupBy(*key).agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"))
    rows = table(spark, d, "documents").filter(F.length("text") > 0).join(i, key).select("doc_id", F.to_json(F.struct("text", "title", "abstract")).alias("t"))

    def f(s):
        import json

        x = json.loads(s)
        body, gone = S.front_matter(x["text"], x.get("title", ""), x.get("abstract", ""), "")
        return [(body, *gone.values())]

    return P.table_of(rows, ["doc_id"], "t", f, "body string, title_chars int, abstract_chars int, author_chars int, affiliation_chars int, keyword_chars int, record_chars int, label_chars int")


def nonbody_chunks(spark, d):
    """Chunks of documents that are no body."""
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: [(k,) for k, c in enumerate(P.chunks(s)) if S.no_body(c)], "chunk_id int")


def boilerplate_chunks(spark, d):
    c = table(spark, d, "chunks").filter(F.length("text") > 0)
    return c.filter(T.boundary(F.col("text")) | T.reference_list(F.col("text"))).select("row_id")


def boilerplate_paragraphs(spark, d):
    """Paragraphs of documents that open a section without body or are a list of references."""
    p = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n\n+")).alias("k", "p")).filter(F.length(F.trim("p")) > 0)
    return p.filter(T.boundary(F.col("p")) | T.reference_list(F.col("p"))).select("doc_id", "k")


def fulltext_grep(spark, d):
    def f(s):
        n, hits = P.grep(s, "viscosity")
        return [(n, k, p, x) for k, (p, x) in enumerate(hits)]

    return P.table_of(_docs(spark, d), ["doc_id"], "text", f, "hits int, k int, position int, context string")


def grep_counts(spark, d):
    n = F.regexp_count(F.lower("text"), F.lit("viscosity"))
    at = F.instr(F.lower("text"), "viscosity")
    return _docs(spark, d).filter(n > 0).select("doc_id", n.alias("hits"), F.concat(F.when(at > 51, "...").otherwise(""), F.substring(F.col("text"), F.greatest(at - 50, F.lit(1)), F.least(at - 1, F.lit(50)) + 9 + 50)).alias("snippet"))


def windows(text):
    """All windows of a text, each from the end of the one before."""
    start = 0
    while start < len(text):
        part, stop = P.window(text, start, 500)
        yield part, stop
        start = stop


def text_window(spark, d):
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: list(windows(s)), "part string, stop int")


def smart_truncate(spark, d):
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: [(P.smart_truncate(s, 300),)], "part string")


def repeated_lines(spark, d):
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: [(len(s) - len(P.drop_repeated_lines(s)),)], "removed int")


def text_hash(spark, d):
    return _docs(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("sha"), F.md5("text").alias("md5"))


def bigram_overlap(spark, d):
    """The first sentence-long excerpt of a text against its own second half."""
    a, b = F.substring("text", 1, 80), F.substring(F.col("text"), (F.length("text") / 2).cast("int") + 1, F.length("text"))
    return _docs(spark, d).filter("length(text) > 200").select("doc_id", F.round(T.bigram_overlap(a, b), 6).alias("overlap"))


def containment(spark, d):
    """Share of the tokens of a title that the abstract has, repeats counted."""
    i = table(spark, d, "items").dropna(subset=["library_id", "item_key", "title", "abstract"]).groupBy("library_id", "item_key").agg(F.max("title").alias("title"), F.max("abstract").alias("abstract"))
    w = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    n = lambda c: i.select("library_id", "item_key", F.explode(w(c)).alias("t")).groupBy("library_id", "item_key", "t").agg(F.count(F.lit(1)).alias(f"n_{c}"))
    j = n("title").join(n("abstract"), ["library_id", "item_key", "t"], "left")
    return j.groupBy("library_id", "item_key").agg(F.round(F.sum(F.least("n_title", F.coalesce("n_abstract", F.lit(0)))) / F.sum("n_title"), 6).alias("share"))


def measurements(spark, d):
    return P.table_of(_docs(spark, d), ["doc_id"], "text", lambda s: [("|".join(X.measured_values(s)),)], "values string")


def measurement_landing(spark, d):
    """Distinct values of a text, and how many of them its second half has."""

    def f(s):
        whole, half = X.measured_values(s), set(X.measured_values(s[len(s) // 2 :]))
        return [(len(whole), sum(v in half for v in whole))]

    return P.table_of(_docs(spark, d), ["doc_id"], "text", f, "n int, landed int")


def citations(spark, d):
    t = F.concat(F.lit("as shown (chunk "), F.col("doc_id").cast("string"), F.lit(") and [chunk:12], chunks 14-16, 18; see chunks 9-3 and 第7段"))
    return _docs(spark, d).select("doc_id", F.array_join(F.transform(T.citations(t), lambda x: x.cast("string")), ",").alias("cited"))


QUERIES = [text_quality, html_to_text, pdf_cleanup, lang_detect, token_estimate, redact_paths, sentence_split, paragraph_split, chunk_documents, filter_body, front_matter, nonbody_chunks, boilerplate_chunks, boilerplate_paragraphs, fulltext_grep, grep_counts, text_window, smart_truncate, repeated_lines, text_hash, bigram_overlap, containment, measurements, measurement_landing, citations]

_D = "d AS (SELECT doc_id, text, lang FROM documents WHERE length(text) > 0)"
_CT = "coalesce(len(regexp_extract_all({x}, '{p}')), 0)"
_han = lambda x: _CT.format(x=x, p="[一-鿿]")
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '[\\t\\x{00a0}\\x{2000}-\\x{200b}]', ' ', 'g'), ' {3,}', '  ', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '(?m)^[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9))"
_MARKS = "[，。、；：！？…—,.;:!?\"''()\\[\\]-]"
_sq = "trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' ')"
_UNIT = T.UNITS
_ms = lambda x: f"list_filter(list_transform(regexp_extract_all({x}, '(\\d+(?:\\.\\d+)?\\s?(?:{_UNIT}))(?:[^A-Za-z]|$)', 1), lambda m: regexp_replace(regexp_replace(m, '\\s', '', 'g'), '^0+(\\d)', '\\1')), lambda m: true)"

SQL = {
    "text_quality": f"""WITH {_D}, c AS (SELECT doc_id, {_CLEAN} AS t FROM d), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: length(trim(x, ' ')) > 0) AS ls FROM c)
SELECT doc_id, CASE WHEN length(trim(t, ' ')) = 0 THEN 0 ELSE greatest(0, 100 - (CASE WHEN {_CT.format(x='t', p='[a-zA-Z一-龥]')} / greatest(length(regexp_replace(t, '\\s', '', 'g')), 1) < 0.4 THEN 40 ELSE 0 END) - (CASE WHEN {_CT.format(x='t', p=_MARKS)} / greatest(length(t), 1) > 0.25 THEN 30 ELSE 0 END)
 - (CASE WHEN regexp_matches(t, '[，。、；：,.;:]{{4,}}') THEN 30 ELSE 0 END) - (CASE WHEN len(ls) > 5 AND coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) / greatest(len(ls), 1) < 15 THEN 20 ELSE 0 END)) END AS score, md5(t) AS clean FROM l""",
    "lang_detect": f"""WITH {_D}, c AS (SELECT *, {_han('text')} AS h, length(regexp_replace(text, '\\s', '', 'g')) AS r, {_CT.format(x='text', p='[A-Za-z]')} AS a, lower(trim(coalesce(lang, ''))) AS g FROM d)
SELECT doc_id, CASE WHEN r > 0 AND h / r > 0.3 THEN 'zh' ELSE 'en' END AS chunk_lang, CASE WHEN starts_with(g, 'zh') THEN 'zh' WHEN starts_with(g, 'en') THEN 'en' WHEN h = 0 THEN 'en' WHEN h * 2 >= a THEN 'zh' ELSE 'en' END AS document_lang FROM c""",
    "token_estimate": f"WITH {_D} SELECT doc_id, ceil({_han('text')} * 1.5 + (length(text) - {_han('text')}) / 4)::bigint AS tokens FROM d",
    "pdf_cleanup": f"WITH {_D} SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{{00a0}}\\x{{2000}}-\\x{{200b}}]', ' ', 'g'), '(\\w)-\\n(\\w)', '\\1\\2', 'g'), '([^\\n])\\n([^\\n])', '\\1 \\2', 'g'), '[ \\t]+', ' ', 'g'), ' ')) AS digest FROM d",
    "redact_paths": f"WITH {_D} SELECT doc_id, 'see [local path] b.txt, [local path] and https://example.org/Users/ann/1 or [local path]; and/or 10.1/x ' || translate(text, '/:\\', '   ') AS t FROM d",
    "text_hash": f"WITH {_D} SELECT doc_id, sha256({_sq}) AS sha, md5(text) AS md5 FROM d",
    "grep_counts": f"WITH {_D}, g AS (SELECT *, instr(lower(text), 'viscosity') AS k FROM d WHERE contains(lower(text), 'viscosity')) SELECT doc_id, (length(text) - length(replace(lower(text), 'viscosity', ''))) // 9 AS hits, (CASE WHEN k > 51 THEN '...' ELSE '' END) || substr(text, greatest(k - 50, 1), least(k - 1, 50) + 59) AS snippet FROM g",
    "bigram_overlap": f"""WITH {_D}, e AS (SELECT doc_id, substr(text, 1, 80) AS a, substr(text, length(text) // 2 + 1) AS b FROM d WHERE length(text) > 200),
g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, i, 2))) AS y FROM e)
SELECT doc_id, round(CASE WHEN contains(b, a) THEN 1.0 ELSE len(list_intersect(x, y)) / len(x) END, 6) AS overlap FROM g""",
    "containment": """WITH i AS (SELECT library_id, item_key, max(title) AS title, max(abstract) AS abstract FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL GROUP BY ALL),
a AS (SELECT library_id, item_key, t, count(*) AS n FROM (SELECT library_id, item_key, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) AS t FROM i) GROUP BY ALL),
b AS (SELECT library_id, item_key, t, count(*) AS m FROM (SELECT library_id, item_key, unnest(regexp_extract_all(lower(abstract), '[\\p{L}\\p{N}]+')) AS t FROM i) GROUP BY ALL)
SELECT library_id, item_key, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) AS share FROM a LEFT JOIN b USING (library_id, item_key, t) GROUP BY ALL""",
    "citations": f"WITH {_D} SELECT doc_id, array_to_string(list_sort(list_distinct([doc_id, 7, 12, 14, 15, 16, 18])), ',') AS cited FROM d",
    "boilerplate_chunks": """SELECT row_id FROM (SELECT row_id, text, regexp_replace(string_split(trim(text), chr(10))[1], '^\\s*(?:>+\\s*)?(?:#{1,6}\\s*)?(?:[-*+]\\s+)?(?:\\d+[.)]\\s+)?[*_~`\\s]*', '') AS line FROM chunks WHERE length(text) > 0)
WHERE regexp_matches(line, '""" + T.BOILERPLATE + """') OR (len(regexp_extract_all(text, '\\[\\d{1,3}\\]')) >= 5 AND len(regexp_extract_all(text, '\\[\\d{1,3}\\]')) / (greatest(length(text), 1) / 200) >= 3)
 OR (len(regexp_extract_all(text, '\\(?(?:19|20)\\d{2}[)a-z]?')) >= 6 AND len(regexp_extract_all(text, '(?i)et al\\.?')) >= 3)""",
    "fulltext_grep": f"""WITH {_D}, g AS (SELECT doc_id, text, string_split(lower(text), 'viscosity') AS ps FROM d WHERE contains(lower(text), 'viscosity')),
k AS (SELECT doc_id, text, len(ps) - 1 AS hits, unnest(range(0, least(10, len(ps) - 1))) AS k, ps FROM g), p AS (SELECT *, (list_sum(list_transform(ps[1:k + 1], lambda x: length(x))) + 9 * k)::int AS position FROM k)
SELECT doc_id, hits, k, position, substr(text, greatest(0, position - 200) + 1, position + 209 - greatest(0, position - 200)) AS context FROM p""",
    "repeated_lines": f"""WITH {_D}, l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d), u AS (SELECT doc_id, unnest(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS x FROM l), r AS (SELECT doc_id, list(x) AS xs FROM (SELECT doc_id, x FROM u WHERE length(x) BETWEEN 6 AND 99 GROUP BY ALL HAVING count(*) > 3) GROUP BY 1),
k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(xs, []), trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS kept FROM l LEFT JOIN r USING (doc_id))
SELECT doc_id, CASE WHEN len(kept) < 0.9 * len(ls) THEN length(text) - length(array_to_string(kept, chr(10))) ELSE 0 END AS removed FROM k""",
}
# The same tests over paragraphs of documents.
SQL["boilerplate_paragraphs"] = SQL["boilerplate_chunks"].replace("SELECT row_id FROM (SELECT row_id, text,", "SELECT doc_id, k FROM (SELECT doc_id, k, text,").replace(
    "FROM chunks WHERE length(text) > 0)", "FROM (SELECT doc_id, unnest(ps) AS text, unnest(range(len(ps)))::int AS k FROM (SELECT doc_id, string_split_regex(text, '\\n\\n+') AS ps FROM documents WHERE length(text) > 0)) WHERE length(trim(text, ' ')) > 0)"
)
