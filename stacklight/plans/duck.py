"""Pieces of DuckDB SQL that several oracle queries share; the table of fixed values is the functions' own."""

from stacklight.functions import text as T

Q = "''"
PAIRS, FOLDED = T.FOLD_FROM.replace("'", Q), T.FOLD_TO.replace("'", Q)


def fold(x: str) -> str:
    return f"lower(translate({x}, '{PAIRS}', '{FOLDED}'))"


LATIN = T.LATIN_TOKEN.replace("'", Q)


def latin(folded: str) -> str:
    return f"list_filter(regexp_extract_all({folded}, '{LATIN}'), lambda t: length(t) >= 2 OR regexp_matches(t, '^[Ͱ-Ͽ]$'))"


def spelled(t: str) -> str:
    for g, s in T.GREEK:
        t = f"replace({t}, '{g}', '{s}')"
    return t


def variants(t: str) -> str:
    solid = f"regexp_replace({t}, '[-_./]', '', 'g')"
    return f"list_filter(list_distinct([{t}, {solid}, {spelled(t)}, {spelled(solid)}]), lambda v: length(v) >= 2 OR regexp_matches(v, '^[Ͱ-Ͽ]$'))"


def han(folded: str) -> str:
    run = f"regexp_extract_all({folded}, '[{T.HAN}]+')"
    return f"flatten(list_transform({run}, lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END))"


def index_tokens(x: str) -> str:
    f = fold(x)
    return f"list_concat(flatten(list_transform({latin(f)}, lambda t: {variants('t')})), {han(f)})"


NEWEST = "items_ AS (SELECT * FROM items WHERE library_id IS NOT NULL AND item_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY library_id, item_key ORDER BY date_modified DESC NULLS LAST, title) = 1)"
LIVE = "chunks_ AS (SELECT * FROM chunks WHERE row_id IN (SELECT max(row_id) FROM chunks WHERE library_id IS NOT NULL AND item_key IS NOT NULL AND chunk_id IS NOT NULL GROUP BY library_id, item_key, chunk_id))"
TEXTS = f"""{NEWEST}, {LIVE},
texts_ AS (
  SELECT * FROM (
    SELECT library_id, item_key, 'title' AS field, 0 AS chunk_id, title AS text FROM items_
    UNION ALL SELECT library_id, item_key, 'abstract', 0, abstract FROM items_
    UNION ALL SELECT library_id, item_key, 'tags', 0, array_to_string(tags, ', ') FROM items_
    UNION ALL SELECT library_id, item_key, 'publicationTitle', 0, publication_title FROM items_
    UNION ALL SELECT library_id, item_key, 'body', chunk_id, text FROM chunks_
  ) WHERE length(text) > 0
)"""
POSTED = f"""{TEXTS},
posted AS (SELECT library_id, item_key, field, chunk_id, term, count(*) AS tf FROM (SELECT library_id, item_key, field, chunk_id, unnest({index_tokens('text')}) AS term FROM texts_) GROUP BY ALL)"""


def posted_terms(terms: str) -> str:
    """The postings of some terms."""
    return f"posted AS (SELECT library_id, item_key, field, chunk_id, term, count(*) AS tf FROM (SELECT library_id, item_key, field, chunk_id, unnest({index_tokens('text')}) AS term FROM texts_) WHERE term IN {terms} GROUP BY ALL)"
