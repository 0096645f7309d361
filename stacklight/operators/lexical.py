"""Lexical index and ranking: postings, planned probes, two-regime BM25F, field-strength ranking, evidence.

A posting is (library_id, item_key, field, chunk_id, term, tf). Statistics are taken over all live documents. Probes are
few (at most MAX_PROBES keywords of a query), so their plans are broadcast; postings are filtered to the probes' terms
before anything is shuffled.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.session import cut

KEY = ["library_id", "item_key"]
MAX_PROBES = 16
# Fixed values: (boost, b) by field; k1; saturation of scores.
FIELDS = (("title", 3.0, 0.5), ("abstract", 1.6, 0.75), ("body", 1.4, 0.75), ("publicationTitle", 1.2, 0.4), ("creator", 1.2, 0.4), ("tags", 1.1, 0.4), ("extra", 0.4, 0.4))
K1 = 1.2
SATURATION = 4.0
# Spellings of one symbol, each an alternative of the other.
SYNONYMS = (("γ'", "gamma prime"), ("γ''", "gamma double prime"), ("α'", "alpha prime"), ("β'", "beta prime"))
# Weights of the field-strength ranking.
LEXICAL_WEIGHTS = (("title", 5.0), ("creator", 3.0), ("abstract", 2.0), ("tags", 2.5), ("publicationTitle", 1.5), ("extra", 1.0))


def field_texts(items: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(library_id, item_key, field, chunk_id, text): one row per non-empty field of the newest row of an item, and per
    newest delivery of a chunk. Metadata rows have chunk 0, so the field is part of every key."""
    order = Window.partitionBy(*KEY).orderBy(F.desc("date_modified"), "title")
    newest = items.dropna(subset=KEY).withColumn("r", F.row_number().over(order)).filter("r = 1")
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.lit(0).alias("chunk_id"), c.alias("text"))
            for n, c in (("title", F.col("title")), ("abstract", F.col("abstract")), ("tags", F.array_join("tags", ", ")), ("publicationTitle", F.col("publication_title")))
        ]
    )
    meta = newest.select(*KEY, F.explode(cells).alias("x")).select(*KEY, "x.*")
    if chunks is not None:
        meta = meta.unionByName(live_chunks(chunks).select(*KEY, F.lit("body").alias("field"), "chunk_id", "text"))
    return meta.filter(F.length("text") > 0)


def live_chunks(chunks: DataFrame) -> DataFrame:
    """The newest delivery of every chunk: keys are compared first and texts joined after, so hot papers move keys only."""
    last = chunks.dropna(subset=[*KEY, "chunk_id"]).groupBy(*KEY, "chunk_id").agg(F.max("row_id").alias("row_id"))
    return chunks.join(last.select("row_id"), "row_id", "left_semi")


def postings(texts: DataFrame, *keys: str, terms: list[str] | None = None) -> DataFrame:
    """Term counts of each text under ``keys``. With ``terms`` the other tokens go within the row, so that a look-up shuffles
    only what it asks for; without, every token of the corpus is counted and shuffled."""
    tokens = T.index_tokens(F.col("text"))
    tokens = F.filter(tokens, lambda t: t.isin(terms)) if terms is not None else tokens
    return texts.select(*keys, F.explode(tokens).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def asked_terms(probes: list[tuple[str, float]]) -> list[str]:
    """The terms of all plans of the probes."""
    return sorted({t for k, _ in probes[:MAX_PROBES] for _, ts, _, _ in plan(k) for t in ts})


def lengths(posted: DataFrame, *keys: str) -> DataFrame:
    """Field lengths: all tokens count, variants too."""
    return posted.groupBy(*keys).agg(F.sum("tf").alias("len"))


def idf(n: Column, df: Column) -> Column:
    d = F.least(F.greatest(df.cast("double"), F.lit(0.0)), n.cast("double"))
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.log1p((n - d + 0.5) / (d + 0.5))))


def weighted_frequency(tf: Column, length: Column, mean: Column, boost: Column, b: Column) -> Column:
    ratio = F.when((mean > 0) & (length > 0), length / mean).otherwise(F.lit(1.0))
    return boost * tf / (1 - b + b * ratio)


def saturate(score: Column, k: float = SATURATION) -> Column:
    return F.when(score > 0, score / (score + k)).otherwise(F.lit(0.0))


# --- planning a query (on the driver: a query has at most MAX_PROBES keywords) ---


def fold(text: str) -> str:
    s = unicodedata.normalize("NFKC", text)
    return s.translate(str.maketrans({**dict.fromkeys(T.DASHES, "-"), **dict.fromkeys(T.PRIMES, "'")})).lower().strip()


def exact_terms(text: str) -> list[str]:
    """Distinct tokens as written, without variants; Han as pairs."""
    f = fold(text)
    out = [t for t in re.findall(T.LATIN_TOKEN, f) if len(t) >= 2 or re.match("^[Ͱ-Ͽ]$", t)]
    for run in re.findall(f"[{T.HAN}]+", f):
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
    return list(dict.fromkeys(out))


def plan(keyword: str) -> list[tuple[int, list[str], bool, str]]:
    """(plan number, terms, verify, phrase): the keyword first, then its alternatives. A plan needs no verification only
    if it is one term and that term is the whole keyword."""
    base = fold(keyword)
    phrases = [base]
    hard = re.sub(r"[-_./]", "", base)
    if hard != base and " " not in base:
        phrases.append(hard)
    for a, b in SYNONYMS:
        phrases += [base.replace(x, y) for x, y in ((a, b), (b, a)) if x in base]
    out = []
    for p in dict.fromkeys(phrases):
        terms = exact_terms(p)
        if terms:
            out.append((len(out), terms, not (len(terms) == 1 and terms[0] == p), p))
    return out


def normalize_keywords(keywords: list[str]) -> list[str]:
    """Trimmed, at most 120 characters and 16 entries, the first of entries equal but for case."""
    seen: dict[str, str] = {}
    for k in keywords:
        k = k.strip()[:120]
        if k:
            seen.setdefault(k.lower(), k)
    return list(seen.values())[:MAX_PROBES]


def plans(spark: SparkSession, probes: list[tuple[str, float]]) -> DataFrame:
    """(probe, weight, plan_no, term, n_terms, verify, phrase): one row per term of each plan."""
    rows = [(k, float(w), n, t, len(terms), verify, phrase) for k, w in probes[:MAX_PROBES] for n, terms, verify, phrase in plan(k) for t in terms]
    return spark.createDataFrame(rows, "probe string, weight double, plan_no int, term string, n_terms int, verify boolean, phrase string")


# --- evaluating it ---


def conjunction(posted: DataFrame, planned: DataFrame, *keys: str) -> DataFrame:
    """(keys, probe, weight, plan_no, verify, phrase, tf): places where all terms of a plan stand; tf is the least count.
    The first plan that hits a place wins."""
    hit = posted.join(F.broadcast(planned), "term")
    g = hit.groupBy(*keys, "probe", "weight", "plan_no", "verify", "phrase", "n_terms").agg(F.min("tf").alias("tf"), F.count(F.lit(1)).alias("got"))
    first = Window.partitionBy(*keys, "probe").orderBy("plan_no")
    full = g.filter("got = n_terms").withColumn("r", F.row_number().over(first)).filter("r = 1")
    return full.select(*keys, "probe", "weight", "plan_no", "verify", "phrase", "tf")


def verified(hits: DataFrame, texts: DataFrame, *keys: str) -> DataFrame:
    """Hits whose phrase really stands in the text. Hits that need no proof never meet their text."""
    sure = hits.filter("not verify")
    ask = hits.filter("verify").join(texts.select(*keys, "text"), list(keys)).filter(F.contains(T.fold(F.col("text")), F.col("phrase")))
    return sure.unionByName(ask.drop("text"))


def bm25f(texts: DataFrame, probes: list[tuple[str, float]]) -> DataFrame:
    """(library_id, item_key, score, matched, normalized): metadata fields saturate together, the body on its own.

    Averages and N are of the whole input, never of the matches; documents that match in the body only take part."""
    spark = texts.sparkSession
    place = [*KEY, "field", "chunk_id"]
    planned = plans(spark, probes)
    terms = asked_terms(probes)
    # One pass over the texts: the number of tokens, and the few that the query asks for; nothing else is exploded or shuffled.
    tokens = T.index_tokens(F.col("text"))
    base = cut(texts.select(*place, F.size(tokens).alias("size"), F.filter(tokens, lambda t: t.isin(terms)).alias("asked")))
    posted = base.select(*place, F.explode("asked").alias("term")).groupBy(*place, "term").agg(F.count(F.lit(1)).alias("tf"))
    found = verified(conjunction(posted, planned, *place), texts, *place)
    per_field = found.groupBy(*KEY, "field", "probe", "weight").agg(F.sum("tf").alias("tf"))
    size = base.groupBy(*KEY, "field").agg(F.sum("size").alias("len"))
    n = base.agg(F.count_distinct(*KEY).alias("n"), F.count_distinct(*[F.when(F.col("field") == "body", F.col(k)) for k in KEY]).alias("n_body"))
    mean = size.groupBy("field").agg(F.sum("len").alias("total")).join(n).select("field", (F.col("total") / F.col("n")).alias("mean"))  # one row per field
    params = spark.createDataFrame(list(FIELDS), "field string, boost double, b double")
    known = params.join(mean, "field")  # as many rows as fields
    w = per_field.join(size, [*KEY, "field"]).join(F.broadcast(known), "field")
    w = w.withColumn("w", weighted_frequency(F.col("tf"), F.col("len"), F.col("mean"), F.col("boost"), F.col("b")))
    regime = w.groupBy(*KEY, "probe", "weight", (F.col("field") == "body").alias("body")).agg(F.sum("w").alias("w"))
    df = regime.groupBy("probe", "body").agg(F.count(F.lit(1)).alias("df"))  # a few rows
    scored = regime.join(F.broadcast(df), ["probe", "body"]).join(F.broadcast(n))
    total = F.when(F.col("body"), F.col("n_body")).otherwise(F.col("n"))
    part = idf(total, F.greatest(F.col("df"), F.lit(1))) * F.col("w") / (K1 + F.col("w")) * F.col("weight")
    out = scored.groupBy(*KEY).agg(F.round(F.sum(part), 6).alias("score"), F.count_distinct("probe").alias("matched"))
    return out.withColumn("normalized", F.round(saturate(F.col("score")), 6)).withColumn("coverage", F.round(coverage(F.col("matched"), len(probes[:MAX_PROBES])), 6))


def coverage(matched: Column, asked: int) -> Column:
    """Share of the query's keywords that a document has, 1 at most."""
    return F.least(F.lit(1.0), matched / F.lit(asked)) if asked > 0 else F.lit(0.0)


def keyword_page(scored: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of a keyword search: by score, then by the number of keywords, then by key. Only the page's rows are sorted whole."""
    order = [F.desc("score"), F.desc("matched"), *KEY]
    top = scored.orderBy(*order).limit(offset + limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)  # offset + limit rows


def best_evidence(found: DataFrame, keep: int = 3) -> DataFrame:
    """The ``keep`` best chunks of a document: most probes, then most occurrences, then the first."""
    g = found.filter("field = 'body'").groupBy(*KEY, "chunk_id").agg(F.count_distinct("probe").alias("probes"), F.sum("tf").alias("occurrences"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("probes"), F.desc("occurrences"), "chunk_id")
    return g.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def strength(text: Column, keyword: str) -> Column:
    """Occurrences saturate at 4; a hit inside a longer word counts 0.45; a field equal to the keyword 1.25 times."""
    k = keyword.lower()
    q = re.escape(k) if not re.search(f"[{T.HAN}]", k) else k
    low = F.lower(text)
    n = F.least(F.regexp_count(low, F.lit(q)), F.lit(4))
    edge = F.lit(True) if re.search(f"[{T.HAN}]", k) else F.rlike(low, F.lit(rf"(?:^|[^\p{{L}}\p{{N}}_]){q}(?:[^\p{{L}}\p{{N}}_]|$)"))
    s = F.when(edge, F.lit(1.0)).otherwise(F.lit(0.45)) * (1 + 0.25 * F.log(n.cast("double")))
    return F.when(n > 0, s * F.when(low == k, F.lit(1.25)).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def lexical_rank(texts: DataFrame, probes: list[tuple[str, float]], weights: tuple = LEXICAL_WEIGHTS, keys: tuple = tuple(KEY), by: tuple = ()) -> DataFrame:
    """(keys, score, matched, fields): specificity is taken over the matching pool, of each search (``by``) its own."""
    w = F.create_map(*[x for f, v in weights for x in (F.lit(f), F.lit(v))])[F.col("field")]
    cells = F.array(*[F.struct(F.lit(k).alias("probe"), F.lit(float(v)).alias("weight"), strength(F.col("text"), k).alias("s")) for k, v in probes])
    long = texts.select(*keys, "field", w.alias("fw"), F.explode(cells).alias("p")).select(*keys, "field", "fw", "p.*").filter("fw is not null and s > 0")
    per = long.groupBy(*keys, "probe", "weight").agg(F.sum(F.col("fw") * F.col("s")).alias("k"), F.collect_set("field").alias("fs"))
    pool = per.select(*keys).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("pool"))
    df = per.groupBy(*by, "probe").agg(F.count(F.lit(1)).alias("df"))
    top = F.log1p(F.col("pool").cast("double"))
    per = per.join(df, [*by, "probe"]).join(pool, list(by)) if by else per.join(F.broadcast(df), "probe").join(F.broadcast(pool))
    spec = F.least(F.lit(1.0), F.log1p(F.col("pool") / (1 + F.col("df"))) / top)
    out = per.groupBy(*keys).agg(F.sum(F.col("weight") * spec * F.col("k")).alias("base"), F.count(F.lit(1)).alias("matched"), F.size(F.array_distinct(F.flatten(F.collect_list("fs")))).alias("fields"))
    score = F.col("base") * (1 + 0.2 * (F.col("matched") - 1)) * (1 + 0.08 * (F.col("fields") - 1))
    return out.select(*keys, F.round(score, 6).alias("score"), "matched", "fields")


def compact(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of live documents only: a document is live under its greatest doc_id."""
    live = docs.groupBy(*KEY).agg(F.max("doc_id").alias("doc_id"))
    return index.join(live.select("doc_id"), "doc_id", "left_semi")


def within_budget(index: DataFrame, terms: DataFrame, budget: int) -> DataFrame:
    """Postings of the query's terms read rarest first until the budget would be exceeded; (term, postings, truncated)."""
    n = index.join(F.broadcast(terms), "term").groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    order = Window.orderBy("postings", "term")  # one row per term of a query
    return n.withColumn("truncated", F.sum("postings").over(order) > budget)
