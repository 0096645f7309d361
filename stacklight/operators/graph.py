"""Links between documents: shared concepts, shared rare terms, one-hop expansion, terms and evidence (by vectors: ``links``).

Pairs are canonical (a < b). Operators that the application bounds (concepts held by too many documents make no edges)
keep that bound as a parameter, for it is the feature.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators.ranking import ranked
from stacklight.session import cut

# Words and units that make no lexical signal.
NO_SIGNAL = (
    "newly", "almost", "already", "however", "therefore", "furthermore", "moreover", "typically", "generally", "usually", "mainly", "largely", "previously",
    "recently", "herein", "therein", "whereas", "respectively", "supplementary", "copyright", "publisher", "permissions", "acknowledgements", "acknowledgments",
    "arise", "arises", "arising", "ambiguity", "shown", "showing", "black", "white", "red", "green", "blue", "yellow",
)
NO_UNIT = ("min", "sec", "hrs", "hour", "hours", "mpa", "gpa", "kpa", "kgf", "mol", "wt", "vol", "rpm", "kev", "mev", "khz", "mhz", "mmin", "cmin", "kmin", "ksec", "msec", "umin", "mms", "nms", "ums", "kjmol", "jmol", "wmk")
NO_MARKUP = (
    "mathtt", "mathrm", "mathbf", "mathit", "mathcal", "mathbb", "mathsf", "textbf", "textit", "textrm", "texttt", "emph", "colon", "bullet", "cdot", "times",
    "quad", "qquad", "hspace", "vspace", "begin", "end", "item", "label", "caption", "footnote", "frac", "sqrt", "sum", "int", "lim", "log", "exp", "left",
    "right", "overline", "underline", "widehat", "tilde", "rightarrow", "leftarrow", "approx", "leq", "geq", "neq", "pm",
)
NO_GREEK = ("alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega")
CLIQUE = 40


def usable_term(term: Column) -> Column:
    letters = F.lower(F.regexp_replace(term, r"[^\p{L}]", ""))
    n, digits = F.length(letters), F.regexp_count(term, F.lit("[0-9]"))
    shaped = F.rlike(letters, F.lit("^[a-z]{0,3}(?:min|sec|hr|hrs|mpa|gpa|kpa|mol|rpm)$")) | F.rlike(F.lower(term), F.lit("^[a-z]{1,3}[/·-][a-z]{1,4}[0-9]*$"))
    listed = F.lower(term).isin(*NO_SIGNAL) | letters.isin(*NO_UNIT, *NO_MARKUP, *NO_GREEK)
    return (n > 0) & ~T.has_han(term) & ((n >= 3) | ((n >= 2) & (digits >= 3))) & ~listed & ~shaped


def concept_edges(readings: DataFrame, group: str, doc: str, concept: str, clique: int = CLIQUE) -> DataFrame:
    """readings(group, doc, concept) distinct -> (group, a, b, score, strength, shared): idf ln((N+1)/(df+1)) summed over the
    concepts that two documents share; concepts of fewer than 2 or more than ``clique`` documents make no edge, which
    bounds the pairs of a concept by clique²/2."""
    r = readings.select(F.col(group).alias("g"), F.col(doc).alias("d"), F.col(concept).alias("c")).dropna().distinct()
    n = r.groupBy("g").agg(F.count_distinct("d").alias("n"))
    df = r.groupBy("g", "c").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= 2) & (F.col("df") <= clique))
    k = r.join(df, ["g", "c"]).join(n, "g").withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)))
    left = k.select("g", "c", F.col("d").alias("a"), "idf")
    pairs = left.join(k.select("g", "c", F.col("d").alias("b")), ["g", "c"]).filter("a < b")
    return pairs.groupBy("g", "a", "b").agg(F.round(F.sum("idf"), 6).alias("score"), F.count(F.lit(1)).alias("shared")).withColumn("strength", F.least(F.lit(3.0), 1 + F.col("score")))


def shared_rare_terms(pairs: DataFrame, texts: DataFrame, keep: int = 3) -> DataFrame:
    """pairs(g, a, b), texts(g, d, chunk_id, text) -> the ``keep`` rarest usable terms of each pair with the first chunk on both sides
    that holds them; (g, a, b, t, score, rank, a_chunk, b_chunk).

    Terms are folded to the first chunk of each document; one in a single document can't be shared and goes, like one in more than
    a quarter of all. Only documents that are asked meet, and terms travel as numbers until they are chosen."""
    words = texts.select("g", "d", "chunk_id", F.explode(F.array_distinct(T.query_tokens(F.col("text")))).alias("t")).groupBy("g", "d", "t").agg(F.min("chunk_id").alias("chunk"))
    n = texts.groupBy("g").agg(F.count_distinct("d").alias("n"))
    df = words.groupBy("g", "t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").join(n, "g")
    df = df.filter((F.col("df") <= F.floor(F.col("n") * 0.25)) & usable_term(F.col("t")))
    score = F.round(F.least(F.lit(1.0), F.log((F.col("n") + 1) / (F.col("df") + 1)) / (F.log(F.col("n") + 1.0) * 0.85)), 6)
    asked = pairs.select("g", F.col("a").alias("d")).union(pairs.select("g", F.col("b"))).distinct()
    rare = cut(words.join(df.select("g", "t", score.alias("score")), ["g", "t"]).join(asked, ["g", "d"], "left_semi"))
    terms = rare.groupBy("g", "d").agg(F.collect_list(F.xxhash64("t")).alias("hs"))  # the terms of one document
    hs = terms
    both = pairs.join(hs.select("g", F.col("d").alias("a"), F.col("hs").alias("x")), ["g", "a"]).join(hs.select("g", F.col("d").alias("b"), F.col("hs").alias("y")), ["g", "b"])
    shared = both.select("g", "a", "b", F.explode(F.array_intersect("x", "y")).alias("h"))
    hit = rare.select("g", F.xxhash64("t").alias("h"), "t", "score").distinct()
    w = Window.partitionBy("g", "a", "b").orderBy(F.desc("score"), "t")
    top = shared.join(hit, ["g", "h"]).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    sides = {s: rare.select("g", F.col("d").alias(s), "t", F.col("chunk").alias(f"{s}_chunk")) for s in ("a", "b")}
    return top.join(sides["a"], ["g", "a", "t"]).join(sides["b"], ["g", "b", "t"]).select("g", "a", "b", "t", "score", "rank", "a_chunk", "b_chunk")


def one_hop(scores: DataFrame, edges: DataFrame, damp: float = 0.72) -> DataFrame:
    """scores(node, score), edges(a, b) undirected -> the best of a node's own score and ``damp`` times a neighbour's."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    far = both.join(scores, "node").select(F.col("to").alias("node"), (F.col("score") * damp).alias("score"), F.lit(1).alias("hop"))
    return scores.select("node", "score", F.lit(0).alias("hop")).unionByName(far).groupBy("node").agg(F.round(F.max("score"), 6).alias("score"), F.min_by("hop", F.struct(-F.col("score"), F.col("hop"))).alias("hop"))


def graph_score(text: Column, words: list[str]) -> Column:
    """Share of the query's words that stand in the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.least(F.lit(1.0), sum((F.when(low.contains(w.lower()), 1.0).otherwise(0.0) for w in words), F.lit(0.0)) / max(1, len(words)))


def neighbours(chunks: DataFrame, anchors: DataFrame, doc: list[str], radius: int) -> DataFrame:
    """Chunks within ``radius`` of an anchor, anchors left out, at the least distance; an equi-join on exploded numbers."""
    near = anchors.select(*doc, "chunk_id", F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("by")).select(*doc, (F.col("chunk_id") + F.col("by")).alias("chunk_id"), F.abs("by").alias("distance"))
    least = near.groupBy(*doc, "chunk_id").agg(F.min("distance").alias("distance")).filter("distance > 0")
    return chunks.join(least, [*doc, "chunk_id"])


def primary_terms(terms: DataFrame) -> DataFrame:
    """Of each concept the most complete term, then the one first in order."""
    n = sum((F.when(F.length(c) > 0, 1).otherwise(0) for c in ("name_zh", "name_en", "abbreviation")), F.lit(0))
    w = Window.partitionBy("concept_id").orderBy(F.desc("completeness"), "term_id")
    return terms.withColumn("completeness", n).withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def name_kind(name: Column) -> Column:
    """zh where it has Han, abbreviation where it is short capitals, else en."""
    return F.when(F.rlike(name, F.lit(f"[{T.HAN}]")), "zh").when(F.rlike(name, F.lit("^[A-Z][A-Z0-9-]{1,9}$")), "abbreviation").otherwise("en")


def name_units(name: Column) -> Column:
    """Length with each run of ASCII letters and digits as one unit."""
    return F.length(F.regexp_replace(F.regexp_replace(name, r"\s", ""), "[A-Za-z0-9]+", "a"))


def concept_match(names: DataFrame, terms: DataFrame) -> DataFrame:
    """names(key, name) -> concepts of the same normalised English or Han name: two equi-joins, no disjunction."""
    norm = lambda c: F.lower(T.squeeze(c))
    n = names.select("key", norm(F.col("name")).alias("k")).filter("k <> ''")
    t = terms.select("concept_id", norm(F.col("name_en")).alias("k")).union(terms.select("concept_id", norm(F.col("name_zh")).alias("k"))).filter("k <> ''").distinct()
    return n.join(t, "k").select("key", "concept_id").distinct()


def reconcile(left: Column, right: Column, left_origin: Column, right_origin: Column) -> Column:
    """What becomes of a field of two terms: keep, fill, promote, correct or conflict; origins rank user, literature, ai."""
    rank = lambda o: F.when(o == "user", 3).when(o == "literature", 2).when(o == "ai", 1).otherwise(0)
    a, b = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    same = F.lower(a) == F.lower(b)
    return (
        F.when(b == "", "keep").when(a == "", "fill").when(same & (rank(right_origin) > rank(left_origin)), "promote").when(same, "keep")
        .when(rank(right_origin) > rank(left_origin), "correct").when(rank(right_origin) < rank(left_origin), "keep").otherwise("conflict")
    )


def link_status(counts: dict[str, Column], deleted: Column | None = None) -> Column:
    """source_deleted for good where an end is gone; else open, resolved, dismissed or stale from the counts of pending, accepted,
    rejected and stale signals."""
    return (
        F.when(F.lit(False) if deleted is None else deleted, "source_deleted").when(counts["pending"] > 0, "open").when(counts["accepted"] > 0, "resolved").when(counts["rejected"] > 0, "dismissed").when(counts["stale"] > 0, "stale").otherwise("open")
    )


def document_groups(members: DataFrame, doc: list[str], claim: str) -> DataFrame:
    """Each document's rarest claim, and a dense number of that claim from 0."""
    n = members.groupBy(claim).agg(F.count_distinct(*doc).alias("supporters"))
    w = Window.partitionBy(*doc).orderBy("supporters", claim)
    one = members.select(*doc, claim).distinct().join(n, claim).withColumn("r", F.row_number().over(w)).filter("r = 1")
    # The distinct claims that were chosen are numbered, not the documents.
    numbers = ranked(one.select(claim).distinct(), F.floor(F.col(claim) / 1024), F.col(claim)).withColumn("colour", F.col("rank") - 1).drop("rank")
    return one.join(numbers, claim).select(*doc, claim, "supporters", "colour")


def relocate(excerpts: DataFrame, chunks: DataFrame, doc: list[str], least: float = 0.72, block: int = 1024) -> DataFrame:
    """excerpts(key, doc, excerpt) -> (key, row_id, overlap, how): the chunk with the same hash, else the one of the same
    document that overlaps most, if by ``least``: 1 where it contains the excerpt, else the share of its character pairs.

    A document's chunks are cut into blocks that each meet all of its excerpts; of an excerpt a block gives its best chunk only."""
    e = excerpts.withColumn("excerpt", T.squeeze(F.col("excerpt"))).withColumn("h", F.sha2("excerpt", 256))
    c = chunks.select(*doc, "row_id", T.squeeze(F.col("text")).alias("text"))
    same = e.join(c.select(*doc, F.sha2("text", 256).alias("h"), "row_id"), [*doc, "h"]).groupBy("key").agg(F.min("row_id").alias("row_id")).select("key", "row_id", F.lit(1.0).alias("overlap"), F.lit("hash").alias("how"))
    left = e.join(same, "key", "left_anti").filter(F.length("excerpt") > 0)
    n = c.groupBy(*doc).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    ask = left.join(n, doc).select(*[F.col(k).alias(f"e_{k}") for k in doc], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("e_block"), "key", "excerpt")
    hay = c.join(n, doc).join(left.select(*doc).distinct(), doc, "left_semi").withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")).cast("int"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
        rows = sorted(zip(right["row_id"], right["text"]))
        sets = [pairs(t) for _, t in rows]
        out = []
        for key, x in zip(left["key"], left["excerpt"]):
            own, top = pairs(x), (0.0, None)
            for (row, text), have in zip(rows, sets):
                share = 1.0 if x in text else len(own & have) / len(own) if own else 0.0
                if share > top[0]:
                    top = (share, row)
            if round(top[0], 6) >= least:
                out.append((key, top[1], round(top[0], 6)))
        return pd.DataFrame(out, columns=["key", "row_id", "overlap"])

    kind = excerpts.schema["key"].dataType.simpleString()
    near = ask.groupBy(*[f"e_{k}" for k in doc], "e_block").cogroup(hay.groupBy(*doc, "block")).applyInPandas(best, f"key {kind}, row_id long, overlap double")
    near = near.groupBy("key").agg(F.max(F.struct("overlap", (-F.col("row_id")).alias("m"))).alias("b")).select("key", (-F.col("b.m")).alias("row_id"), "b.overlap", F.lit("overlap").alias("how"))
    return same.unionByName(near)


def diversified(claims: pd.DataFrame, limit: int = 5) -> pd.DataFrame:
    """Greedy choice: confidence, and bonuses for a new type (.08), a new source (.14) and a limitation (.08); repeated texts
    count once. For the claims of one concept."""
    left = claims.sort_values(["confidence", "claim_id"], ascending=[False, True]).drop_duplicates("text").to_dict("records")
    kinds: set = set()
    sources: set = set()
    out: list[dict] = []
    while left and len(out) < limit:
        best = max(left, key=lambda c: (c["confidence"] + 0.08 * (c["kind"] not in kinds) + 0.14 * (c["source"] not in sources) + 0.08 * bool(c["limitation"]), -c["claim_id"]))
        left.remove(best)
        out.append(best | {"rank": len(out) + 1})
        kinds.add(best["kind"])
        sources.add(best["source"])
    return pd.DataFrame(out, columns=[*claims.columns, "rank"])


def summary_claims(claims: DataFrame, limit: int = 5) -> DataFrame:
    """claims(concept_id, claim_id, text, confidence, kind, source, limitation) -> the chosen ones by concept.

    A text counts once. Claims of equal kind, source and limitation get equal bonuses at every step, so no more than the best
    ``limit`` of them can be chosen: only these are sent to the greedy choice."""
    row = F.struct("confidence", (-F.col("claim_id")).alias("m"), "kind", "source", "limitation")
    one = claims.groupBy("concept_id", "text").agg(F.max(row).alias("b")).select("concept_id", (-F.col("b.m")).alias("claim_id"), "text", "b.confidence", "b.kind", "b.source", "b.limitation")
    w = Window.partitionBy("concept_id", "kind", "source", "limitation").orderBy(F.desc("confidence"), "claim_id")
    top = one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= limit).drop("r")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in top.schema)
    return top.groupBy("concept_id").applyInPandas(lambda pdf: diversified(pdf, limit), f"{kinds}, rank int")
