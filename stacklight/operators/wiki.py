"""Concepts, their evidence and reviews: search by name or neighbour, the concept that entries merge into, states of evidence, review
snapshots, the queue of link scans, keys and orders of annotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.operators.graph import graph_score, one_hop

# Attempts of a scan; states of evidence and of the queue.
MAX_ATTEMPTS = 3
DEPTHS = ("chunk_local", "attach", "concept")


def concept_scores(concepts: DataFrame, terms: DataFrame, edges: DataFrame, words: list[str], floor: float = 0.0) -> DataFrame:
    """concepts(concept_id, name, text), terms(concept_id, term), edges(a, b) -> (concept_id, score, match_kind).

    Direct is the greatest share of the words in the name, the text, or both with all terms; a neighbour of a hit has a part of
    its score."""
    t = terms.groupBy("concept_id").agg(F.concat_ws(" ", F.array_sort(F.collect_set("term"))).alias("terms"))  # the names of one concept
    c = concepts.join(t, "concept_id", "left")
    direct = F.greatest(graph_score(F.concat_ws(" ", "text", "name", "terms"), words), graph_score(F.col("text"), words), graph_score(F.col("name"), words))
    d = c.select(F.col("concept_id").alias("node"), direct.alias("score")).filter("score > 0")
    s = one_hop(d, edges).filter((F.col("score") > 0) & (F.col("score") >= floor))
    return s.join(d.select("node", F.lit("direct").alias("k")), "node", "left").select(F.col("node").alias("concept_id"), "score", F.coalesce("k", F.lit("one_hop")).alias("match_kind"))


def documents_of(scores: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """evidence(concept_id, keys, confidence, depth) valid ones only -> (keys, score, concepts, direct, confidence, depth): concepts
    without evidence give no document."""
    e = evidence.groupBy("concept_id", *keys).agg(F.max("confidence").alias("confidence"), F.max("depth").alias("depth"))
    g = e.join(scores, "concept_id").groupBy(*keys)
    return g.agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("match_kind") == "direct").alias("direct"), F.max("confidence").alias("confidence"), F.max("depth").alias("depth")
    )


def merge_target(matches: DataFrame, concepts: DataFrame, primary: DataFrame) -> DataFrame:
    """matches(key, concept_id, term), concepts(concept_id, locked), primary(concept_id, completeness) -> (key, target, candidates,
    verdict): a pinned concept first, then the one that most terms of the entry lead to, then the most complete, then the first."""
    tally = matches.select("key", "concept_id", "term").distinct().groupBy("key", "concept_id").agg(F.count(F.lit(1)).alias("tally"))
    c = tally.join(concepts, "concept_id").join(primary, "concept_id", "left")
    best = F.struct(F.coalesce("locked", F.lit(False)).cast("int").alias("l"), "tally", F.coalesce("completeness", F.lit(0)).alias("c"), (-F.col("concept_id")).alias("i"))
    g = c.groupBy("key").agg(F.max_by("concept_id", best).alias("target"), F.count(F.lit(1)).alias("candidates"))
    return g.withColumn("verdict", F.when(F.col("candidates") > 1, "ambiguous").otherwise("ok"))


def evidence_state(exists: Column, chunks: Column, found: Column) -> Column:
    """source_deleted without its document, pending_relink while it has no chunks, valid where a chunk was found, else stale."""
    return F.when(~exists, "source_deleted").when(chunks == 0, "pending_relink").when(found, "valid").otherwise("stale")


def dependency(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, n, mark): what a statement rests on, as a digest of its rows that doesn't depend on their order and gathers no group."""
    h = F.xxhash64(*columns)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(":", F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).alias("mark"))


def revalidated(then: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, validity): valid while nothing that a statement rests on has changed."""
    j = then.select(key, F.col("mark").alias("old")).join(now.select(key, "mark"), key, "left")
    return j.select(key, F.when(F.col("mark") == F.col("old"), "valid").otherwise("needs_revalidation").alias("validity"))


def scan_queue(queue: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """queue(state, attempts, seen, actual, enqueued_at) after a restart: orphaned running scans wait again, finished ones whose
    document has changed too, failed ones until their attempts are used up; ``due`` where a waiting one's time has come, after
    a delay that doubles with each attempt."""
    stale = (F.col("state") == "done") & ~F.col("seen").eqNullSafe(F.col("actual"))
    retry = (F.col("state") == "failed") & (F.col("attempts") < most)
    after = F.when(F.col("state") == "running", "queued").when(stale | retry, "queued").otherwise(F.col("state"))
    wait = F.when(F.col("state") == "failed", F.pow(F.lit(2), F.col("attempts"))).otherwise(F.lit(0)) * 60
    q = queue.withColumn("after", after).withColumn("next_at", F.unix_seconds("enqueued_at") + wait.cast("long"))
    return q.withColumn("due", (F.col("after") == "queued") & (F.col("next_at") <= F.unix_seconds(now)))


def annotation_keys(own: Column, attachment: Column, attachment_parent: Column, note_parent: Column) -> dict[str, Column]:
    """Own key, attachment, document above it, and why there is none; empty keys count as none."""
    full = lambda c: F.when(c != "", c)
    a = full(attachment)
    source = F.when(a.isNotNull(), full(attachment_parent)).otherwise(full(note_parent))
    reason = F.when(source.isNull(), F.when(a.isNotNull(), "standalone_attachment").otherwise("standalone_note"))
    return {"annotation_key": own, "attachment_key": a, "source_key": source, "reason": reason}


def annotation_position(page: Column, sort_index: Column) -> Column:
    return F.coalesce(page, F.lit(0)) * 1000 + F.coalesce(sort_index, F.lit(0))


def first_by(rows: DataFrame, orders: dict[str, list[Column]], limit: int, name: str = "sort") -> DataFrame:
    """The first rows by each of several orders, with the order's name and a rank; each is a bounded top list."""
    out = None
    for n, o in orders.items():
        top = rows.orderBy(*o).limit(limit)
        part = top.withColumn("rank", F.row_number().over(Window.orderBy(*o))).withColumn(name, F.lit(n))  # ``limit`` rows
        out = part if out is None else out.unionByName(part)
    return out
