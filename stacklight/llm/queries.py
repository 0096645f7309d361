"""Queries pN_... over the test tables; each reads whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.llm import canonical, cooccurrence, mixing, nearest, scanned, spans, splitting, tokenize
from stacklight.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs, terms = table(spark, sf_dir, "wiki_concept_inputs"), table(spark, sf_dir, "wiki_concept_terms")
    mapped = canonical.map_names(inputs, terms)
    return mapped.join(canonical.asked(inputs, terms), "input_id", "left_semi").select("input_id", "concept_id")


def p1_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_names(table(spark, sf_dir, "wiki_concept_inputs"), table(spark, sf_dir, "wiki_concept_terms"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "chunks"))


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.numbered_pieces(table(spark, sf_dir, "chunks"))


def p2_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.corrected_sessions(table(spark, sf_dir, "wiki_reading_sessions"), table(spark, sf_dir, "chunks"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cooccurrence.concept_readings(table(spark, sf_dir, "wiki_concept_term_sources"), table(spark, sf_dir, "wiki_concept_terms"))
    return cooccurrence.cooccurrence(r, "library_id", "paper", "concept_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.found_pairs(_pairs(spark, sf_dir)).select(F.col("g").alias("library_id"), F.col("a").alias("concept_a"), F.col("b").alias("concept_b"))


def p3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir)
    return d.select(F.col("g").alias("library_id"), F.col("a").alias("concept_a"), F.col("b").alias("concept_b"), "n_ab", "n_a", "n_b", F.col("n").alias("n_papers"), F.round("lift", 6).alias("lift"), F.round("conviction", 6).alias("conviction"))


def _noise(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return scanned.noise(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "items"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.found_noise(_noise(spark, sf_dir))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned.repaired(table(spark, sf_dir, "chunks"), _noise(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.near_pairs(nearest.top_k(table(spark, sf_dir, "vectors_f32")))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "vectors_f32")
    near = nearest.top_k(v)
    chunk = lambda p: v.select(F.col("id").alias(f"{p}id"), F.col("library_id").alias(f"{p}library_id"), F.col("item_key").alias(f"{p}item_key"), F.col("chunk_id").alias(f"{p}chunk_id"))
    near = near.select(F.col("id").alias("query_id"), "rank", F.col("neighbour").alias("hit_id"), "cosine")
    return near.join(chunk("query_"), "query_id").join(chunk("hit_"), "hit_id")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_table(table(spark, sf_dir, "documents"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[0]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir)[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, pairs, _ = spans.shared_spans(table(spark, sf_dir, "documents"))
    return spans.found_pairs(own, pairs)


def p8_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    own, _, merged = spans.shared_spans(d)
    return spans.shared_report(d, own, merged)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and "_" in k}


def oracle_sql() -> dict[str, str]:
    from stacklight.llm.sql import ORACLE

    return dict(ORACLE)
