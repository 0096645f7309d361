"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stacklight.plans import extras, fusion, graph, lexical, maintenance, notes, streaming, structured, textprep, vectors, wiki

MODULES = (lexical, vectors, fusion, structured, textprep, graph, notes, wiki, extras, maintenance, streaming)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in MODULES for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_body_topk(spark, sf_dir)
