"""Ranks and positions over more rows than one task should sort.

Rows are put into coarse buckets that follow the order; the buckets are counted, their offsets summed (one small row per
bucket), and rows are numbered within their bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_bucket(score: Column, steps: int = 4096) -> Column:
    """Falls as the score rises; scores outside [-64, 64] share the outer buckets."""
    return (-F.floor(F.greatest(F.least(score, F.lit(64.0)), F.lit(-64.0)) * steps)).cast("long")


def text_bucket(text: Column, n: int = 3) -> Column:
    """The first characters, in the order of the text; nulls last."""
    return F.coalesce(F.substring(text, 1, n), F.lit("\U0010ffff"))


def ranked(rows: DataFrame, bucket: Column, *order, name: str = "rank", by: list[str] = []) -> DataFrame:  # noqa: B006
    """``rows`` with ``name`` from 1 in ``order``, within ``by`` if given; ``bucket`` must not fall where ``order`` rises."""
    b = rows.withColumn("_bucket", bucket)
    counts = b.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return b.withColumn("_in", inside).join(offsets, [*by, "_bucket"]).withColumn(name, (F.col("_offset") + F.col("_in")).cast("int")).drop("_bucket", "_in", "_offset")


def positions(rows: DataFrame, keys: list[str], order: str, tie: str, block: int = 1024, name: str = "position") -> DataFrame:
    """``rows`` with ``name`` from 0 within ``keys`` by (order, tie): numbered in blocks of ``order``, whose offsets are summed,
    so a key with a third of all rows is spread over many tasks."""
    b = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = b.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order, tie)) - 1
    return b.withColumn("_in", inside).join(offsets, [*keys, "_block"]).withColumn(name, F.col("_offset") + F.col("_in")).drop("_block", "_in", "_offset")
