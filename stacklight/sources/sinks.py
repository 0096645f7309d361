"""Where results go: postings laid out for look-ups, Markdown, JSON pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_postings(postings: DataFrame, path: str, files: int = 64) -> None:
    """Ranges of terms, sorted within: a look-up of a term reads the row groups whose bounds hold it. The term "the" may
    fill several files, for rows of one term are spread by document too."""
    postings.repartitionByRange(files, "term", *[c for c in ("library_id", "item_key") if c in postings.columns]).sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_markdown(lines: DataFrame, order: str, path: str) -> None:
    """One Markdown file per partition, lines in order."""
    lines.repartitionByRange(F.col(order)).sortWithinPartitions(order).select("line").write.mode("overwrite").text(path)


def envelope(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """(body): one page of ranked rows (``rank`` from 1) as JSON with its paging."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page = rows.filter((F.col("rank") > offset) & (F.col("rank") <= offset + min(limit, 500)))
    cells = page.agg(F.array_sort(F.collect_list(F.struct("rank", *[c for c in rows.columns if c != "rank"]))).alias("results"))  # one page
    more = F.col("total") > offset + F.size("results")
    paging = F.struct("total", F.size("results").alias("returned"), F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), more.alias("hasMore"), F.when(more, F.lit(offset) + F.size("results")).alias("nextOffset"))
    return cells.join(total).select(F.to_json(F.struct("results", paging.alias("pagination"))).alias("body"))
