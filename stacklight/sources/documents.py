"""Full texts from files: plain text, HTML, Markdown and cached extracts, one row per file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stacklight.operators.pages import page_text

# File endings by kind of source, in the order in which one stands for a paper.
KINDS = (("cached", r"\.cache\.txt$"), ("text", r"\.(?:txt|md)$"), ("html", r"\.html?$"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, paper, kind, text): the paper is the file's folder; files of other kinds are left out."""
    raw = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    kind = F.coalesce(*[F.when(F.rlike(F.lower("path"), F.lit(p)), n) for n, p in KINDS])
    rows = raw.select("path", F.element_at(F.split("path", "/"), -2).alias("paper"), kind.alias("kind"), "text").filter("kind is not null")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[page_text(t, markdown=False) for t in pdf["text"]])

    pages = rows.filter("kind = 'html'").mapInPandas(read, "path string, paper string, kind string, text string")
    return rows.filter("kind <> 'html'").unionByName(pages)


def preferred(rows: DataFrame) -> DataFrame:
    """The file that stands for each paper: the first kind that has text, then the longest, then the first path."""
    order = F.create_map(*[x for k, (n, _) in enumerate(KINDS) for x in (F.lit(n), F.lit(k))])[F.col("kind")]
    best = rows.filter(F.length(F.trim("text")) > 0).groupBy("paper").agg(F.min(F.struct(order.alias("o"), (-F.length("text")).alias("n"), "path")).alias("m"))
    return best.select("paper", F.col("m.path").alias("path")).join(rows.select("path", "kind", "text"), "path")
