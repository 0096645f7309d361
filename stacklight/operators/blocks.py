"""Structured documents: JSON blocks read with a schema, repaired within a document, and rendered.

Blocks are (kind, page, level, text). Headers, footers and page numbers are dropped; a word parted at the end of a block is joined where the
document's own words support it; a paragraph that a page or column break interrupts goes on in one block; headings get
levels from their numbers; spaces around maths are made regular; HTML tables become rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "array<struct<type:string,page_idx:int,text_level:int,text:string,table_body:string>>"
NOISE = ("header", "footer", "page_number", "page_footnote", "aside_text", "discarded")


def read(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """(keys, at, kind, page, level, text); text that isn't a list of blocks gives no rows."""
    b = rows.select(*keys, F.posexplode(F.from_json(column, SCHEMA)).alias("at", "b"))
    text = F.coalesce(F.col("b.text"), F.when(F.col("b.type") == "table", F.col("b.table_body")))
    return b.select(*keys, "at", F.coalesce(F.lower("b.type"), F.lit("text")).alias("kind"), F.coalesce("b.page_idx", F.lit(0)).alias("page"), F.col("b.text_level").alias("level"), text.alias("text")).filter((F.length("text") > 0) & ~F.col("kind").isin(*NOISE))


# The forms of a structured result, best first; the last two are lists of blocks by page.
FORMATS = ("content_list_v2", "content_list", "model")
PAGED = "array<array<struct<type:string,level:int,text:string,content:struct<text:string,level:int>>>>"


def read_best(files: DataFrame, keys: list[str], name: str, column: str) -> DataFrame:
    """files(keys, name, column) -> (keys, format, at, kind, page, level, text): of each document the blocks of the best form that it has;
    pages of the paged forms are counted from 0. A best form that isn't JSON raises, for a worse one would hide it."""
    low = F.lower(name)
    order = F.coalesce(*[F.when(F.rlike(low, F.lit(rf"(?:^|[_/\\]){f}\.json$")), k) for k, f in enumerate(FORMATS)])
    best = files.select(*keys, F.col(column).alias("body"), order.alias("o"), F.col(name).alias("n")).filter("o is not null").groupBy(*keys).agg(F.min_by("body", F.struct("o", "n")).alias("body"), F.min("o").alias("o"))
    best = best.withColumn("body", F.when(F.get_json_object("body", "$").isNotNull(), F.col("body")).otherwise(F.raise_error(F.lit("a structured result isn't JSON"))))
    fmt = F.array(*map(F.lit, FORMATS))[F.col("o")]
    flat = best.filter("o = 1").select(*keys, fmt.alias("format"), F.posexplode(F.from_json("body", SCHEMA)).alias("at", "b"))
    flat = flat.select(*keys, "format", "at", "b.type", F.col("b.page_idx").alias("page"), F.col("b.text_level").alias("level"), F.coalesce("b.text", "b.table_body").alias("text"))
    paged = best.filter("o <> 1").select(*keys, fmt.alias("format"), F.posexplode(F.from_json("body", PAGED)).alias("page", "bs"))
    paged = paged.select(*keys, "format", "page", F.posexplode("bs").alias("k", "b")).select(*keys, "format", (F.col("page") * 100_000 + F.col("k")).alias("at"), "b.type", "page", F.coalesce("b.content.level", "b.level").alias("level"), F.coalesce("b.content.text", "b.text").alias("text"))
    both = flat.unionByName(paged).select(*keys, "format", "at", F.coalesce(F.lower("type"), F.lit("text")).alias("kind"), F.coalesce("page", F.lit(0)).alias("page"), "level", "text")
    return both.filter((F.length("text") > 0) & ~F.col("kind").isin(*NOISE))


def table_rows(html: str) -> str:
    rows = re.findall(r"<tr\b.*?</tr>", html, re.S | re.I)
    cells = [[re.sub(r"<[^>]+>", "", c).strip() for c in re.findall(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", r, re.S | re.I)] for r in rows]
    return "\n".join("| " + " | ".join(c) + " |" for c in cells if c)


def heading_level(text: str, level: int | None) -> int:
    m = re.match(r"\s*(\d+(?:\.\d+)*)[.\s]", text)
    return min(6, 1 + m[1].count(".") + 1) if m else min(6, max(1, level or 2))


def repair(blocks: list[tuple[str, int, int | None, str]]) -> list[tuple[str, int, str]]:
    """(kind, page, text) of a document's blocks in order."""
    known = Counter(w for _, _, _, t in blocks for w in re.findall(r"[^\W\d_]{3,}", t.lower()))
    out: list[tuple[str, int, str]] = []
    for kind, page, level, text in blocks:
        if kind == "table":
            out.append((kind, page, table_rows(text) or text))
            continue
        text = re.sub(r"\s*\n\s*", " ", re.sub(r"(\$)\s+|\s+(?=\$(?:[\s.,;)]|$))", r"\1", text)).strip()
        if kind == "title" or kind == "text" and level:
            out.append(("heading", page, "#" * heading_level(text, level) + " " + text))
            continue
        if out and out[-1][0] == "text" and kind == "text" and page - out[-1][1] in (0, 1):
            last = out[-1][2]
            m, n = re.search(r"([^\W\d_]+)-$", last), re.match(r"([^\W\d_]+)", text)
            if m and n and text[:1].islower():
                joined = (m[1] + n[1]).lower()
                out[-1] = ("text", page, (last[:-1] if known[joined] else last) + text)
                continue
            if last[-1:] not in ".。!?！？:：" and (text[:1].islower() or re.match("[一-鿿]", text) and re.search("[一-鿿，、]$", last)):
                glue = "" if re.match("[一-鿿]", text) else " "
                out[-1] = ("text", page, last + glue + text)
                continue
        out.append((kind, page, text))
    return out


def assemble(read_blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, kind, page, text): one call per document, in the order of its blocks."""
    one = read_blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "kind", "page", "level", "text"))).alias("bs"))  # the blocks of one document
    kinds = ", ".join(f"{k} {one.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *k, bs in pdf[[*keys, "bs"]].itertuples(index=False):
                done = repair([(b["kind"], b["page"], b["level"], b["text"]) for b in bs])
                out += [(*k, n, kind, page, text) for n, (kind, page, text) in enumerate(done)]
            yield pd.DataFrame(out, columns=[*keys, "n", "kind", "page", "text"])

    return one.mapInPandas(run, f"{kinds}, n int, kind string, page int, text string")
