"""Splitting oversized texts at natural boundaries with balanced targets.

Lengths are UTF-16 code units of the text without spaces, tabs, form feeds and line breaks at both ends. A text within
the limit stays whole. For a longer one the fewest pieces that can hold it with the asked overlap is computed, targets of
equal length are placed, and every target is snapped to the strongest boundary near it (blank line, line break before a
heading or list item, line end, sentence end, clause end, word gap; a hard cut, never inside a surrogate pair or a
combining sequence of two code points, where there is none). If a piece then exceeds the limit, a piece is added and
the targets are placed anew. Each piece after the first starts ``overlap`` units before the cut, or up to eight more so that
no surrogate pair or combining sequence is parted.

Cases: null, empty and blank texts give no piece; a text without any boundary is cut hard; rows that repeat a chunk
(same paper and chunk_id under another row_id) count once, the latest row wins (created_at, then row_id); rows with a
null library, paper or chunk_id are split but get no number; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import keep_columns

LIMIT = 1500
OVERLAP = 100
BLOCK = 1024
"""Chunk numbers of a paper are numbered within blocks of this many; one window never holds more of a paper."""

BLANKS = " \t\f\r\n"

_BOUNDARIES = (
    # (strength, pattern): a cut may be placed at the end of a match
    (6, re.compile(r"\n[ \t\f\r]*\n\s*")),
    (5, re.compile(r"\n(?=[ \t]*(?:#{1,6} |[-*•] |\d{1,3}[.)] ))")),
    (4, re.compile(r"\n")),
    (3, re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？；]+[”’」』）]*\s*")),
    (2, re.compile(r"[,;:]\s+|[，、：]\s*")),
    (1, re.compile(r"\s+")),
)


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def utf16_length(text: Column) -> Column:
    """UTF-16 code units: code points plus one for each beyond the basic plane."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def _units(text: str) -> list[int] | None:
    """Prefix sums of UTF-16 units, or None where units equal code points."""
    if text.isascii() or max(text) <= "￿":
        return None
    sums, n = [0], 0
    for c in text:
        n += 2 if c > "￿" else 1
        sums.append(n)
    return sums


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) code-point offsets of the pieces of ``text`` (already trimmed), in order."""
    if overlap * 2 >= limit:
        raise ValueError("overlap must be less than half the limit")
    sums = _units(text)
    unit = (lambda i: sums[i]) if sums else (lambda i: i)
    back = (lambda u: bisect_left(sums, u)) if sums else (lambda u: u)
    total = unit(len(text))
    if total <= limit:
        return [(0, len(text))]
    strong: dict[int, int] = {}
    for strength, pattern in _BOUNDARIES:
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                strong.setdefault(m.end(), strength)
    places = sorted(strong)
    # pieces = 1 + ceil((total - limit) / (limit - overlap))
    n = 1 + -(-(total - limit) // (limit - overlap))
    while True:
        cuts = _place(text, n, total, limit, overlap, unit, back, places, strong)
        if cuts is not None:
            return cuts
        n += 1


def _place(text, n, total, limit, overlap, unit, back, places, strong):
    step = total / n
    pieces, start, cut = [], 0, 0
    for k in range(1, n):
        target = k * step
        reach = min(step / 2, limit / 4)
        lo = bisect_left(places, back(int(max(target - reach, unit(cut) + overlap + 1))))
        hi = bisect_right(places, back(int(min(target + reach, unit(start) + limit))))
        best = max(((strong[p] - 2 * abs(unit(p) - target) / (reach + 1), p) for p in places[lo:hi] if unit(p) - unit(start) <= limit), default=None)
        at = best[1] if best else _safe(text, back(int(min(target, unit(start) + limit))))
        if at <= cut or unit(at) - unit(start) > limit:
            return None
        pieces.append((start, at))
        cut = at
        begin = back(unit(at) - overlap)
        start = _safe(text, begin - (unit(begin) > unit(at) - overlap))
    if total - unit(start) > limit:
        return None
    return [*pieces, (start, len(text))]


def _safe(text: str, i: int) -> int:
    """``i``, moved before a combining mark, joiner or variation selector, so that a hard cut doesn't part it from its base."""
    j = i
    while 0 < j < len(text) and i - j < 8 and (text[j] in "‍️︎" or text[j - 1] == "‍" or "̀" <= text[j] <= "ͯ"):
        j -= 1
    return j or i


PIECE = "piece int, n_pieces int, piece_start int, piece_end int, piece_text string"


def split_rows(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, n_pieces, piece_start, piece_end, piece_text): offsets count code points of the trimmed text.

    The length test runs in the JVM, so only texts above the limit go to Python; the rest pass as one piece."""
    src = keep_columns(rows, id_col, text_col).select(F.col(id_col).alias("id"), trimmed(F.col(text_col)).alias("text")).filter(F.length("text") > 0)
    # A text of more code points than the limit is surely too long; of fewer than half of it, surely not.
    over = F.when(F.length("text") > limit, True).when(F.length("text") * 2 <= limit, False).otherwise(utf16_length(F.col("text")) > limit)
    small = src.filter(~over).select("id", F.lit(0).alias("piece"), F.lit(1).alias("n_pieces"), F.lit(0).alias("piece_start"), F.length("text").alias("piece_end"), F.col("text").alias("piece_text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, text in zip(pdf["id"], pdf["text"]):
                parts = split_text(text, limit, overlap)
                out += [(i, k, len(parts), a, b, text[a:b]) for k, (a, b) in enumerate(parts)]
            yield pd.DataFrame(out, columns=["id", "piece", "n_pieces", "piece_start", "piece_end", "piece_text"])

    kind = src.schema["id"].dataType.simpleString()
    large = src.filter(over).mapInPandas(cut, f"id {kind}, {PIECE}")
    return small.unionByName(large).withColumnRenamed("id", id_col)


def oversized(rows: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(row_id): rows that the operator cuts into more than one piece."""
    parts = split_rows(rows, limit=limit, overlap=overlap)
    return parts.filter((F.col("piece") == 0) & (F.col("n_pieces") > 1)).select("row_id")


def latest_chunks(chunks: DataFrame) -> DataFrame:
    """One row per (library_id, item_key, chunk_id): the latest delivery. Keys only; texts don't move."""
    keys = chunks.select("library_id", "item_key", "chunk_id", "row_id", "created_at").dropna(subset=["library_id", "item_key", "chunk_id"])
    newest = F.max_by("row_id", F.struct(F.coalesce("created_at", F.timestamp_seconds(F.lit(0))), F.col("row_id"))).alias("row_id")
    return keys.groupBy("library_id", "item_key", "chunk_id").agg(newest)


def numbered_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(library_id, item_key, chunk_id, row_id, piece, n_pieces, new_chunk_id, piece_text): new ids run from 0 in each paper.

    The numbers come from a two-level prefix sum: pieces per block of chunk numbers first, offsets of the blocks next,
    and a window within each block last, so a paper with a third of all rows is never in one task."""
    paper = ["library_id", "item_key"]
    parts = split_rows(chunks, limit=limit, overlap=overlap).select("row_id", "piece", "n_pieces", "piece_text")
    rows = latest_chunks(chunks).withColumn("block", F.floor(F.col("chunk_id") / BLOCK)).join(parts, "row_id")
    counts = rows.groupBy(*paper, "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*paper).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*paper, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*paper, "block").orderBy("chunk_id", "piece")
    return (
        rows.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, [*paper, "block"])
        .select(*paper, "chunk_id", "row_id", "piece", "n_pieces", (F.col("offset") + F.col("at")).alias("new_chunk_id"), "piece_text")
    )


def corrected_sessions(sessions: DataFrame, chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Distinct sessions with ``total_chunks`` set to the number of pieces of the paper (0 where it has none)."""
    paper = ["library_id", "item_key"]
    # Pieces are counted without their texts and without numbering them.
    parts = split_rows(chunks, limit=limit, overlap=overlap).filter("piece = 0").select("row_id", "n_pieces")
    totals = latest_chunks(chunks).join(parts, "row_id").groupBy(*paper).agg(F.sum("n_pieces").cast("int").alias("new_total"))
    s = sessions.select("session_id", *paper, "total_chunks").distinct()
    return s.join(totals, paper, "left").select("session_id", *paper, F.col("total_chunks").alias("old_total_chunks"), F.coalesce("new_total", F.lit(0)).alias("total_chunks"))
