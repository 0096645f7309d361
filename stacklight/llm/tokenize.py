"""Encoding of a corpus with a public byte-level BPE tokenizer by overlapping chunks.

A text of up to ``CHUNK`` characters is encoded at once. A longer one is cut into chunks of ``CHUNK`` characters that
overlap the next by ``OVERLAP``; the chunks are pre-tokenised in parallel, and two neighbours are stitched at the first
position in their overlap that is a pre-token boundary in both. The pre-tokeniser only looks ahead, so from a common
boundary on both see the same pre-tokens, and the pieces between stitches can be encoded independently without changing
one id. Where an overlap has no common boundary (a pre-token longer than the overlap), the pieces stay joined from there
on. Decoding concatenates the tokens' raw bytes.

Cases: an empty text has the ids ``[]``, and so has a null text (a null would be indistinguishable from a lost row);
blank texts, control characters and any Unicode are encoded as they stand; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stacklight.llm.common import cut, keep_columns
from stacklight.sources.tables import spread

TOKENIZER_DIR = "/opt/tokenizers"
CHUNK = 200_000
OVERLAP = 4_096
EDGE = 512
"""Boundaries within so many characters of a chunk's end are not used: the chunk's end could have made them."""


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The tiktoken encoder of ``<folder>/<name>.tiktoken``; one per Python worker."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=_pattern(), mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(_pattern())


def encode_table(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE) -> DataFrame:
    """(id, ids array<int>): one row per input row with a unique id."""
    docs = spread(keep_columns(rows, id_col, text_col), id_col).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = docs.schema["id"].dataType

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            ids = [enc.encode_ordinary(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    schema = f"id {kind.simpleString()}, ids array<int>"
    is_long = F.length("text") > chunk
    short = docs.filter(~is_long).mapInArrow(whole, schema)
    long = cut(docs.filter(is_long))
    if long.isEmpty():
        return short.withColumnRenamed("id", id_col)
    pieces = _pieces(long, chunk, overlap, edge, kind.simpleString())
    encoded = pieces.mapInArrow(lambda it: _encode_pieces(it, name, folder), f"id {kind.simpleString()}, start long, ids array<int>")
    joined = encoded.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids"))
    return short.unionByName(joined).withColumnRenamed("id", id_col)


def _encode_pieces(batches: Iterator[pa.RecordBatch], name: str, folder: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(name, folder)
    for b in batches:
        ids = [enc.encode_ordinary(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["id", "start", "ids"])


def boundaries(text: str) -> list[int]:
    """Start offsets of the pre-tokens of ``text``."""
    return [m.start() for m in _splitter().finditer(text)]


def _pieces(docs: DataFrame, chunk: int, overlap: int, edge: int, kind: str) -> DataFrame:
    """(id, start, text): the pieces of long texts between stitches."""

    def chunked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row at a time, so that a text is cut in one pass and never held twice."""
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"]):
                n = (len(text) - 1) // chunk
                for k in range(n + 1):
                    yield pd.DataFrame({"id": [i], "k": [k], "text": [text[k * chunk : (k + 1) * chunk + overlap]], "is_last": [k == n]})

    chunks = docs.mapInPandas(chunked, f"id {kind}, k long, text string, is_last boolean").repartition("id", "k")

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Boundaries of the chunk in the overlap with the chunk before (head) and after (tail), in the text's offsets."""
        for pdf in batches:
            out = []
            for i, k, text, is_last in zip(pdf["id"], pdf["k"], pdf["text"], pdf["is_last"]):
                at, n = boundaries(text), len(text)
                usable = [p for p in at if is_last or p < n - edge]
                out.append((i, k, [k * chunk + p for p in usable if p < overlap], [k * chunk + p for p in usable if p >= chunk]))
            yield pd.DataFrame(out, columns=["id", "k", "head", "tail"])

    seen = chunks.mapInPandas(edges, f"id {kind}, k long, head array<long>, tail array<long>")
    tails = seen.select("id", (F.col("k") + 1).alias("k"), "tail")
    stitch = seen.select("id", "k", "head").join(tails, ["id", "k"]).select("id", "k", F.array_min(F.array_intersect("head", "tail")).alias("at"))
    # A stitch is trusted only while every stitch before it was found.
    broken = stitch.filter(F.col("at").isNull()).groupBy("id").agg(F.min("k").alias("from_k"))
    good = stitch.join(broken, "id", "left").filter(F.col("at").isNotNull() & (F.col("from_k").isNull() | (F.col("k") < F.col("from_k"))))
    starts = good.groupBy("id").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    spans = docs.join(starts, "id", "left").select("id", "text", F.coalesce("ats", F.array().cast("array<bigint>")).alias("ats"))

    def sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, text, ats in zip(pdf["id"], pdf["text"], pdf["ats"]):
                cuts = [0, *(int(a) for a in ats), len(text)]
                for a, z in zip(cuts, cuts[1:]):
                    yield pd.DataFrame({"id": [i], "start": [a], "text": [text[a:z]]})

    return spans.mapInPandas(sliced, f"id {kind}, start long, text string").repartition("id", "start")


def count_tokens(enc, text: str, chunk: int = CHUNK) -> int:
    """The number of ids of a text; a long one is encoded in runs of whole pre-tokens, so that memory doesn't grow with it."""
    if len(text) <= chunk:
        return len(enc.encode_ordinary(text))
    total = start = 0
    for m in _splitter().finditer(text):
        if m.end() - start >= chunk:
            total += len(enc.encode_ordinary(text[start : m.end()]))
            start = m.end()
    return total + len(enc.encode_ordinary(text[start:]))


def token_counts(rows: DataFrame, *keep: str, text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` with ``n_tokens`` (0 for null). Only the count leaves the worker."""
    src = spread(keep_columns(rows, *keep, text_col), keep[0]).withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for b in batches:
            n = pa.array([count_tokens(enc, t) for t in b.column(text_col).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], n], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep)
    return src.mapInArrow(count, f"{kinds}, n_tokens long")


def decode_table(encoded: DataFrame, id_col: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, text): the tokens' raw bytes joined and read as UTF-8."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(name, folder)
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "text": [enc.decode_bytes(list(x)).decode("utf-8") for x in pdf["ids"]]})

    kind = encoded.schema[id_col].dataType.simpleString()
    return keep_columns(encoded, id_col, "ids").mapInPandas(decode, f"{id_col} {kind}, text string")
