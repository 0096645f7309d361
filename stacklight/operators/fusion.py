"""Rank fusion of independent branches, paging, overlap, threshold calibration."""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators.ranking import ranked, score_bucket
from stacklight.session import cut

# Constant of reciprocal ranks; floors of the branches; page sizes.
RRF_K = 60
KEYWORD_FLOOR, SEMANTIC_FLOOR = 0.52, 0.60
MAX_PAGE = 20


def admitted(branch: DataFrame, keys: list[str], floor: float, requested: float | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, score, rank): rows at or above the floor, which a request can only raise; of repeated rows the best counts;
    ranks run from 1 among admitted rows only, within ``by`` where several searches are made at once."""
    bar = max(floor, requested) if requested is not None else floor
    one = cut(branch.filter(F.col("score") >= bar).groupBy(*keys).agg(F.max("score").alias("score")))  # read by the counts and by the rows
    return ranked(one, score_bucket(F.col("score")), F.desc("score"), *keys, by=by)


def fused(branches: dict[str, tuple[DataFrame, float]], keys: list[str], k: int = RRF_K) -> DataFrame:
    """(keys, rrf, sources, best_rank, matched_by): sum of weight / (k + rank); an absent branch adds nothing. One union and
    one aggregation in place of outer joins."""
    parts = [d.select(*keys, F.lit(n).alias("branch"), F.lit(w / 1.0).alias("w"), "rank") for n, (d, w) in branches.items()]
    return cut(
        reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(
            F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("rrf"),
            F.count(F.lit(1)).alias("sources"),
            F.min("rank").alias("best_rank"),
            F.array_join(F.array_sort(F.collect_set("branch")), "+").alias("matched_by"),
        )
    )


def order(keys: list[str]) -> list:
    return [F.desc("rrf"), F.desc("sources"), "best_rank", *keys]


def rrf(branches: dict[str, tuple[DataFrame, float]], keys: list[str], k: int = RRF_K, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The fused rows with their rank."""
    return ranked(fused(branches, keys, k), score_bucket(F.col("rrf"), 1_000_000), *order(keys), by=by)


def first_rows(rows: DataFrame, keys: list[str], offset: int, limit: int) -> DataFrame:
    """A page of fused rows with rank, total and has_more, where the rows before it are few: they are taken by their order, and
    nothing behind the page is ranked."""
    top = rows.orderBy(*order(keys)).limit(offset + limit)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    page_ = top.withColumn("rank", F.row_number().over(Window.orderBy(*order(keys)))).filter(F.col("rank") > offset)  # offset + limit rows
    return page_.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def page(ranked: DataFrame, offset: int, limit: int, most: int = 500) -> DataFrame:
    """Rows of one page with total and has_more; a stable order is in ``rank``."""
    size = max(0, min(limit, most))
    total = ranked.agg(F.count(F.lit(1)).alias("total"))
    rows = ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + size))
    return rows.join(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + size)


def fingerprint(query: str, keywords: list[str], **settings) -> str:
    """Equal for searches that differ in spaces, case or order only."""
    words = sorted({" ".join(k.lower().split()) for k in keywords})
    return hashlib.sha256(json.dumps([" ".join(query.lower().split()), words, sorted(settings.items())], ensure_ascii=False).encode()).hexdigest()


def cursor(prefix: str, search: str, offset: int) -> str:
    return f"{prefix}_{search}_{offset}"


def read_cursor(text: str, prefix: str, search: str) -> int:
    """The offset of a cursor; ValueError for another search's."""
    m = re.fullmatch(rf"{re.escape(prefix)}_(.+)_(\d+)", text)
    if not m or m[1] != search:
        raise ValueError("the cursor belongs to another search")
    return int(m[2])


def page_size(requested: int | None, cap: int) -> int:
    return max(1, min(requested or cap, cap, MAX_PAGE))


def overlap(graph: DataFrame, keyword: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """Counts: graph rows that neither other branch has, and that each has."""
    g, k, s = (d.select(*keys).distinct() for d in (graph, keyword, semantic))
    both = k.unionByName(s).distinct()
    counts = [("novel", g.join(both, keys, "left_anti")), ("with_keyword", g.join(k, keys, "left_semi")), ("with_semantic", g.join(s, keys, "left_semi"))]
    return reduce(DataFrame.unionByName, [d.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, d in counts])


def shown_score(score: Column, branch: str) -> Column:
    """The score of a branch shown alone: semantic clamped, keyword saturated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) if branch == "semantic" else F.when(score > 0, score / (score + 4)).otherwise(F.lit(0.0))


def candidate(title: Column, date: Column, score: Column, rank_score: Column) -> dict[str, Column]:
    """Shown fields: the title cut, the year of the date, scores of 4 and 6 places."""
    year = F.regexp_extract(date, r"(\d{4})", 1)
    return {"title": T.cut_evidence(title, 60), "year": F.when(year != "", year), "score": F.round(score, 4), "rank_score": F.round(rank_score, 6)}


def trimmed_evidence(passages: Column, keep: int = 2) -> Column:
    """Of the passages (structs with ``text``) the first ``keep``, each cut to what is shown."""
    return F.transform(F.slice(passages, 1, keep), lambda p: p.withField("text", T.cut_evidence(p["text"])))


def threshold_sweep(scored: DataFrame, thresholds: list[float], beta: float = 0.5) -> DataFrame:
    """scored(score, relevant boolean) -> precision, recall and F-beta at each threshold."""
    steps = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
    x = scored.select("score", "relevant", steps.alias("threshold"))
    kept = F.col("score") >= F.col("threshold")
    g = x.groupBy("threshold").agg(F.count_if(kept & F.col("relevant")).alias("tp"), F.count_if(kept & ~F.col("relevant")).alias("fp"), F.count_if(~kept & F.col("relevant")).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    f = F.when((p > 0) | (r > 0), (1 + beta**2) * p * r / (beta**2 * p + r)).otherwise(F.lit(0.0))
    return g.select("threshold", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f_beta"))
