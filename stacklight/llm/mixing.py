"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of a token budget, divided by the tokens it has, is the expected number of copies x of each of its
documents. floor(x) copies are certain; the fraction left is rounded to one copy or none by the pivotal method: two
fractional documents are paired and token mass is moved from one to the other, in the one direction or the other with
the probabilities that keep every expectation, until one of them is integral. Moving token mass (not probability) keeps
the source's token total exact up to its last document. The pairing runs inside buckets of a bounded number of rows; each
bucket leaves at most one fractional document, and these residuals are bucketed and paired again, level by level, until
each source has one, which is rounded alone. A hot source spreads over as many buckets as its rows need.

All randomness is drawn from hashes of the document's id and the seed, so a task that runs twice, after the loss of an
executor too, gives the same rows.

Cases: labels that differ in case or outer spaces are one source; a null label, or one that has no target, isn't used; a
target without documents reaches nothing and its weight is spread over the rest; documents without tokens (null, empty)
get no copy; ``max_repeats`` below 1 or null means never used; repeated target rows are added up by source.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import cut
from stacklight.llm.tokenize import TOKENIZER_DIR, token_counts

BUCKET = 4096
SEED = 20240607
EPS = 1e-9


def source_label(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


def allot(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: int | None = None) -> dict[str, float]:
    """Tokens for each source: weight times budget, at most tokens times max_repeats; what capped sources can't take
    goes to the others in proportion to their weights. The default budget is the largest at which every source that has
    tokens can hold its share; a larger one uses more data and lets the shares of the scarce sources fall."""
    cap = {s: float(available.get(s, 0)) * max(0, r) for s, (w, r) in targets.items()}
    given = dict.fromkeys(targets, 0.0)
    free = {s for s, (w, _) in targets.items() if w > 0 and cap[s] > 0}
    present = sum(targets[s][0] for s in free)
    left = min((cap[s] * present / targets[s][0] for s in free), default=0.0) if budget is None else float(budget)
    while free and left > EPS:
        weight = sum(targets[s][0] for s in free)
        full = {s for s in free if left * targets[s][0] / weight >= cap[s]}
        if not full:
            for s in free:
                given[s] = left * targets[s][0] / weight
            break
        for s in full:
            given[s] = cap[s]
            left -= cap[s]
        free -= full
    return given


def pivot(p: np.ndarray, size: np.ndarray, u: np.ndarray) -> np.ndarray:
    """``p`` with at most one entry strictly between 0 and 1; sum(p * size) is kept and each entry's mean too."""
    p = p.copy()
    i = -1
    for j in range(len(p)):
        if not EPS < p[j] < 1 - EPS:
            p[j] = round(p[j])
            continue
        if i < 0:
            i = j
            continue
        up = min((1 - p[i]) * size[i], p[j] * size[j])  # mass moved from j to i
        down = min(p[i] * size[i], (1 - p[j]) * size[j])  # mass moved from i to j
        move = up if u[j] < down / (up + down) else -down
        p[i] += move / size[i]
        p[j] -= move / size[j]
        for k in (i, j):
            if not EPS < p[k] < 1 - EPS:
                p[k] = round(p[k])
        open_ = [k for k in (i, j) if 0 < p[k] < 1]
        i = open_[0] if open_ else -1
    return p


def _uniform(*cols: Column) -> Column:
    """A number in [0, 1) drawn from a hash of ``cols``."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def pivotal_rounding(rows: DataFrame, bucket: int = BUCKET, seed: int = SEED) -> DataFrame:
    """rows(source, doc_id, size, base, p) -> (source, doc_id, size, base, chosen int). The tree has log_bucket(rows) levels."""
    done, level = None, 0
    current = rows.select("source", "doc_id", "size", "base", "p")
    while True:
        counts = {r["source"]: r["n"] for r in current.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per target source
        last = all(n <= bucket for n in counts.values())
        n_buckets = F.create_map(*[x for s, n in counts.items() for x in (F.lit(s), F.lit(-(-n // bucket)))]) if counts else None
        if n_buckets is None:
            break
        final = last
        b = F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(level)), n_buckets[F.col("source")])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            # Neighbours of like size are paired, so little mass moves; ties go by id.
            pdf = pdf.sort_values(["size", "doc_id"], kind="stable").reset_index(drop=True)
            p = pivot(pdf["p"].to_numpy(), pdf["size"].to_numpy(dtype=float), pdf["u"].to_numpy())
            if final:
                open_ = (p > 0) & (p < 1)
                p[open_] = (pdf["u"].to_numpy()[::-1][open_[::-1]] < p[open_]).astype(float)
            return pd.DataFrame({"source": pdf["source"], "doc_id": pdf["doc_id"], "size": pdf["size"], "base": pdf["base"], "p": p})

        keyed = current.select("*", b.alias("bucket"), _uniform(F.col("doc_id"), F.lit(seed), F.lit(level), F.lit("u")).alias("u"))
        kind = rows.schema["doc_id"].dataType.simpleString()
        ran = cut(keyed.groupBy("source", "bucket").applyInPandas(run, f"source string, doc_id {kind}, size long, base int, p double"))
        whole = ran.filter((F.col("p") <= 0) | (F.col("p") >= 1))
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        current, level = ran.filter((F.col("p") > 0) & (F.col("p") < 1)), level + 1
    if done is None:
        done = current
    return done.select("source", "doc_id", "size", "base", F.col("p").cast("int").alias("chosen"))


def mixture(documents: DataFrame, targets: DataFrame, budget: int | None = None, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, bucket: int = BUCKET, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, n_tokens, copies) of every document that is used, report by source)."""
    goals = {
        r["source"]: (r["w"], r["m"])  # the target list is small by nature: one row per source
        for r in targets.select(source_label(F.col("source")).alias("source"), F.col("target_weight").alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("m"))
        .filter("source is not null and w > 0").groupBy("source").agg(F.sum("w").alias("w"), F.max("m").alias("m")).collect()
    }
    spark = documents.sparkSession
    labelled = documents.withColumn("source", source_label(F.col("source"))).filter(F.col("source").isin([*goals]))
    # Counting tokens is the costly step: it runs once, and the narrow result is what later steps read.
    counted = cut(token_counts(labelled, "doc_id", "source", name=name, folder=folder).filter("n_tokens > 0"))
    sums = {r["source"]: (r["t"], r["n"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    given = allot({s: t for s, (t, _) in sums.items()}, goals, budget)
    rate = {s: given[s] / sums[s][0] for s in given if s in sums and given[s] > 0}
    if rate:
        x = F.create_map(*[v for s, r in rate.items() for v in (F.lit(s), F.lit(float(r)))])[F.col("source")]
        at = counted.filter(F.col("source").isin([*rate])).withColumn("x", x).withColumn("base", F.floor(F.col("x") + EPS).cast("int"))
        at = at.withColumn("p", F.greatest(F.lit(0.0), F.col("x") - F.col("base")))
        # Certain copies travel with the fraction, so nothing is joined afterwards.
        rounded = pivotal_rounding(at.filter(F.col("p") > EPS).select("source", "doc_id", F.col("n_tokens").alias("size"), "base", "p"), bucket, seed)
        mixed = rounded.select("doc_id", "source", F.col("size").alias("n_tokens"), (F.col("base") + F.col("chosen")).alias("copies"))
        mixed = mixed.unionByName(at.filter(F.col("p") <= EPS).select("doc_id", "source", "n_tokens", F.col("base").alias("copies"))).filter("copies > 0")
    else:
        mixed = counted.select("doc_id", "source", "n_tokens", F.lit(0).alias("copies")).filter("copies > 0")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count(F.lit(1)).alias("documents_used"), F.max("copies").alias("most_copies"))
    weight = sum(w for w, _ in goals.values()) or 1.0
    plan = [(s, w / weight, m, int(sums.get(s, (0, 0))[1]), int(sums.get(s, (0, 0))[0]), float(given[s]), bool(given[s] >= sums.get(s, (0, 0))[0] * max(0, m) - EPS)) for s, (w, m) in sorted(goals.items())]
    report = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, documents long, tokens long, planned_tokens double, capped boolean").join(reached, "source", "left")
    report = report.na.fill(0, ["mixed_tokens", "documents_used", "most_copies"])
    everything = Window.partitionBy()  # one row per target source
    share = F.when(F.sum("mixed_tokens").over(everything) > 0, F.col("mixed_tokens") / F.sum("mixed_tokens").over(everything)).otherwise(F.lit(0.0))
    return mixed, report.withColumn("reached_share", share)
