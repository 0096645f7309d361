"""The k most similar vectors of every vector: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to length 1. Coarse centroids, on two levels, and the codebooks of the residuals are trained on a bounded
sample (``SAMPLE`` rows, or ``PER_LIST`` for each list, chosen by a hash of the id); every usable row is indexed and every row
is a query. The lists grow with the square root of the rows and the number that is probed is fixed, so the scores grow
with the rows to the power of 1.5. A row is coded once:
its list, ``M`` bytes for the direction of its residual and three floats: the residual's length, the score its code misses
on the row itself, and the length of what the code misses. So a dense cluster is coded as finely, for its size, as a wide one. For the search the *codes* travel to the lists nearest their vectors and the float vectors stay,
because codes are six times smaller. Each block of queries of a list meets blocks of candidate codes; distances come
from asymmetric tables (query float, candidate code). Reranked on exact vectors are the ``keep`` best of a query and every
other candidate whose score is within ``SLACK`` deviations of its own code's error of the k-th best, however many they are.

A list with more than ``LIST_MAX`` rows is cut into blocks on both sides, so a hot list is never one task. Rows with
the same direction (exact copies) are one class with one representative that is indexed; members are expanded at the end,
k at most per row.

Rows whose scaled vectors agree to 6 decimals are such copies, with a cosine of 1 (right to 11 places).

Cases: null, empty, wrong-length, all-zero and non-finite vectors are not usable and appear nowhere; ties go to the smaller
id; fewer than k other rows give fewer neighbours; an empty table gives no rows; repeated ids count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import cut, keep_columns
from stacklight.sources.tables import spread

DIM = 64
M = 32
CODE = 256
SAMPLE = 40_000
PER_LIST = 8
"""Rows of the sample: ``SAMPLE``, and so many for each list where that is more (64 MB at ``LISTS_MAX``)."""
LISTS_MAX = 32_768
"""Lists are twice the square root of the rows up to here, which is 268 million rows; they grow longer after that."""
LIST_MAX = 4_096
PROBES = 32
CELLS = 1 << 22
"""Distances (rows by lists) that are held at a time."""
KEEP = 16
SLACK = 2.0
K = 10


def usable(c: Column, dim: int = DIM) -> Column:
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dim) & ok & F.exists(c, lambda x: x != 0), F.lit(False))


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v array<float> of length 1) of the usable rows."""
    src = keep_columns(vectors, id_col, vector_col).filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), dim))
    src = spread(src, id_col).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m = np.stack(pdf["v"].to_numpy()).astype("f8")
                m /= np.abs(m).max(1, keepdims=True)  # no overflow or underflow in the squares
                yield pd.DataFrame({"id": pdf["id"], "v": list((m / np.linalg.norm(m, axis=1, keepdims=True)).astype("f4"))})

    return src.mapInPandas(scale, "id long, v array<float>")


def kmeans(x: np.ndarray, n: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    n = min(n, len(x))
    c = x[rng.choice(len(x), n, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        at = np.searchsorted(near[order], np.arange(n + 1))
        for j in range(n):
            rows = order[at[j] : at[j + 1]]
            c[j] = x[rows].mean(0) if len(rows) else x[rng.integers(len(x))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half, step = (c**2).sum(1) / 2, max(1, CELLS // len(c))
    return np.concatenate([np.argmax(x[i : i + step] @ c.T - half, 1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def nearest_lists(x: np.ndarray, c: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` lists nearest each row."""
    half, step = (c**2).sum(1) / 2, max(1, CELLS // len(c))
    return np.concatenate([np.argpartition(half - x[i : i + step] @ c.T, probes - 1, 1)[:, :probes] for i in range(0, len(x), step)]).astype("i4")


def two_level(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of ``lists`` lists: the sample is parted at the square root of that number, and each part again on its own."""
    top = kmeans(x, round(lists**0.5) or 1, 8, rng)
    own = nearest(x, top)
    parts = [x[own == j] for j in range(len(top))]
    return np.concatenate([kmeans(p, max(1, round(lists * len(p) / len(x))), 8, rng) for p in parts if len(p)])


def train(sample: np.ndarray, lists: int, m: int = M, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(lists x dim centroids, m x CODE x dim/m codebooks) from a bounded sample."""
    rng = np.random.default_rng(seed)
    centroids = two_level(sample, lists, rng)
    rest = sample - centroids[nearest(sample, centroids)]
    rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12)
    d = sample.shape[1] // m
    books = [kmeans(rest[:, j * d : (j + 1) * d], CODE, 8, rng) for j in range(m)]
    books = [np.concatenate([b, np.full((CODE - len(b), d), 1e3, "f4")]) for b in books]
    return centroids.astype("f4"), np.stack(books).astype("f4")


def encode_rows(x: np.ndarray, c: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its list, its M bytes and (length, missed, error): the row is about centroid + length * code, ``missed``
    is what that is short of in the product of the row with itself, ``error`` the length of the difference."""
    d = c.shape[1] // b.shape[0]
    own = nearest(x, c)
    r = x - c[own]
    size = np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
    codes = np.stack([nearest(r[:, j * d : (j + 1) * d] / size, b[j]) for j in range(b.shape[0])], 1).astype("u1")
    shape = np.concatenate([b[j][codes[:, j]] for j in range(b.shape[0])], 1)
    length = (r * shape).sum(1) / np.maximum((shape**2).sum(1), 1e-12)
    miss = r - length[:, None] * shape
    return own, codes, np.stack([length, ((x - miss) * miss).sum(1), np.linalg.norm(miss, axis=1)], 1).astype("f4")


def scores(y: np.ndarray, c: np.ndarray, b: np.ndarray, lst: np.ndarray, codes: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """(queries x candidates): the product told from the codes."""
    d = y.shape[1] // b.shape[0]
    score = np.zeros((len(y), len(lst)), "f4")
    for j in range(b.shape[0]):
        score += np.take(y[:, j * d : (j + 1) * d] @ b[j].T, codes[:, j], axis=1)  # row by row as score; a plain index isn't
    score *= fit[:, 0]
    score += fit[:, 1]
    score += np.take(y @ c.T, lst, axis=1)
    return score


def slacks(kth: np.ndarray, error: np.ndarray, dim: int) -> np.ndarray:
    """How far under the k-th best a score may lie and its vector still be as near, by ``SLACK`` deviations.

    What is missed is a vector of length ``error`` in any direction, against the difference of query and candidate, so the
    deviation at score u is s = error / sqrt(dim) * sqrt(2 - 2u + error²); this solves kth - u = SLACK * s for kth - u."""
    s = (SLACK * error / np.sqrt(dim)) ** 2
    return s + np.sqrt(s * s + s * np.maximum(2 - 2 * kth + error**2, 0))


def top_k(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector", k: int = K, dim: int = DIM, probes: int = PROBES, keep: int = KEEP, m: int = M, sample: int = SAMPLE, list_max: int = LIST_MAX) -> DataFrame:
    """(id, rank, neighbour, cosine): up to k rows per usable row."""
    spark = vectors.sparkSession
    rows = unit_rows(vectors, id_col, vector_col, dim)
    # One representative for all rows of the same direction; the vector travels as bytes.
    direction = F.sha2(F.concat_ws(",", F.transform("v", lambda x: F.round(x, 6).cast("string"))), 256)
    rows = cut(rows.select("id", "v", direction.alias("d")).groupBy("d").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.count_distinct("id").alias("n")))
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "id long, rank int, neighbour long, cosine double")
    members = _members(vectors, id_col, vector_col, dim, direction, rows.filter("n > 1").select("d", "rep"), k)

    lists = int(min(LISTS_MAX, max(1, round(2 * n**0.5))))
    sample = max(sample, PER_LIST * lists)
    part = min(1.0, 1.2 * sample / n)
    picked = rows.filter(F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1_000_000)) < int(part * 1_000_000)).select("v").limit(sample).toPandas()
    base = np.stack(picked["v"].to_numpy()) if len(picked) else np.stack(rows.select("v").limit(sample).toPandas()["v"].to_numpy())
    centroids, books = train(base.astype("f4"), lists, m)
    probes = min(len(centroids), probes)
    model = spark.sparkContext.broadcast((centroids, books))  # at most LISTS_MAX + CODE rows of floats: about 8 MB

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, b = model.value
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy()).astype("f4")
                own, codes, fit = encode_rows(x, c, b)
                to = nearest_lists(x, c, probes)
                yield pd.DataFrame({"rep": pdf["rep"], "list": own.astype("i4"), "code": [u.tobytes() + f.tobytes() for u, f in zip(codes, fit)], "to": list(to), "v": pdf["v"]})

    coded = cut(rows.select("rep", "v").mapInPandas(encode, "rep long, list int, code binary, to array<int>, v array<float>"))
    sizes = coded.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
    block = lambda salt, size: F.pmod(F.xxhash64("rep", F.lit(salt)), F.ceil(F.col(size) / list_max)).cast("int")
    # Blocks of queries of a list, and of candidates: each (list, query block, candidate block group) is one group.
    q = coded.join(F.broadcast(sizes), "list").select(F.col("list").alias("at"), block(1, "size").alias("qb"), "rep", "v")
    # A code goes to the lists nearest its own vector: the list of a close query is surely among them.
    c = coded.select(F.col("rep").alias("other"), "list", "code", F.explode("to").alias("at"))
    load = c.groupBy("at").agg(F.count(F.lit(1)).alias("load"))
    q_blocks = sizes.select(F.col("list").alias("at"), F.ceil(F.col("size") / list_max).cast("int").alias("n_qb"))
    per_list = load.join(q_blocks, "at").withColumn("n_cb", F.ceil(F.col("load") / F.lit(probes * list_max)).cast("int"))  # at most LISTS_MAX rows
    c = c.join(F.broadcast(per_list.select("at", "n_qb", "n_cb")), "at").withColumn("cb", F.pmod(F.xxhash64("other", F.lit(2)), F.col("n_cb")).cast("int"))
    c = c.select("at", "cb", F.explode(F.sequence(F.lit(0), F.col("n_qb") - 1)).alias("qb"), "list", "other", "code")
    c = c.select(*[F.col(x).alias(f"c_{x}") for x in c.columns])  # a cogroup of tables of one origin needs names of its own
    q = q.join(F.broadcast(per_list.select("at", "n_cb")), "at").select("at", F.explode(F.sequence(F.lit(0), F.col("n_cb") - 1)).alias("cb"), "qb", "rep", "v")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cent, b = model.value
        if not len(left) or not len(right):
            return pd.DataFrame({"id": np.zeros(0, "i8"), "other": np.zeros(0, "i8"), "score": np.zeros(0, "f4"), "error": np.zeros(0, "f4")})
        ids, x = left["rep"].to_numpy(), np.stack(left["v"].to_numpy()).astype("f4")
        others, lst = right["c_other"].to_numpy(), right["c_list"].to_numpy()
        raw = np.frombuffer(b"".join(right["c_code"]), "u1").reshape(len(right), -1)
        codes, fit = np.asfortranarray(raw[:, : b.shape[0]]), raw[:, b.shape[0] :].copy().view("f4")
        out = []
        for s in range(0, len(x), 128):
            y = x[s : s + 128]
            score = scores(y, cent, b, lst, codes, fit)
            score[ids[s : s + 128, None] == others[None, :]] = -9
            n_all = score.shape[1]
            part = np.partition(score, n_all - min(max(keep, k), n_all), 1)[:, n_all - min(max(keep, k), n_all) :]
            last = np.partition(part, part.shape[1] - min(keep, n_all), 1)[:, part.shape[1] - min(keep, n_all)]
            kth = np.partition(part, part.shape[1] - min(k, n_all), 1)[:, part.shape[1] - min(k, n_all)]
            # First by the widest error of the block, then by each candidate's own.
            i, o = np.nonzero(score >= np.minimum(last, kth - slacks(kth, fit[:, 2].max(), y.shape[1]))[:, None])
            g, e = score[i, o], slacks(kth[i], fit[o, 2], y.shape[1])
            ok = (g > -8) & ((g >= last[i]) | (g + e >= kth[i]))
            out.append((ids[s + i[ok]], others[o[ok]], g[ok], fit[o[ok], 2]))
        i, o, g, e = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"id": i, "other": o, "score": g, "error": e})

    keys = ["at", "qb", "cb"]
    hits = q.groupBy(*keys).cogroup(c.groupBy(*[f"c_{x}" for x in keys])).applyInPandas(search, "id long, other long, score float, error float")
    # The same over all blocks of candidates of a query.
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    hits = hits.withColumn("r", F.row_number().over(best))
    kth = F.coalesce(F.max(F.when(F.col("r") == k, F.col("score"))).over(Window.partitionBy("id")), F.lit(-9.0))
    hits = hits.withColumn("kth", kth).withColumn("s", F.pow(F.lit(SLACK / dim**0.5) * F.col("error"), 2))
    slack = F.col("s") + F.sqrt(F.col("s") * F.col("s") + F.col("s") * F.greatest(F.lit(0.0), 2 - 2 * F.col("kth") + F.col("error") * F.col("error")))
    hits = hits.filter((F.col("r") <= keep) | (F.col("score") + slack >= F.col("kth")))
    # Exact rerank: each unordered pair is compared once.
    both = hits.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    va, vb = coded.select(F.col("rep").alias("a"), F.col("v").alias("va")), coded.select(F.col("rep").alias("b"), F.col("v").alias("vb"))
    exact = cut(_cosines(both.join(va, "a").join(vb, "b").select("a", "b", "va", "vb")))
    sides = exact.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine").unionByName(exact.select(F.col("b").alias("rep"), F.col("a").alias("other"), "cosine"))
    rank = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    sides = sides.withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= k).select("rep", "other", "cosine")
    return _expand(sides, members, k)


def _cosines(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["va"].to_numpy()).astype("f8"), np.stack(pdf["vb"].to_numpy()).astype("f8")
                yield pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "cosine": (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))})

    return pairs.mapInPandas(run, "a long, b long, cosine double")


def _members(vectors: DataFrame, id_col: str, vector_col: str, dim: int, direction: Column, classes: DataFrame, k: int) -> DataFrame:
    """(rep, id, r): every member of the classes of two or more rows; r counts the members of a class by id, exactly for
    the first k + 1 and as k + 2 for the rest, so that no class is sorted in one task."""
    rows = unit_rows(vectors, id_col, vector_col, dim).select("id", direction.alias("d")).distinct().join(classes, "d").select("rep", "id")
    rows = cut(rows)
    first = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    w = Window.partitionBy("rep", "salt").orderBy("id")
    part = first.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).select("rep", "id")
    head = part.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1)
    return rows.join(head, ["rep", "id"], "left").select("rep", "id", F.coalesce("r", F.lit(k + 2)).alias("r"))


def _expand(sides: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """From neighbours of representatives to neighbours of rows. Of a class, a row can need its first k + 1 members only."""
    head = members.filter(F.col("r") <= k + 1).select(F.col("rep").alias("other"), F.col("id").alias("neighbour"))
    wide = sides.join(head, "other", "left").select("rep", F.coalesce("neighbour", "other").alias("neighbour"), "cosine")
    # Members of the same class are neighbours with cosine 1.
    own = members.select(F.col("rep"), "id").join(head.select(F.col("other").alias("rep"), "neighbour"), "rep").filter("id <> neighbour").select("id", "neighbour", F.lit(1.0).alias("cosine"))
    top = Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour")
    wide = wide.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= k).select("rep", "neighbour", "cosine")
    out = wide.join(members.select("rep", "id"), "rep", "left").select(F.coalesce("id", "rep").alias("id"), "neighbour", "cosine").unionByName(own)
    rank = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return out.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("id", "rank", "neighbour", "cosine")


def near_pairs(neighbours: DataFrame, k: int = 3, least: float = 0.90) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of which at least one row is among the other's k best, with a cosine of ``least`` or more."""
    ok = neighbours.filter((F.col("rank") <= k) & (F.col("cosine") >= least))
    return ok.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
