"""Links between documents by their vectors: representative chunks, and likeness in both directions.

A document's chunks can be any share of all rows: they are numbered, banded and averaged by joins and aggregates, and scored
in blocks of bounded size. Only the at most twenty representatives of a document ever meet in one call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.operators import vectors as V
from stacklight.operators.ranking import positions
from stacklight.session import cut

# Representatives of a document; likeness at which one stands for another; hits of an anchor in a document;
# parts of mean and peak; score and share of documents of a hit that is no news; documents compared back; floors; links kept.
LEAST_REPRESENTATIVES, MOST_REPRESENTATIVES = 12, 20
SAME = 0.94
HITS = 2
MEAN_PART, PEAK_PART = 0.75, 0.25
BREADTH_SCORE, BREADTH_SHARE, BREADTH_LEAST = 0.5, 0.3, 3
COARSE = 24
MIN_SYMMETRIC, MIN_DIRECTION = 0.45, 0.35
KEPT = 8
FILL_ROWS = 50_000
"""Chunks of a document that is filled up in one call; a longer one is filled step by step over all its chunks."""
BLOCK = 4_096


def representative_target(n: Column) -> Column:
    root = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return F.when(n < LEAST_REPRESENTATIVES, n).otherwise(F.least(F.lit(MOST_REPRESENTATIVES), F.greatest(F.lit(LEAST_REPRESENTATIVES), root)))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def thinned(vectors: np.ndarray, same: float = SAME) -> list[int]:
    """Rows in order, without those too like an earlier one."""
    x, kept = _unit(vectors), []
    for k in range(len(x)):
        if not kept or np.round(x[kept] @ x[k], 9).max() < same:
            kept.append(k)
    return kept


def farthest_first(vectors: np.ndarray, chosen: list[int], target: int, same: float = SAME) -> list[int]:
    """More rows, each the farthest from those chosen, the first of equally far ones, none of a similarity of ``same`` or more to
    one; no similarity counts as less than 0."""
    x, chosen = _unit(vectors), list(chosen)
    near = np.maximum(np.round(x @ x[chosen].T, 9).max(1), 0) if chosen else np.zeros(len(x))
    near[chosen] = 9
    while len(chosen) < min(target, len(x)):
        k = int(near.argmin())
        if near[k] >= same:
            break
        chosen.append(k)
        near = np.maximum(near, np.round(x @ x[k], 9))
        near[k] = 9
    return chosen


def representatives(chunks: DataFrame, doc: list[str], order: str, vector: str, fill_rows: int = FILL_ROWS) -> DataFrame:
    """(doc, id, pos): the chunks that stand for a document. All of a short one; of a longer one the chunk nearest the centroid of
    each of its equal bands of position, without one too like an earlier one; then the farthest others until the target is reached."""
    n = chunks.groupBy(*doc).agg(F.count(F.lit(1)).alias("n")).withColumn("target", representative_target(F.col("n")))
    c = cut(positions(chunks, doc, order, "id", name="pos").join(n, doc).select(*doc, "id", "pos", "n", "target", F.col(vector).alias("vector")))
    whole, long = c.filter("n <= target").select(*doc, "id", "pos"), c.filter("n > target")
    band = F.floor((F.col("pos") * F.col("target") + F.col("target") - 1) / F.col("n"))
    long = long.withColumn("band", F.least(band, F.col("target") - 1))
    parts = long.select(*doc, "band", F.posexplode("vector").alias("i", "x")).groupBy(*doc, "band", "i").agg(F.avg("x").alias("x"))
    centre = parts.groupBy(*doc, "band").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda y: y["x"]).alias("centre"))
    near = F.round(V.cosine(F.col("centre"), F.col("vector")), 9)
    w = Window.partitionBy(*doc, "band").orderBy(F.desc("s"), "pos")
    picks = long.join(centre, [*doc, "band"]).withColumn("s", near).withColumn("r", F.row_number().over(w)).filter("r = 1").select(*doc, "id", "pos", "n", "target", "vector")
    kinds = ", ".join(f"{k} {picks.schema[k].dataType.simpleString()}" for k in doc)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pdf.iloc[thinned(np.stack(pdf["vector"].to_numpy()).astype("f8"))]

    kept = cut(picks.groupBy(*doc).applyInPandas(thin, f"{kinds}, id long, pos long, n long, target long, vector array<float>"))
    short = kept.groupBy(*doc).agg(F.count(F.lit(1)).alias("have"), F.first("n").alias("n"), F.first("target").alias("target")).filter("have < target").select(*doc, "n")
    near_by = short.filter(F.col("n") <= fill_rows).drop("n")

    def fill(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pos").reset_index(drop=True)
        have = set(left["id"])
        chosen = [k for k, i in enumerate(right["id"]) if i in have]
        more = farthest_first(np.stack(right["vector"].to_numpy()).astype("f8"), chosen, int(right["target"].iloc[0]) if len(right) else 0)
        return right.iloc[[k for k in more if k not in chosen]][[*doc, "id", "pos"]]

    mine, all_ = kept.join(near_by, doc, "left_semi").select(*doc, "id"), long.join(near_by, doc, "left_semi").select(*doc, "id", "pos", "target", "vector")
    mine = mine.select(*[F.col(k).alias(f"k_{k}") for k in mine.columns])
    fill_left = lambda a, b: fill(a.rename(columns=lambda k: k[2:]), b)
    filled = mine.groupBy(*[f"k_{k}" for k in doc]).cogroup(all_.groupBy(*doc)).applyInPandas(fill_left, f"{kinds}, id long, pos long")
    out = whole.unionByName(kept.select(*doc, "id", "pos")).unionByName(filled)
    far = short.filter(F.col("n") > fill_rows).drop("n")
    return out.unionByName(_filled_in_steps(kept.join(far, doc, "left_semi"), long.join(far, doc, "left_semi"), doc)) if len(far.take(1)) else out


def _filled_in_steps(kept: DataFrame, chunks: DataFrame, doc: list[str]) -> DataFrame:
    """The same for documents of any length: each step takes one more chunk of every document that still needs one."""
    near = lambda a: F.round(V.cosine(F.col("vector"), a), 9)
    have = kept.groupBy(*doc).agg(F.collect_list("vector").alias("chosen"), F.count(F.lit(1)).alias("have"))  # at most the target
    first = F.aggregate("chosen", F.lit(0.0), lambda s, y: F.greatest(s, near(y)))
    left = cut(chunks.select(*doc, "id", "pos", "target", "vector").join(have, doc).withColumn("near", first).drop("chosen"))
    out = None
    for _ in range(MOST_REPRESENTATIVES):
        next_ = cut(left.filter((F.col("have") < F.col("target")) & (F.col("near") < SAME)).groupBy(*doc).agg(F.min_by(F.struct("id", "pos", "vector"), F.struct("near", "pos")).alias("p")))
        if not next_.take(1):
            break
        got = next_.select(*doc, "p.id", "p.pos")
        out = got if out is None else out.unionByName(got)
        left = cut(left.join(next_.select(*doc, F.col("p.vector").alias("new")), doc).withColumn("near", F.greatest("near", near(F.col("new")))).withColumn("have", F.col("have") + 1).drop("new"))
    return out if out is not None else kept.select(*doc, "id", "pos").limit(0)


def specificity(breadth: Column, n: Column) -> Column:
    return V.clamp(F.log((n + 1) / (breadth + 1)) / F.log(n + 1))


def direction_scores(hits: DataFrame, anchors: DataFrame, floor: float = BREADTH_SCORE) -> DataFrame:
    """hits(source, anchor, target, score, best), one per anchor and target, anchors(source, anchor, n) with n documents in all ->
    (source, target, score, anchor_score).

    .75 of the weighted mean over all anchors of the source and .25 of the best weighted score of anchors that don't hit more
    than a share of all documents; ``anchor_score`` is the plain score of that one."""
    breadth = hits.groupBy("source", "anchor").agg(F.count_if(F.col("best") >= floor).alias("breadth"))
    w = anchors.join(breadth, ["source", "anchor"], "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    w = w.withColumn("w", specificity(F.col("breadth"), F.col("n"))).withColumn("cap", F.greatest(F.lit(BREADTH_LEAST), F.floor(F.col("n") * BREADTH_SHARE)))
    total = w.groupBy("source").agg(F.sum("w").alias("total"))
    h = hits.join(w, ["source", "anchor"]).join(total, "source").withColumn("ws", F.col("w") * V.clamp(F.col("score")))
    told = (F.col("breadth") <= F.col("cap")) & (F.col("ws") > 0)
    peak = F.max(F.when(told, F.struct(F.round("ws", 9).alias("ws"), (-F.col("anchor")).alias("a"), "score")))
    g = h.groupBy("source", "target").agg((F.sum("ws") / F.max("total")).alias("mean"), peak.alias("peak"))
    score = V.clamp(MEAN_PART * F.coalesce("mean", F.lit(0.0)) + PEAK_PART * F.coalesce("peak.ws", F.lit(0.0)))
    return g.select("source", "target", F.round(score, 9).alias("score"), F.coalesce("peak.score", F.lit(0.0)).alias("anchor_score"))


def symmetric(a: Column, b: Column) -> Column:
    return F.sqrt(V.clamp(a) * V.clamp(b))


def two_best(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, best): the mean of the ``HITS`` best scores, and the best."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"))
    return hits.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= HITS).groupBy(*keys).agg(F.avg("score").alias("score"), F.max("score").alias("best"))


def _anchors(mine: DataFrame, most: int):
    """Blocks of about ``most`` anchors, a source's together, of most anchors first."""
    parts = -(-mine.count() // most)
    for b in range(parts):
        rows = mine.filter(F.pmod(F.xxhash64("document", F.lit(7)), F.lit(parts)) == b).toPandas()
        if len(rows):
            rows["size"] = rows.groupby("document")["id"].transform("size")
            yield rows.sort_values(["library", "size", "document", "id"], ascending=[True, False, True, True], ignore_index=True)


def _by_library(anchors: pd.DataFrame) -> dict:
    """Of each library: names of the sources, their numbers and blocks of their anchors."""
    out, at = {}, 0
    for library, rows in anchors.groupby("library", sort=False):
        name, first, n = np.unique(rows["document"].to_numpy().astype(str), return_index=True, return_counts=True)
        order = np.argsort(first)
        out[library] = {k: at + i for i, k in enumerate(name[order])}, np.arange(at, at + len(name)), V.groups_of(n[order], first[order] + rows.index[0], V.BLOCK // 2)
        at += len(name)
    return out


def _met(batches, found: dict, near_q: np.ndarray):
    """(names of documents, x, frame, place of each source's own document, first source, block, scores, (best, mean of two)): all anchors
    against the documents of their library, whole documents at a time."""
    for pdf in V.whole(batches, ["library", "document"]):
        for library, rows in pdf.groupby("library", sort=False):
            if library not in found:
                continue
            own, source, blocks = found[library]
            rows = rows.reset_index(drop=True)
            x = _unit(np.stack(rows["vector"].to_numpy()).astype("f8"))
            near, heads = x.astype("f4"), rows["document"].drop_duplicates()
            names, counts = heads.to_numpy(), np.diff([*heads.index, len(rows)])
            mine = np.full(len(source), -1)
            for k, name in enumerate(names):
                if name in own:
                    mine[own[name] - source[0]] = k
            for frame in V.frames(counts):
                place = np.full(len(names) + 1, -1)  # the last for sources that have no document here
                place[frame.documents] = np.arange(len(frame.documents))
                for s, n, off, columns in blocks:
                    score = near[frame.rows] @ near_q[columns].T
                    yield names, x, frame, place[mine[s : s + len(n)]], source[0] + s, (n, off, columns), score, frame.two_best(score)


def forward_pairs(vectors: DataFrame, mine: DataFrame, most: int = 4 * V.MAX_QUERIES) -> DataFrame:
    """The ``COARSE`` best targets of each source as by ``direction_scores`` of the two best hits of each anchor (mine: id, library,
    document, vector, n) in each other document of the library: (source, target, score, anchor_score). No hit is written.

    A document is within one task. The first pass counts what each anchor hits; in the second a task carries the best targets of
    each source along, and only documents that reach the last of them in float32, with room for its error, are scored in float64."""
    spark = vectors.sparkSession
    src = V.by_document(vectors.select("library", "document", "vector"), ["library", "document"])
    schema = "source string, target string, score double, anchor_score double"
    out = spark.createDataFrame([], schema)
    for anchors in _anchors(mine, most):
        q = _unit(np.stack(anchors["vector"].to_numpy()).astype("f8"))
        anchors = anchors.drop(columns="vector")
        sent = spark.sparkContext.broadcast((anchors, q))  # about ``most`` vectors

        def breadths(batches, sent=sent):
            anchors, q = sent.value
            count, near_q = np.zeros(len(anchors), "i8"), q.astype("f4")
            for names, x, frame, own, _, (n, off, columns), score, (best, _) in _met(batches, _by_library(anchors), near_q):
                group = np.concatenate([np.arange(b - a) for a, b in zip(off, off[1:])])  # the source of a column
                there = own[group]
                best[there[there >= 0], np.flatnonzero(there >= 0)] = -2
                count[columns] += (best >= BREADTH_SCORE + V.SLACK).sum(0)
                for d, c in zip(*np.nonzero(np.abs(best - BREADTH_SCORE) <= V.SLACK)):
                    rows = frame.rows if frame.long else frame.starts[d] + np.arange(frame.counts[d])
                    count[columns[c]] += np.round(x[rows] @ q[columns[c]], 12).max() >= BREADTH_SCORE
            if len(anchors):
                yield pd.DataFrame({"anchor": anchors["id"].to_numpy(), "breadth": count})[count > 0]

        told = src.mapInPandas(breadths, "anchor long, breadth long").groupBy("anchor").agg(F.sum("breadth").alias("breadth")).toPandas()  # one row an anchor
        breadth = anchors["id"].map(dict(zip(told["anchor"], told["breadth"]))).fillna(0).to_numpy("f8")
        n = anchors["n"].to_numpy("f8")
        w = np.clip(np.log((n + 1) / (breadth + 1)) / np.log(n + 1), 0, 1)
        weights = spark.sparkContext.broadcast((w, breadth <= np.maximum(BREADTH_LEAST, np.floor(n * BREADTH_SHARE))))

        def best_targets(batches, sent=sent, weights=weights):
            (anchors, q), (w, told) = sent.value, weights.value
            found, ids, near_q = _by_library(anchors), anchors["id"].to_numpy(), q.astype("f4")
            source = np.concatenate([list(own) for own, _, _ in found.values()])
            bar, held, new = np.full(len(source), -np.inf), None, []
            now = None

            def kept():
                rows = pd.DataFrame({k: np.concatenate(v) for k, v in zip(("q", "target", "score", "anchor_score"), zip(*new))})
                rows = pd.concat([held, rows], ignore_index=True) if held is not None else rows
                rows = rows.sort_values(["q", "score", "target"], ascending=[True, False, True]).groupby("q", sort=False).head(COARSE)
                full = rows.groupby("q", sort=False)["score"].agg(["min", "size"])
                full = full[full["size"] == COARSE]
                bar[full.index.to_numpy()] = full["min"].to_numpy()
                return rows

            for names, x, frame, own, s, (m, off, columns), score, (_, mean) in _met(batches, found, near_q):
                if now is not names and new:
                    held, new = kept(), []
                now = names
                ws = np.clip(mean, 0, 1) * w[columns].astype("f4")
                peaks = np.where(told[columns], ws, 0)
                total, peak, all_w = ws[:, : len(m)].copy(), peaks[:, : len(m)].copy(), w[columns[: len(m)]].copy()
                for a, b in zip(off[1:], off[2:]):
                    total[:, : b - a] += ws[:, a:b]
                    np.maximum(peak[:, : b - a], peaks[:, a:b], out=peak[:, : b - a])
                    all_w[: b - a] += w[columns[a:b]]
                forward = MEAN_PART * total / np.where(all_w > 0, all_w, 1) + PEAK_PART * peak
                forward[own[own >= 0], np.flatnonzero(own >= 0)] = -2
                limit = bar[s : s + len(m)]
                if len(forward) > COARSE and np.isneginf(limit).any():
                    limit = np.maximum(limit, -np.partition(-forward, COARSE - 1, 0)[COARSE - 1])
                d, k = np.nonzero((forward >= limit - V.SLACK) & (forward > -1))
                if not len(d):
                    continue
                pair, row, col = frame.rows_of(score, d, k, m, off, columns, HITS)
                exact = V.exact_scores(x, q, row, col)
                order = np.lexsort((-exact, col, pair))
                place = V.ranks(order, pair, col)
                order, head = order[place < HITS], np.flatnonzero(place[place < HITS] == 0)
                pair, col = pair[order][head], col[order][head]
                hit = np.add.reduceat(exact[order], head) / np.diff([*head, len(order)])
                own_ws = w[col] * np.clip(hit, 0, 1)
                sums = np.bincount(pair, own_ws, len(d)) / np.where(all_w > 0, all_w, 1)[k]
                news = np.flatnonzero(told[col] & (own_ws > 0))
                round_ws = np.floor(own_ws * 1e9 + 0.5) / 1e9
                news = news[np.lexsort((ids[col[news]], -round_ws[news], pair[news]))]
                news = news[np.diff(pair[news], prepend=-1) > 0]
                top, plain = np.zeros(len(d)), np.zeros(len(d))
                top[pair[news]], plain[pair[news]] = round_ws[news], hit[news]
                value = np.floor(np.clip(MEAN_PART * sums + PEAK_PART * top, 0, 1) * 1e9 + 0.5) / 1e9
                new.append((s + k, names[frame.documents[d]], value, plain))
            if new:
                held = kept()
            if held is not None:
                yield held.assign(source=source[held["q"].to_numpy()])[["source", "target", "score", "anchor_score"]]

        out = out.unionByName(src.mapInPandas(best_targets, schema))
    coarse = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return out.withColumn("r", F.row_number().over(coarse)).filter(F.col("r") <= COARSE).drop("r")


def linked(vectors: DataFrame, chosen: DataFrame, sources: DataFrame, dim: int = 64, block: int = BLOCK, floors: bool = True) -> DataFrame:
    """vectors(id, library, document, vector), chosen(id), the representatives of all documents, sources(document) ->
    (source, target, forward, reverse, symmetric, rank): the at most eight documents of the same library that each source is linked
    to; without ``floors`` all that were compared in both directions.

    Every source's representatives meet all vectors of its library in two scans; the best documents are then scored back from
    their own representatives against the chunks of the source, in blocks; a link's score is the geometric mean of both."""
    docs = vectors.select("library", "document").distinct()
    n = docs.groupBy("library").agg(F.count(F.lit(1)).alias("n"))
    reps = cut(vectors.join(chosen.select("id"), "id", "left_semi"))
    mine = reps.join(sources.select("document").distinct(), "document", "left_semi")
    pairs = cut(forward_pairs(vectors, mine.join(n, "library")))
    back = pairs.select("source", "target").join(reps.select(F.col("document").alias("target"), F.col("id").alias("anchor"), F.col("vector").alias("a_vector")), "target")
    size = vectors.groupBy("document").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")).withColumnRenamed("document", "source")
    own = vectors.join(pairs.select(F.col("source").alias("document")).distinct(), "document", "left_semi").select(F.col("document").alias("source"), "id", "vector").join(size, "source")
    own = own.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    back = back.join(size, "source").select(F.col("source").alias("s"), "target", "anchor", "a_vector", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))

    def against(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"source": [], "target": [], "anchor": [], "score": []}).astype({"anchor": "i8", "score": "f8"})
        x, y = (_unit(np.stack(d.to_numpy()).astype("f8")) for d in (left["a_vector"], right["vector"]))
        score = np.round(x @ y.T, 12)
        k = min(HITS, score.shape[1])
        top = -np.sort(-score, 1)[:, :k]
        r = np.repeat(np.arange(len(x)), k)
        return pd.DataFrame({"source": left["s"].to_numpy()[r], "target": left["target"].to_numpy()[r], "anchor": left["anchor"].to_numpy()[r], "score": top.ravel()})

    scored = back.groupBy("s", "b").cogroup(own.groupBy("source", "block")).applyInPandas(against, "source string, target string, anchor long, score double")
    told = two_best(scored, ["source", "target", "anchor"]).withColumn("c", V.clamp(F.col("score")))
    reverse = told.groupBy("source", "target").agg(F.round(MEAN_PART * F.avg("c") + PEAK_PART * F.max("c"), 9).alias("reverse"), F.max("c").alias("r_anchor"))
    both = pairs.join(reverse, ["source", "target"]).withColumn("symmetric", F.round(symmetric(F.col("score"), F.col("reverse")), 9))
    if floors:
        both = both.filter((F.col("symmetric") >= MIN_SYMMETRIC) & ((F.col("anchor_score") >= MIN_DIRECTION) | (F.col("r_anchor") >= MIN_DIRECTION)))
    order = Window.partitionBy("source").orderBy(F.desc("symmetric"), "target")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= (KEPT if floors else COARSE)).select("source", "target", F.col("score").alias("forward"), "reverse", "symmetric", "rank")
