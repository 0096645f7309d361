"""Long exact spans shared between records: repeated-phrase automata.

1. Every text is fingerprinted where it is scanned: of all ``PHRASE``-character windows, those whose hash is least among
   the windows of some ``LEAST``-character stretch (winnowing). Two texts that share ``LEAST`` characters share a
   fingerprint of that stretch, wherever it lies. No text is exchanged for this; a fingerprint has three numbers.
2. Texts that are equal as a whole are one class with one representative, told by digests; fingerprints of the others go.
3. A fingerprint of two or more texts is a recurring passage. The texts that have one are sent once, with the places of
   their passages, into groups of bounded size (a shard). Each shard's passages, cut from its own texts, are compiled into
   Aho-Corasick automata of a bounded number of passages, and the shard's texts are streamed through them to locate every
   occurrence. A passage is compiled only in the shards that hold it, so neither a passage nor a text is a hot key.
4. Occurrences of a passage, with ``LEAST - PHRASE`` characters on both sides, meet by passage; each ``LEAST``-character
   window that stands in two or more texts is confirmed character by character: the characters that two occurrences have
   in common are counted out on both sides. A passage with more than ``HOT`` occurrences is confirmed by grouping its
   windows by digest instead, so no group is unbounded and none is compared pair by pair.

The confirmed windows of a text, merged, are exactly its characters that are shared in spans of ``LEAST`` or more.

Cases: null texts and texts shorter than ``LEAST`` share nothing; every character counts, nothing is normalised; a
passage that recurs within one text only is not shared; equal texts are shared whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import cut, keep_columns
from stacklight.sources.tables import spread

LEAST = 100
PHRASE = 50
SEGMENT = 1 << 18
PER_SHARD = 20_000
"""Passages of one automaton."""
GROUP_CHARS = 2_000_000
"""Characters of the texts of one shard; a longer text is a shard of its own."""
HOT = 500
"""Occurrences of a passage that are compared one by one."""
SMALL = 100_000
"""Rows of eight bytes that are broadcast at most; more take a shuffled join."""
BLOCKS = 256
FLUSH = 20_000
"""Occurrences that a worker holds before it gives them away."""

_BASE = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive entries, by doubling."""
    size, y = 1, x
    while size * 2 <= w:
        y = op(y[:-size], y[size:])
        size *= 2
    return op(y[: len(x) - w + 1], y[w - size : w - size + len(x) - w + 1]) if w > size else y


class Winnower:
    """Winnows many texts at once: all are laid end to end and windows across their borders are masked."""

    def __init__(self, least: int = LEAST, phrase: int = PHRASE) -> None:
        self.least, self.k, self.w = least, phrase, least - phrase + 1
        self.powers = self.inverses = np.zeros(0, "u8")

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.full(n, _BASE, "u8"))
                self.inverses = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), "u8"))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, hash, offset): one row per distinct hash of a text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "u4")
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        n = len(codes)
        if n < self.least:
            return np.zeros(0, int), np.zeros(0, "i8"), np.zeros(0, int)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_mix(codes.astype("u8") + np.uint64(1)) * self.powers[:n])])
            h = _mix((sums[self.k :] - sums[: n - self.k + 1]) * self.inverses[: n - self.k + 1])
        owner = np.repeat(np.arange(len(texts)), sizes)
        least = _sliding(h, self.w, np.minimum)  # of the stretch that starts here
        whole = owner[: n - self.least + 1] == owner[self.least - 1 :]
        least = np.where(whole, least, 0)
        pad = np.zeros(self.w - 1, "u8")
        chosen = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), self.w, np.maximum)[: len(h)] >= h)
        chosen = chosen[h[chosen] > 0]
        t, x = owner[chosen], h[chosen]
        first = np.unique(np.stack([t.astype("u8"), x], 1), axis=0, return_index=True)[1] if len(t) else chosen[:0]
        first = np.sort(first)
        t, x, at = t[first], x[first], chosen[first]
        return t, x.view("i8"), at - (ends - sizes)[t]


def fingerprints(docs: DataFrame, least: int = LEAST, phrase: int = PHRASE, segment: int = SEGMENT) -> DataFrame:
    """docs(id, text) -> (id, h, pos): the text's distinct fingerprints and the first place of each. Texts are hashed in
    segments of bounded length, so a worker's memory doesn't grow with a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        winnow = Winnower(least, phrase)

        def flush(ids: list, texts: list[str], shifts: list[int]) -> pd.DataFrame:
            t, h, at = winnow(texts)
            return pd.DataFrame({"id": np.array(ids, "i8")[t], "h": h, "pos": (np.array(shifts, "i8")[t] + at).astype("i4")})

        for pdf in batches:
            held, size = ([], [], []), 0
            for i, text in zip(pdf["id"], pdf["text"]):
                for s in range(0, max(1, len(text) - least + 1), segment - least + 1):
                    piece = text[s : s + segment]
                    for a, b in zip(held, (i, piece, s)):
                        a.append(b)
                    size += len(piece)
                    if size >= segment:
                        yield flush(*held)
                        held, size = ([], [], []), 0
            if size:
                yield flush(*held)

    return docs.mapInPandas(run, "id long, h long, pos int")


def classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, class_id): equal texts of at least ``least`` characters share the smallest id as class_id. Digests only are shuffled."""
    docs = keep_columns(documents, id_col, text_col).filter(F.col(id_col).isNotNull() & (F.length(text_col) >= least))
    d = docs.select(F.col(id_col).alias("id"), F.sha2(text_col, 256).alias("d"))
    first = d.groupBy("d").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return d.join(first.filter("members > 1"), "d", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def passages(prints: DataFrame) -> DataFrame:
    """(id, hs, ps): of each text the fingerprints that another text has too, and their places; at most those of one text.

    Counts are added up before the shuffle; the join by fingerprint splits a hot one by AQE, for each has one row on its side. A
    text longer than a segment can have a fingerprint twice and so recur with itself; it is compared with no other text then."""
    recurring = prints.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h")
    return prints.join(recurring, "h").groupBy("id").agg(F.collect_list(F.struct("h", "pos")).alias("at")).select("id", F.col("at.h").alias("hs"), F.col("at.pos").alias("ps"))


def locate(docs: DataFrame, hits: DataFrame, phrase: int = PHRASE, margin: int = LEAST - PHRASE, per_shard: int = PER_SHARD, group_chars: int = GROUP_CHARS) -> DataFrame:
    """docs(id, text), hits(id, hs, ps) -> (h, id, pos, lead, context): every occurrence of every recurring passage in the texts that
    have one, with up to ``margin`` characters before and after it; ``lead`` is how many stand before."""

    def shard(ids: list, texts: list[str], hs: list, ps: list) -> Iterator[pd.DataFrame]:
        import ahocorasick

        names: dict[str, int] = {}
        for text, own, at in zip(texts, hs, ps):
            for h, k in zip(own.tolist(), at.tolist()):
                if len(p := text[k : k + phrase]) == phrase:
                    names.setdefault(p, h)
        todo, out = list(names.items()), []
        for s in range(0, len(todo), per_shard):
            auto = ahocorasick.Automaton()
            for p, h in todo[s : s + per_shard]:
                auto.add_word(p, h)
            auto.make_automaton()
            for i, text in zip(ids, texts):
                for end, h in auto.iter(text):
                    at = end - phrase + 1
                    lead = min(at, margin)
                    out.append((h, i, at, lead, text[at - lead : end + 1 + margin]))
                    if len(out) >= FLUSH:
                        yield pd.DataFrame(out, columns=["h", "id", "pos", "lead", "context"])
                        out = []
        yield pd.DataFrame(out, columns=["h", "id", "pos", "lead", "context"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = ([], [], [], []), 0
            for row in zip(pdf["id"], pdf["text"], pdf["hs"], pdf["ps"]):
                for a, b in zip(held, row):
                    a.append(b)
                size += len(row[1])
                if size >= group_chars:
                    yield from shard(*held)
                    held, size = ([], [], [], []), 0
            if size:
                yield from shard(*held)

    return docs.join(hits, "id").select("id", "text", "hs", "ps").mapInPandas(run, "h long, id long, pos long, lead int, context string")


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def confirm(ids: list, at: list, leads: list, contexts: list, phrase: int, least: int) -> tuple[set[tuple], set[tuple]]:
    """Spans (id, start, end) and pairs (a, b) of the occurrences of one passage: the characters two texts have in common
    around it are counted out, and kept where they make ``least``. Equal surroundings are compared once."""
    kinds: dict[tuple, list] = defaultdict(list)
    for i, pos, lead, context in zip(ids, at, leads, contexts):
        kinds[lead, context].append((i, pos))
    spans: set[tuple] = set()
    sets: dict[tuple, tuple] = {}
    sides = [(c[:lead][::-1], c[lead + phrase :], where, tuple(sorted({i for i, _ in where}))) for (lead, c), where in kinds.items()]
    for k, (l1, r1, w1, s1) in enumerate(sides):
        if len(s1) > 1 and len(l1) + phrase + len(r1) >= least:
            sets[s1, s1] = ()
            spans.update((i, p - len(l1), p + phrase + len(r1)) for i, p in w1)
        for l2, r2, w2, s2 in sides[k + 1 :]:
            before, after = _common(l1, l2), _common(r1, r2)
            if before + phrase + after >= least and not (len(s1) == len(s2) == 1 and s1 == s2):
                sets[s1, s2] = ()
                spans.update((i, p - before, p + phrase + after) for i, p in w1 + w2)
    return spans, {(min(a, b), max(a, b)) for x, y in sets for a in x for b in y if a != b}


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, phrase: int = PHRASE, per_shard: int = PER_SHARD, group_chars: int = GROUP_CHARS, hot: int = HOT, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes(id, class_id), pairs(a, b) of representatives with a < b, spans(id, start, end) of representatives, merged)."""
    own = cut(classes(documents, id_col, text_col, least))
    docs = spread(keep_columns(documents, id_col, text_col).filter(F.col(id_col).isNotNull() & (F.length(text_col) >= least)), id_col).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    copies = _broadcast_if_small(own.filter("id <> class_id").select("id"))
    prints = cut(fingerprints(docs, least, phrase, segment)).join(copies, "id", "left_anti")
    hits = cut(passages(prints))
    found = cut(locate(docs, hits, phrase, least - phrase, per_shard, group_chars))
    heavy = cut(found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > hot).select("h"))
    few = _broadcast_if_small(heavy)
    light = found.join(few, "h", "left_anti")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Many passages in one call, told apart by their characters, not by their hash."""
        pdf = pdf.assign(phrase=[c[a : a + phrase] for a, c in zip(pdf["lead"], pdf["context"])]).sort_values("phrase", kind="stable")
        cols = [pdf[c].tolist() for c in ("id", "pos", "lead", "context")]
        names = pdf["phrase"].to_numpy()
        ends = [*(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
        rows, a = [], 0
        for z in ends:
            if z - a > 1:
                spans, pairs = confirm(*[c[a:z] for c in cols], phrase, least)
                rows += [(i, s, e, None) for i, s, e in spans] + [(x, None, None, y) for x, y in pairs]
            a = z
        return pd.DataFrame(rows, columns=["id", "start", "end", "other"]).astype({"id": "i8", "start": "Int64", "end": "Int64", "other": "Int64"})

    groups = max(1, found.count() // 2_000)
    by = light.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(groups)))
    confirmed = by.groupBy("part").applyInPandas(run, "id long, start long, end long, other long")
    exploded = found.join(few, "h").select("id", "context", F.explode(F.sequence(F.lit(0), F.length("context") - least)).alias("o"), (F.col("pos") - F.col("lead")).alias("base")).filter(F.col("o") >= 0)
    windows = exploded.select(F.sha2(F.substring("context", F.col("o") + 1, F.lit(least)), 256).alias("w"), "id", (F.col("base") + F.col("o")).alias("start")).distinct()
    twice = windows.groupBy("w").agg(F.min("id").alias("x"), F.max("id").alias("y")).filter("x < y").select("w")
    shared = cut(windows.join(twice, "w"))
    # Windows of the same set of texts give the same pairs: one of them stands for all. A set is told by the digest of its
    # sorted ids, taken in blocks so that a window of very many texts is never one row.
    texts = shared.select("w", "id").distinct()
    parts = texts.groupBy("w", F.pmod(F.xxhash64("id"), F.lit(BLOCKS)).alias("block")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("d"))
    sets = parts.groupBy("w").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("block", "d")))), 256).alias("d"))
    stand = sets.groupBy("d").agg(F.min("w").alias("w")).select("w")
    sides = texts.join(stand, "w")
    hot_pairs = sides.select("w", F.col("id").alias("a")).join(sides.select("w", F.col("id").alias("b")), "w").filter("a < b").select("a", "b")
    both = cut(confirmed.unionByName(shared.select("id", "start", (F.col("start") + least).alias("end"), F.lit(None).cast("long").alias("other"))))
    pairs = both.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")).unionByName(hot_pairs).distinct()
    return own, pairs, _merge(both.filter("start is not null").select("id", "start", "end").distinct())


def _broadcast_if_small(rows: DataFrame) -> DataFrame:
    """One column of numbers: at most ``SMALL`` of them are broadcast, more are left to a shuffled join."""
    return F.broadcast(rows) if rows.count() <= SMALL else rows


def _merge(spans: DataFrame) -> DataFrame:
    """Overlapping or touching (start, end) of an id become one."""
    w = Window.partitionBy("id").orderBy("start", "end")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("new", (F.coalesce(far, F.lit(-1)) < F.col("start")).cast("int"))
    return fresh.withColumn("g", F.sum("new").over(w)).groupBy("id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


def found_pairs(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, copies expanded: as many rows as the result by definition has."""
    member = own.select("id", "class_id")
    a, b = member.select(F.col("id").alias("ia"), F.col("class_id").alias("a")), member.select(F.col("id").alias("ib"), F.col("class_id").alias("b"))
    across = pairs.join(a, "a").join(b, "b").select("ia", "ib")
    copies = member.join(member.filter("id <> class_id").select("class_id").distinct(), "class_id", "left_semi")
    within = copies.select(F.col("id").alias("ia"), "class_id").join(copies.select(F.col("id").alias("ib"), "class_id"), "class_id").filter("ia < ib").select("ia", "ib")
    return across.unionByName(within).select(F.least("ia", "ib").alias("doc_a"), F.greatest("ia", "ib").alias("doc_b"))


def shared_report(documents: DataFrame, own: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_chars, shared_chars, share) of every document: equal texts are shared whole."""
    size = keep_columns(documents, id_col, text_col).select(F.col(id_col).alias("id"), F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    sums = spans.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("s")).withColumnRenamed("id", "class_id")
    copied = own.filter("id <> class_id").select("class_id").distinct().withColumn("copied", F.lit(True))
    out = size.join(own.join(copied, "class_id", "left"), "id", "left").join(sums, "class_id", "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("s", F.lit(0)))
    out = out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), "n_chars", shared.cast("long").alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(F.lit(0.0)))
