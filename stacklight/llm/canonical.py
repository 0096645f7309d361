"""Mapping freely entered names to a canonical list: prefix-filter set-similarity join.

Distinct entered strings are normalised into a few readings (compatibility forms, invisible and look-alike characters,
wrappers, turned-round order, words cut short by a point, and without the words that stand around many listed names and
are part of none: these are learnt from the entries). A string with a reading that is a listed name is settled by an
equi-join: it has no misspelling, and no candidate could have fewer. The readings of the other strings meet the names of
the list in one similarity join: both become sets of runs of three characters ordered by global rarity; only rare prefixes
are joined; length and positional filters drop most candidates; Jaccard is then exact, and the best candidates are kept. An
exact check of these follows: the reading may differ from the name by misspellings only, and Han characters not at all (so
they are part of every token). It is refused where it consists of the list's own word groups in a combination that isn't
listed, where one of its halves is as near to another word group of the list, and where it differs by a prefix that turns
the meaning, because a near name of another meaning means none.

A row's fields are decided together: the canonical name first, the alias next, and the abbreviation where neither says
anything. Abbreviations must be equal, letter by letter.

Cases: blank fields and fillers name nothing; a row without any name and a row of unlisted names get -1; repeated rows give one
row per id; an abbreviation of several concepts decides only between readings that fit; null ids are dropped; an empty
list gives -1 for all.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import cut, keep_columns

LEAST, GRAM = 0.27, 3
"""Jaccard similarity of a candidate over runs of ``GRAM`` characters; two misspellings in a name of twelve letters leave that."""
BAND = 0.75
"""Candidates of at least this part of the best similarity go on to the exact check."""
EDITS = 0.34
"""Misspellings for each letter of a name, and two at least."""
RECUR, RECUR_SHARE = 3, 0.05
"""Listed concepts around which a word group must stand to be no part of names, and the share of those of the commonest such group."""
MAX_LIST = 200_000
"""Names of the list; its word groups are sent to every task, so a larger list is refused rather than broadcast."""

# Entries that name nothing.
FILLERS = ("", "-", "--", "?", "??", "n/a", "na", "n.a.", "none", "null", "nil", "tbd", "todo", "see alias", "concept", "unknown", "same", "ditto", "无", "未知", "待定", "同上")
# Letters of other scripts that look like Latin ones.
LOOKALIKE = (("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("у", "y"), ("х", "x"), ("і", "i"), ("ј", "j"), ("ѕ", "s"), ("к", "k"), ("м", "m"), ("н", "h"), ("т", "t"), ("в", "b"), ("ԁ", "d"), ("ո", "n"), ("ѵ", "v"), ("ɡ", "g"), ("ı", "i"), ("ο", "o"))
# Prefixes that turn the meaning of a word.
TURNING = ("an", "a", "un", "in", "im", "ir", "il", "non", "de", "dis", "anti", "hyper", "hypo", "intra", "endo", "exo", "micro", "macro", "nano", "sub", "super", "ab", "ad", "re", "over", "under", "pre", "post")

_look = str.maketrans(dict(LOOKALIKE))
_greek = {unicodedata.name(chr(c)).rpartition(" ")[2].lower(): chr(c) for c in range(0x3B1, 0x3CA) if unicodedata.name(chr(c), "").count(" ") == 3}
_han = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_marks = " #*\"'“”‘’《》«».,;:!?。，；：！？"


def plain(s: str) -> str:
    """Compatibility forms, without invisible characters, look-alikes as Latin letters, lower case, single spaces."""
    s = unicodedata.normalize("NFKC", s)
    s = "".join(c for c in s if unicodedata.category(c) not in ("Cf", "Mn", "Cc") or c in "\t\n")
    s = s.lower().translate(_look)
    return " ".join(s.split())


def compact(s: str) -> str:
    """Letters and digits only; digits within words as the letters they are mistaken for; Greek letters in their own script."""
    out = []
    for w in re.findall(r"[^\W_]+", s):
        if any(c.isalpha() for c in w):
            w = w.replace("0", "o").replace("1", "l")
        out.append(_greek.get(w, w))
    return "".join(out)


def initials(s: str) -> str:
    """An abbreviation in capitals, without marks between its letters."""
    return re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", s)).upper()


class Affixes:
    """Word groups that stand before and after names without being part of them; English ones by words, Han ones by characters."""

    def __init__(self, learnt: list[tuple[str, str]] = ()) -> None:
        """learnt: (side, group), the side being before_en, after_en, before_han or after_han."""
        by = {k: sorted((g for side, g in learnt if side == k), key=lambda g: (-len(g), g)) for k in ("before_en", "after_en", "before_han", "after_han")}
        any_of = lambda k: "|".join(map(re.escape, by[k])) or "(?!)"
        self.before_en, self.after_en = re.compile(rf"^(?:{any_of('before_en')})\s+"), re.compile(rf"\s+(?:{any_of('after_en')})s?$")
        self.before_han, self.after_han = re.compile(rf"^(?:{any_of('before_han')})"), re.compile(rf"(?:{any_of('after_han')})$")
        self.heads, self.tails = [h for g in by["before_en"] if len(h := compact(g)) > 3], [compact(g) for g in by["after_en"]]

    def stripped(self, s: str) -> list[str]:
        """The name itself and the name without the words around it."""
        out = [s]
        while True:
            t = self.after_en.sub("", self.before_en.sub("", s.strip(_marks)))
            if _han.search(t):
                t = self.after_han.sub("", self.before_han.sub("", t))
            if t == s:
                return out
            out.append(t)
            s = t

    def bare(self, c: str) -> list[str]:
        """A compact name without such a group that is written onto it, and without the s of a plural."""
        out = [c[:-1]] if c.endswith("s") and len(c) > 6 else []
        out += [c[: -len(a) - 1] for a in self.tails if c.endswith(a + "s")]
        out += [c[: -len(a)] for a in self.tails if c.endswith(a) and len(c) > len(a) + 6]
        return out + [c[len(b) :] for b in self.heads if c.startswith(b) and len(c) > len(b) + 6]


def around(s: str, lexicon: Lexicon) -> Iterator[tuple[str, str, int]]:
    """(side, word group, concept): what stands before or after a listed name in an entry, where it is no name itself nor the abbreviation of that one."""
    p = plain(s).strip(_marks)
    w = p.split()
    cuts = [("en", w[:k], w[k:]) for k in range(1, len(w))] if len(w) <= lexicon.most_words + 3 else []
    if _han.search(p) and len(w) == 1 and len(p) <= lexicon.longest + 4:
        cuts += [("han", p[:k], p[k:]) for k in range(1, len(p))]
    for kind, left, right in cuts:
        for side, group, name in (("before", left, right), ("after", right, left)):
            concepts = lexicon.names.get(compact(" ".join(name) if kind == "en" else name), ())
            group = " ".join(group) if kind == "en" else group
            if concepts and (re.fullmatch(r"[a-z]+(?: [a-z]+){0,2}", group) if kind == "en" else len(group) <= 4 and len(_han.findall(group)) == len(group)):
                if group not in TURNING and not any(compact(x) in lexicon.groups for x in (group, *group.split())):
                    yield from ((f"{side}_{kind}", group, c) for c in set(concepts) - lexicon.short.get(initials(group), set()))


def _taken_apart(s: str, turn: bool = True) -> list[str]:
    """The sides of a bracket, alone and turned round; the sides of a semicolon; a name turned round at a comma or slash."""
    out = []
    m = re.match(r"^(.+?)\s*[(\[（【]\s*([^()\[\]（）【】]+?)\s*[)\]）】]?\W*$", s)
    if m:
        out += [m[1], m[2], *([f"{m[2]} {m[1]}"] if turn else [])]
    if re.search(r"[;；]", s):
        out += re.split(r"[;；]", s)
    m = re.match(r"^([^,，/]+?)\s*(?:,|，|/)\s*([^,，/]+)$", s)
    if m and turn:
        out.append(f"{m[2]} {m[1]}")
    return [q.strip() for q in out]


def readings(raw: str, lexicon: Lexicon, affixes: Affixes) -> tuple[list[str], list[str]]:
    """(compact names, abbreviations) that an entered string can stand for."""
    s = plain(raw)
    if s in FILLERS:
        return [], []
    # Wrappers can be nested: every part is taken apart again until nothing new comes out. Parts only get shorter, and one
    # that is much too long for a name isn't turned round.
    first = s.replace("_", " ")
    parts, todo = {first: None}, [first]
    while todo:
        p = todo.pop(0)
        for q in [*affixes.stripped(p)[1:], *_taken_apart(p, turn=len(p) <= 4 * lexicon.longest)]:
            if q.strip() and q not in parts:
                parts[q] = None
                todo.append(q)
    names: dict[str, None] = {}
    for p in parts:
        for full in lexicon.spelled_out(p):
            c = compact(full)
            names[c] = None
            if _han.search(c) and "的" in c:
                names[c.replace("的", "")] = None
            names.update(dict.fromkeys(affixes.bare(c)))
    short = [initials(p) for p in re.split(r"[()\[\]（）【】;；]", raw)]
    return [n for n in names if len(n) > 1], [a for a in dict.fromkeys(short) if 1 < len(a) <= lexicon.longest_short + 1 and a.isalnum()]


def distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    eq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        eq[c] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, d = full, 0, len(a)
    for c in b:
        e = eq.get(c, 0)
        x = e | mv
        h = ((((e & pv) + pv) ^ pv) | e) & full
        ph, mh = mv | (full & ~(h | pv)), pv & h
        if ph & top:
            d += 1
        if mh & top:
            d -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv, mv = mh | (full & ~(x | ph)), ph & x
    return d


def allowed(length: int) -> int:
    """Misspellings that a name of ``length`` letters can have at most."""
    return max(2, round(EDITS * length))


class Lexicon:
    """The list's names and the word groups they are made of, learnt from the list alone.

    A name is parted where both sides recur most in other names; the first sides of an English and of a Han name of one
    term are one first group, and likewise the second sides, which gives the names in mixed languages."""

    def __init__(self, terms: list[tuple[int, str, str, str]]) -> None:
        """terms: (concept_id, name_en, name_zh, abbreviation)."""
        self.short: dict[str, set[int]] = defaultdict(set)
        self.names: dict[str, set[int]] = defaultdict(set)
        rows = []
        firsts, seconds = Counter(), Counter()
        for concept, en, zh, ab in terms:
            if ab:
                self.short[initials(ab)].add(concept)
            forms = []
            for name, cuts in ((en, self._gaps(en)), (zh, range(1, len(zh or "")))):
                if name:
                    forms.append([(compact(plain(name[:k])), compact(plain(name[k:]))) for k in cuts])
                    self.names[compact(plain(name))].add(concept)
                else:
                    forms.append([])
            rows.append((concept, forms))
            for options in forms:
                firsts.update(a for a, _ in options)
                seconds.update(b for _, b in options)
        self.words = sorted({w for _, en, _, _ in terms for w in plain(en or "").split()})
        best = lambda options: max(((min(firsts[a], seconds[b]), a, b) for a, b in options), default=None)
        root: dict[tuple, tuple] = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        self.pairs: dict[tuple, set[int]] = defaultdict(set)
        chosen, together = [], Counter()
        for concept, forms in rows:
            parts = [p[1:] if (p := best(o)) and p[0] > 1 else None for o in forms]
            chosen.append((concept, parts))
            if all(parts):
                together[(0, parts[0][0]), (0, parts[1][0])] += 1
                together[(1, parts[0][1]), (1, parts[1][1])] += 1
        partner: dict[tuple, tuple] = {}
        for (x, y), _ in together.most_common():
            if x not in partner and y not in partner:
                partner[x], partner[y] = y, x
                root[find(y)] = find(x)
        self.first, self.second = {}, {}
        for concept, parts in chosen:
            for p in parts:
                if p:
                    a, b = find((0, p[0])), find((1, p[1]))
                    self.first[p[0]], self.second[p[1]] = a, b
                    self.pairs[a, b].add(concept)
                    for other_a in (p[0], partner.get((0, p[0]), (0, p[0]))[1]):
                        for other_b in (p[1], partner.get((1, p[1]), (1, p[1]))[1]):
                            self.names[other_a + other_b].add(concept)
                            self.first.setdefault(other_a, a)
                            self.second.setdefault(other_b, b)
        self.groups = self.first.keys() | self.second.keys() | self.names.keys()
        self.longest = max(map(len, self.names), default=0)
        self.longest_short = max(map(len, self.short), default=0)
        self.most_words = max((len(plain(en or "").split()) for _, en, _, _ in terms), default=0)
        # The beginnings of the listed names at their word gaps.
        self.beginnings = {compact(" ".join(w[:k])) for _, en, _, _ in terms for w in [plain(en or "").split()] for k in range(1, len(w) + 1)}

    @staticmethod
    def _gaps(name: str) -> list[int]:
        return [m.start() for m in re.finditer(" ", name or "")]

    def spelled_out(self, s: str, most: int = 24) -> list[str]:
        """The readings of a name with words cut short by a point; the name itself where it has none. Of more than ``most`` readings
        those go on that begin a listed name."""
        if "." not in s:
            return [s]
        out = [""]
        for w in re.sub(r"\.(?=\S)", ". ", s).split():
            stem = compact(w)
            full = [x for x in self.words if w.endswith(".") and len(stem) > 1 and compact(x).startswith(stem) and compact(x) != stem]
            if w.endswith(".") and len(stem) > 3 and not full:  # misspelt and cut short
                full = [x for x in self.words if min(distance(compact(x)[:k], stem) for k in (len(stem) - 1, len(stem), len(stem) + 1)) <= 1]
            out = [f"{a} {x}" for a in out for x in (full or [w])]
            if len(out) > most:
                out = [a for a in out if compact(a) in self.beginnings]
        return [a.strip() for a in out] or [s]

    def parted(self, v: str) -> list[tuple[str, str]]:
        return [(v[:i], v[i:]) for i in range(1, len(v)) if v[:i] in self.first and v[i:] in self.second]

    def refused(self, v: str) -> bool:
        """Made of the list's own word groups, but not listed."""
        return len(v) <= 2 * self.longest and v not in self.names and bool(self.parted(v))

    def cost(self, v: str, name: str) -> int | None:
        """Misspellings between a reading and a listed name, or None where they mean different things."""
        if v == name:
            return 0
        if v in self.names or self.refused(v):
            return None
        d = distance(v, name)
        if d > allowed(len(name)) or "".join(_han.findall(v)) != "".join(_han.findall(name)):
            return None
        halves = self.parted(name)
        if not halves:
            return d if d <= max(1, len(name) // 6) and not _turned(v, name) else None
        for p, q in halves:
            at = sorted(range(max(1, len(p) - d), min(len(v), len(p) + d + 1)), key=lambda i: (distance(v[:i], p) + distance(v[i:], q), abs(i - len(p))))
            if not at:
                continue
            x, y = v[: at[0]], v[at[0] :]
            if self._nearest(x, p, self.first) and self._nearest(y, q, self.second) and not _turned(x, p) and not _turned(y, q):
                return d
        return None

    @staticmethod
    def _nearest(x: str, own: str, groups: dict) -> bool:
        d = distance(x, own)
        if d == 0:
            return True
        if d > max(2, len(own) // 2):
            return False
        return all(abs(len(g) - len(x)) > d or groups[g] == groups[own] or distance(x, g) > d for g in groups if g != own)


def _turned(x: str, y: str) -> bool:
    """Whether one is the other under a prefix that turns its meaning."""
    return any(x == t + y or y == t + x for t in TURNING)


def _grams(d: DataFrame, key: str, n: int) -> DataFrame:
    """(key, t): the runs of n characters, each with all Han characters of the string before it: strings with other Han
    characters share none."""
    han = d.select(key, F.regexp_replace(key, "[^㐀-䶿一-鿿豈-﫿]", "").alias("han"))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (n - 1), F.lit(1))), lambda i: F.substring(F.col(key), i, F.lit(n))))
    return han.select(key, "han", F.explode(runs).alias("t")).select(key, F.concat("han", F.lit("|"), "t").alias("t"))


def similar(left: DataFrame, right: DataFrame, least: float = LEAST, gram: int = GRAM, edits: bool = False) -> DataFrame:
    """left(v), right(name), both distinct -> (v, name, jaccard) of all pairs with a Jaccard similarity of ``least`` or more
    between their sets of runs of ``gram`` characters; with ``edits`` only of pairs whose lengths differ by no more misspellings
    than a name can have.

    Only the rare prefixes are joined; a candidate must fit in length, and what can still be shared after the joined position
    must suffice. Pairs are then compared exactly, once each."""
    l, r = _grams(left, "v", gram), _grams(right, "name", gram)
    tokens = l.select("t").unionByName(r.select("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))

    def ordered(d: DataFrame, key: str) -> DataFrame:
        """The set in order of global rarity."""
        return d.join(tokens, "t").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("s")).select(key, F.col("s.t").alias("s"))

    def prefix(d: DataFrame, key: str, p: str) -> DataFrame:
        """Rows of numbers only: strings meet again where pairs are compared."""
        n = F.size("s")
        size = (n - F.ceil(F.lit(least) * n) + 1).cast("int")
        return d.select(f"{p}id", n.alias(f"{p}n"), F.length(key).alias(f"{p}c"), F.posexplode(F.slice("s", F.lit(1), size)).alias(f"{p}i", "t"))

    ls, rs = (cut(ordered(d, key).withColumn(f"{p}id", F.monotonically_increasing_id())) for d, key, p in ((l, "v", "l"), (r, "name", "r")))
    hits = prefix(ls, "v", "l").join(prefix(rs, "name", "r"), "t")
    fits = (F.col("rn") >= F.lit(least) * F.col("ln")) & (F.col("ln") >= F.lit(least) * F.col("rn"))
    if edits:
        fits = fits & (F.abs(F.col("lc") - F.col("rc")) <= F.greatest(F.lit(2), F.ceil(EDITS * F.col("rc"))))
    need = F.lit(least / (1 + least)) * (F.col("ln") + F.col("rn"))
    room = F.least(F.col("ln") - F.col("li"), F.col("rn") - F.col("ri"))
    # Only the first common prefix token of a pair meets the positional filter: later ones would refuse it wrongly.
    # Both positions are one number, so that the aggregation is by hash.
    first = F.min(F.shiftleft(F.col("li").cast("long"), 32) + F.col("ri")).alias("m")
    pairs = hits.filter(fits).groupBy("lid", "rid").agg(first, F.min("ln").alias("ln"), F.min("rn").alias("rn"))
    pairs = pairs.select("lid", "rid", "ln", "rn", F.shiftright("m", 32).alias("li"), F.col("m").bitwiseAND(F.lit((1 << 32) - 1)).alias("ri")).filter(room >= need - 1e-9)
    both = pairs.select("lid", "rid").join(ls.withColumnRenamed("s", "a"), "lid").join(rs.withColumnRenamed("s", "b"), "rid")
    shared = F.size(F.array_intersect("a", "b"))
    j = shared / (F.size("a") + F.size("b") - shared)
    return both.select("v", "name", j.alias("jaccard")).filter(F.col("jaccard") >= least - 1e-9)


def learn_affixes(strings: DataFrame, known: Broadcast) -> list[tuple[str, str]]:
    """(side, word group): groups that stand around the names of many listed concepts. Counted by concept over all distinct
    entries; what comes back are groups that are common by a share, so their number doesn't grow with the entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([x for s in pdf["s"] for x in set(around(s, known.value))], columns=["side", "part", "concept_id"])

    seen = strings.mapInPandas(run, "side string, part string, concept_id long").distinct()
    n = seen.groupBy("side", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= RECUR)
    top = n.groupBy("side").agg(F.max("n").alias("top"))
    return sorted((r["side"], r["part"]) for r in n.join(top, "side").filter(F.col("n") >= RECUR_SHARE * F.col("top")).collect())


def map_names(inputs: DataFrame, terms: DataFrame, least: float = LEAST) -> DataFrame:
    """(input_id, concept_id, how): one row per distinct input_id; concept_id -1 where the row means none of the list."""
    spark = inputs.sparkSession
    listed = terms.select("concept_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("name_en", "name_zh", "abbreviation")]).dropna().distinct()
    if listed.count() > MAX_LIST:
        raise ValueError(f"the list has more than {MAX_LIST} names")
    lexicon = Lexicon(sorted(tuple(r) for r in listed.collect()))
    known = spark.sparkContext.broadcast(lexicon)  # bounded by MAX_LIST
    fields = ("canonical_name", "alias_text", "abbr")
    src = keep_columns(inputs, "input_id", *fields).filter("input_id is not null")
    long = src.select("input_id", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(c).alias("s")) for k, c in enumerate(fields)])).alias("x")).select("input_id", "x.field", "x.s")
    long = long.filter(F.rlike("s", F.lit(r"[\p{L}\p{N}]")))
    strings = cut(long.select("s").distinct())
    affixes = Affixes(learn_affixes(strings, known))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s in pdf["s"]:
                names, short = readings(s, known.value, affixes)
                out += [(s, k, v, None) for k, v in enumerate(names)] + [(s, k, None, v) for k, v in enumerate(short)]
            yield pd.DataFrame(out, columns=["s", "k", "v", "short"])

    read_ = cut(strings.mapInPandas(read, "s string, k int, v string, short string"))
    v = read_.filter("v is not null").select("s", "v")
    names = spark.createDataFrame([(n, sorted(c)) for n, c in sorted(lexicon.names.items())], "name string, concepts array<long>")
    listed_names = v.join(names, F.col("v") == F.col("name")).select("s", F.explode("concepts").alias("concept_id"))
    exact = cut(listed_names.groupBy("s").agg(F.sort_array(F.collect_set("concept_id")).alias("named"), F.lit(0).alias("cost")))
    v = cut(v.join(exact.select("s"), "s", "left_anti"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whether a reading is made of the list's word groups but isn't listed."""
        for pdf in batches:
            yield pdf.assign(refused=[known.value.refused(x) for x in pdf["v"]])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = known.value
        for pdf in batches:
            out = []
            for a, b, j in zip(pdf["v"], pdf["name"], pdf["jaccard"]):
                d = lex.cost(a, b)
                if d is not None:
                    out += [(a, c, d, j) for c in lex.names[b]]
            yield pd.DataFrame(out, columns=["v", "concept_id", "cost", "jaccard"])

    judged = cut(v.select("v").distinct().mapInPandas(judge, "v string, refused boolean"))
    # A longer reading has more misspellings than the exact check allows any name.
    near = similar(judged.filter(~F.col("refused") & (F.length("v") <= lexicon.longest + allowed(lexicon.longest))).select("v"), names.select("name"), least, edits=True)
    near = near.withColumn("top", F.max("jaccard").over(Window.partitionBy("v"))).filter(F.col("jaccard") >= BAND * F.col("top")).select("v", "name", "jaccard")
    meant = v.join(near.mapInPandas(verify, "v string, concept_id long, cost int, jaccard double"), "v").select("s", "concept_id", "cost")
    # The least misspelt reading; of those the concepts that share it.
    concepts = meant.groupBy("s", "cost").agg(F.sort_array(F.collect_set("concept_id")).alias("named"))
    misspelt = concepts.groupBy("s").agg(F.min_by("named", "cost").alias("named"), F.min("cost").alias("cost"))
    by_name = exact.unionByName(misspelt)
    barred = v.join(judged.filter("refused"), "v").select("s", "refused").distinct()
    short = spark.createDataFrame([(a, sorted(c)) for a, c in sorted(lexicon.short.items())], "short string, abbreviated array<long>")
    ask = read_.filter("short is not null").select("s", "k", "short", F.explode(F.array(F.col("short"), F.when(F.col("short").endswith("S"), F.expr("left(short, length(short) - 1)")))).alias("form")).filter("form is not null")
    by_short = ask.join(short.withColumnRenamed("short", "form"), "form").groupBy("s").agg(F.min_by("abbreviated", F.struct(F.length("short") - F.length("form"), "k")).alias("abbreviated"))
    verdict = strings.join(by_name, "s", "left").join(barred, "s", "left").join(by_short, "s", "left")
    verdict = verdict.withColumn("empty", F.lower(F.trim("s")).isin(*FILLERS))
    rows = long.join(verdict, "s")
    pick = lambda k, c: F.first(F.when(F.col("field") == k, F.col(c)), ignorenulls=True)
    rows = rows.groupBy("input_id").agg(
        *[pick(k, c).alias(f"{c}{k}") for k in (0, 1, 2) for c in ("named", "abbreviated", "refused", "cost")],
        *[F.coalesce(F.bool_or(F.when(F.col("field") == k, ~F.col("empty"))), F.lit(False)).alias(f"said{k}") for k in (0, 1, 2)],
    )
    ab = F.coalesce("abbreviated2", "abbreviated0", "abbreviated1")

    def decide(k: int):
        """The concept of a name field: the only one, or the one its abbreviation agrees with."""
        n = F.col(f"named{k}")
        agreed = F.array_intersect(n, F.coalesce(ab, F.array().cast("array<bigint>")))
        one = F.when(F.size(n) == 1, n[0]).when(F.size(agreed) == 1, agreed[0])
        return F.when(F.col(f"refused{k}").isNotNull() & (F.coalesce(f"cost{k}", F.lit(1)) > 0), F.lit(-1)).otherwise(one)

    only = F.when(F.size(ab) == 1, ab[0])
    silent = ~F.col("said0") & ~F.col("said1")
    bare = F.col("abbreviated0").isNotNull() | F.col("abbreviated1").isNotNull()
    concept = F.coalesce(decide(0), decide(1), F.when(silent | bare, only), F.lit(-1))
    how = F.when(concept == -1, "none").when(decide(0).isNotNull(), "name").when(decide(1).isNotNull(), "alias").otherwise("abbreviation")
    got = rows.select("input_id", concept.cast("long").alias("concept_id"), how.alias("how"))
    return src.select("input_id").distinct().join(got, "input_id", "left").select("input_id", F.coalesce("concept_id", F.lit(-1)).alias("concept_id"), F.coalesce("how", F.lit("none")).alias("how"))


def asked(inputs: DataFrame, terms: DataFrame) -> DataFrame:
    """(input_id) of the rows with a field that isn't blank and none that is a listed name byte for byte."""
    exact = terms.select(F.explode(F.array("name_en", "name_zh", "abbreviation")).alias("s")).filter("s <> ''").distinct()
    fields = F.array("canonical_name", "alias_text", "abbr")
    long = inputs.select("input_id", F.explode(fields).alias("s")).filter(F.rlike("s", F.lit(r"\S")))
    said = long.select("input_id").distinct()
    return said.join(long.join(exact, "s", "left_semi").select("input_id").distinct(), "input_id", "left_anti")
