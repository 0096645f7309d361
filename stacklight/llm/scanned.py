"""Noise in text from scanned pages: finding it and repairing the text.

One pass over the texts yields, by row: word counts (aggregated before they leave the task), lines that could be running
headers, under a key with digits masked and confusable glyphs folded, page-number lines, and words parted at line ends. The
decisions are joins and aggregates over all rows:

* header: a line whose key is the paper's title (or a cut of it) or its journal, or whose key recurs in several rows;
* folio: a page number in a line of its own, which a series of numbers is not, or at an end of a header;
* hyphen: a word parted at a line end whose joined form is more frequent in the corpus than its hyphenated form;
* glyph: words are grouped by their confusable-glyph skeleton; a word far rarer than the most frequent form of its group
  is misread. Han characters have no word groups: which of them are taken for which is learnt from all texts (a character that
  mostly stands where another is far more frequent) and known for a few look-alikes; such a character is misread if its
  neighbours go far more often with its counterpart. A second pass gives only words that could be doubted or contested ones: it is told by two bit sets
  of bounded size, which let all of these words through and few others; the others go in the joins that follow.

Cases: null and empty texts have no noise; a text without line breaks can have glyph noise only; repeated rows are judged
row by row; a null library or paper only loses the comparison with the title; ties between frequent forms go to the
form that the words beside it support, then to the one first in order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stacklight.llm.common import cut, keep_columns
from stacklight.sources.tables import spread

# Glyphs that scanners confuse. Every form is spelled out to the same strokes, so that "m" and "rn", or "u" and
# "ii", become one string wherever they stand.
STROKES = (("ç", "c"), ("e", "c"), ("f", "t"), ("1", "l"), ("i", "l"), ("|", "l"), ("!", "l"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("q", "g"), ("9", "g"), ("m", "rrl"), ("n", "rl"), ("w", "vv"), ("d", "cl"), ("u", "ll"), ("h", "ll"))
# Look-alikes that are asked about in any corpus, however small.
HAN = (("品", "晶"), ("科", "料"), ("粕", "粒"), ("摸", "模"), ("簿", "薄"), ("折", "析"), ("末", "未"), ("己", "已"), ("日", "曰"), ("土", "士"), ("人", "入"), ("干", "千"), ("抉", "快"), ("侯", "候"), ("戊", "戌"))

BITS_A_WORD, BITS_MOST = 12, 1 << 27
"""Size of a bit set: 12 bits a word let one other word in a hundred through; 16 MB at most, which let more through."""
KNOWN = 300_000
"""Words that a worker remembers to have looked up."""
RARER = 8
"""A form is misread if another form of its group is at least so many times as frequent."""
HAN_SHARE, HAN_CONTEXTS = 0.25, 3
"""Share of a character's places, and distinct neighbourhoods, where another must be ``RARER`` times as frequent, for it to be taken for that one."""
RECUR = 3
"""Rows in which a header's key has to stand where neither title nor journal is known to match."""

_strokes = str.maketrans(dict(STROKES))
_fold = str.maketrans({**dict(STROKES), **dict(HAN)})
_table = np.array([c.isspace() for c in map(chr, range(1 << 16))])
_is_han = np.array([0x3400 <= c < 0x4DC0 or 0x4E00 <= c < 0xA000 or 0xF900 <= c < 0xFB00 for c in range(1 << 16)])

_ALNUM = "0-9a-zª-ɏͰ-ԯ"  # lower case; Han has no words
_WORD = re.compile(rf"[{_ALNUM}]+(?:[-‐][{_ALNUM}]+)*")
_PARTED = re.compile(r"([^\W\d_]+)([-‐¬\xad])[ \t\xa0]*$")
_END_MARKS = ("-", "‐", "¬", "\xad")
_START = re.compile(r"[ \t]*([^\W\d_]+)")
_NUMBER = r"(?:[0-9lIO]{0,3}[0-9][0-9lIO]{0,3}|[ivxlc]{1,8}|[IVXLC]{1,8})"
_FOLIO = re.compile(rf"\s*(?:{_NUMBER}|[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|\(\s*{_NUMBER}\s*\)|(?:[Pp]age|[Pp]\.|[Ss]eite|第)\s*{_NUMBER}\s*页?(?:\s*(?:of|/)\s*{_NUMBER})?)\s*$")
_PLAIN = re.compile(r"\s*\d+(?:[.,]\d+)?\s*$")
_ROMAN = re.compile(r"\s*m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\s*$", re.I)
_MARK = rf"(?:{_NUMBER}|[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*\]|(?:[Pp]age|[Pp]\.)\s*{_NUMBER})"
_AT_START = re.compile(rf"\s*{_MARK}(?:\s*[|•·]\s*|\t+\s*|\s{{2,}}|(?<=[-–—\]])\s+)(?=\S)")
_AT_END = re.compile(rf"(?:\s*[|•·]\s*|\t+\s*|\s{{2,}}){_MARK}\s*$")
_NOT_HEADER = re.compile(r"\s*(?:#|[-*•|>]\s|\d+[.)]\s|$)")
_RUN = re.compile(r"[^\W_]+")
_ET_AL = re.compile(r"^.{2,60}?\bet\s+a[l1I]\.\s*/\s*", re.S)


def skeleton(word: str) -> str:
    """The word with every confusable glyph folded, so that all readings of one printed word share it."""
    return word.lower().translate(_strokes)


def header_key(line: str) -> str:
    """Digits, marks and spaces masked, glyphs folded. An author group before a journal is dropped."""
    if "/" in line:
        line = _ET_AL.sub("", line)
    return "".join(t for t in _RUN.findall(line.lower()) if not t.isdigit()).translate(_fold)


def split_folio(line: str) -> tuple[str, bool]:
    """The header without a page number at its ends, and whether there was one."""
    m = _AT_START.match(line)
    if m:
        return line[m.end() :], True
    m = _AT_END.search(line)
    if m and m.start() > 0:
        return line[: m.start()], True
    return line, False


def _is_folio(lines: list[str], k: int) -> bool:
    line = lines[k]
    if not _FOLIO.match(line):
        return False
    if _PLAIN.match(line):
        beside = [lines[j] for j in (k - 1, k + 1) if 0 <= j < len(lines)]
        return not any(_PLAIN.match(x) for x in beside)
    bare = line.strip()
    return not bare.isalpha() or bool(_ROMAN.match(bare)) and bare.islower()


def _candidate(line: str) -> bool:
    """Whether a line can be a header: short, no markup, no end of a sentence, and not begun in lower case."""
    if len(line) > 130 or _NOT_HEADER.match(line):
        return False
    end = line.rstrip()
    first = next((c for c in end if c.isalpha()), "a")
    return not first.islower() and (end[-1] not in ".。;；,，:：!?！？" or end.endswith("..."))


def parse(text: str) -> tuple[list[int], list[tuple[int, str, bool]], list[tuple[int, str, str, str]]]:
    """(folio lines, header candidates (line, key, has folio), parted words (line, left, mark, right))."""
    lines = text.replace("\f", "").split("\n")
    folios = [k for k, x in enumerate(lines) if x and len(x) < 24 and _is_folio(lines, k)]
    heads = []
    for k, x in enumerate(lines):
        if 5 <= len(x) <= 130 and k not in folios and _candidate(x):
            rest, numbered = split_folio(x)
            key = header_key(rest)
            if len(key) >= 6 or key and not key.isascii():
                heads.append((k, key, numbered))
    parted = []
    if len(lines) > 1:
        skip = {*folios, *(k for k, _, _ in heads)}
        for k, x in enumerate(lines[:-1]):
            # Most lines end otherwise, and the search goes over the whole line.
            m = _PARTED.search(x) if x.rstrip(" \t\xa0")[-1:] in _END_MARKS else None
            if m:
                j = k + 1
                while j < len(lines) - 1 and (not lines[j].strip() or j in skip and not (j == k + 1 and _START.match(lines[j]) and lines[j].lstrip()[:1].islower() and j not in folios)):
                    j += 1
                n = _START.match(lines[j])
                if n and n[1][:1].islower():
                    parted.append((k, m[1], m[2], n[1]))
    return folios, heads, parted


_LINE_MARK = re.compile(r"[-‐¬\xad][ \t\xa0]*\n\s*")
_STARTS = re.compile(r"[^\W_]+")
_HAN_ANY = re.compile("[㐀-䶿一-鿿豈-﫿]")


def words(text: str) -> list[str]:
    """Lower-cased words and compounds, without words parted at line ends; parts of compounds count as words too."""
    text = text.lower()
    if _LINE_MARK.search(text):
        parts = _LINE_MARK.split(text)
        for k in range(len(parts) - 1):
            left, right = parts[k], parts[k + 1]
            if left[-1:].isalnum() and right[:1].isalnum():
                parts[k] = left[: len(left) - len(_STARTS.match(left[::-1])[0])]
                parts[k + 1] = right[_STARTS.match(right).end() :]
        text = " ".join(parts)
    found = _WORD.findall(text)
    return found + [p for w in found if "-" in w or "‐" in w for p in re.split("[-‐]", w)]


def neighbours(text: str, asked: re.Pattern) -> list[tuple[int, str, str, str]]:
    """(line, before, character, after) of the asked Han characters; line breaks and spaces don't part neighbours."""
    if not asked.search(text):
        return []
    out, line, lines = [], 0, text.split("\n")
    bare = ["".join(x.split()) for x in lines]
    flat = "".join(bare)
    ends = list(accumulate(map(len, bare)))
    for m in asked.finditer(flat):
        i = m.start()
        while ends[line] <= i:
            line += 1
        out.append((line, flat[i - 1 : i], m[0], flat[i + 1 : i + 2]))
    return out


def triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the runs of three Han characters; the key holds their numbers in 21 bits each."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), "u4")
    codes = codes[(codes >= 1 << 16) | ~_table[codes & 0xFFFF]]
    han = (codes < 1 << 16) & _is_han[codes & 0xFFFF]
    at = np.flatnonzero(han[:-2] & han[1:-1] & han[2:]) if len(codes) > 2 else np.zeros(0, int)
    c = codes.astype("i8")
    return np.unique(c[at] << 42 | c[at + 1] << 21 | c[at + 2], return_counts=True)


def han_pairs(found: DataFrame) -> list[tuple[str, str]]:
    """(seen, meant): the known look-alikes both ways, and what is learnt: at most one for each character there is."""
    t = found.filter("kind = 'han'").groupBy(F.col("row_id").alias("key")).agg(F.sum("n").alias("n"))
    mask = F.lit((1 << 21) - 1)
    part = lambda k: F.shiftright("key", k).bitwiseAND(mask)
    t = t.select(part(42).alias("before"), part(21).alias("seen"), part(0).alias("after"), "n")
    top = t.groupBy("before", "after").agg(F.max(F.struct("n", "seen")).alias("m")).select("before", "after", F.col("m.n").alias("top_n"), F.col("m.seen").alias("meant"))
    rare = t.join(top.filter(F.col("top_n") >= RARER), ["before", "after"]).filter(F.col("n") * RARER <= F.col("top_n"))
    g = rare.groupBy("seen", "meant").agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= HAN_CONTEXTS)
    g = g.join(t.groupBy("seen").agg(F.sum("n").alias("all")), "seen").filter(F.col("m") >= HAN_SHARE * F.col("all"))
    best = g.groupBy("seen").agg(F.max_by("meant", F.struct("m", "meant")).alias("meant"))
    learnt = {(chr(r["seen"]), chr(r["meant"])) for r in best.collect()}  # as many rows as Han characters at most
    return sorted(learnt | {p for x, y in HAN for p in ((x, y), (y, x))})


def _wordlike(w: str) -> bool:
    letters = sum(c.isalpha() for c in w)
    return letters >= 3 and len(w) - letters - w.count("-") <= letters // 2


FACTS = "kind string, row_id long, line int, a string, b string, c string, n long"


def facts(chunks: DataFrame) -> DataFrame:
    """The first pass: one row per fact, word counts added up per batch of rows."""
    src = spread(keep_columns(chunks, "row_id", "library_id", "item_key", "text").filter(F.length("text") > 0), "row_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            out: list[tuple] = []
            for i, lib, item, text in zip(pdf["row_id"], pdf["library_id"], pdf["item_key"], pdf["text"]):
                counts.update(words(text))
                if "\n" in text:
                    folios, heads, parted = parse(text)
                    out += [("folio", i, k, None, None, None, 1) for k in folios]
                    out += [("head", i, k, key, None if pd.isna(lib) else str(int(lib)), item, int(num)) for k, key, num in heads]
                    out += [("parted", i, k, skeleton(x + y), skeleton(f"{x}-{y}"), m, 1) for k, x, m, y in parted]
                    out += [("halves", i, k, skeleton(x + y), (x + y).lower(), None, 1) for k, x, m, y in parted]
            yield pd.DataFrame(out, columns=["kind", "row_id", "line", "a", "b", "c", "n"])
            keys, n = triples(pdf["text"].tolist())
            if len(keys):
                yield pd.DataFrame({"kind": "han", "row_id": keys, "line": -1, "a": None, "b": None, "c": None, "n": n})
            if len(counts) > 200_000:
                yield _counted(counts)
                counts.clear()
        if counts:
            yield _counted(counts)

    return src.mapInPandas(run, FACTS)


def _counted(counts: Counter) -> pd.DataFrame:
    return pd.DataFrame([("word", -1, -1, w, None, None, n) for w, n in counts.items()], columns=["kind", "row_id", "line", "a", "b", "c", "n"])


def word_groups(found: DataFrame) -> DataFrame:
    """(word, n, skeleton, best, best_n): best is the most frequent form of letters only of the word's group."""
    counts = found.filter("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("n").alias("n"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(skeleton=[skeleton(w) for w in pdf["word"]], wordlike=[_wordlike(w) for w in pdf["word"]])

    w = cut(counts.mapInPandas(fold, "word string, n long, skeleton string, wordlike boolean"))
    pure = F.rlike("word", F.lit(r"^[\p{L}‐-]+$"))
    best = w.filter("wordlike").groupBy("skeleton").agg(F.max(F.when(pure, F.struct("n", "word"))).alias("m"), F.sum("n").alias("group_n"))
    return w.join(best, "skeleton", "left").select("word", "n", "skeleton", F.coalesce("wordlike", F.lit(False)).alias("wordlike"), F.col("m.word").alias("best"), F.col("m.n").alias("best_n"), "group_n")


def headers(found: DataFrame, items: DataFrame) -> DataFrame:
    """(row_id, line, numbered) of the candidates that are headers."""
    head = found.filter("kind = 'head'").select("row_id", "line", F.col("a").alias("key"), F.col("b").cast("long").alias("library_id"), F.col("c").alias("item_key"), F.col("n").alias("numbered"))
    names = keep_columns(items, "library_id", "item_key", "title", "publication_title").dropna(subset=["library_id", "item_key"]).distinct()

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = lambda c: [header_key(x) if isinstance(x, str) else None for x in pdf[c]]
            yield pd.DataFrame({"library_id": pdf["library_id"], "item_key": pdf["item_key"], "tkey": k("title"), "jkey": k("publication_title")})

    names = names.mapInPandas(keys, "library_id long, item_key string, tkey string, jkey string")
    # A paper can hold a third of the rows: its candidates are folded to distinct keys before they meet its title.
    asked = head.select("library_id", "item_key", "key").distinct()
    title = F.startswith("tkey", F.col("key")) & (F.length("key") >= F.when(F.rlike("key", F.lit(r"^\p{ASCII}+$")), 8).otherwise(4))
    known = asked.join(names, ["library_id", "item_key"]).filter(title | (F.col("key") == F.col("jkey"))).select("library_id", "item_key", "key").distinct()
    by_paper = head.join(known, ["library_id", "item_key", "key"], "left_semi")
    # Journals of the whole library serve papers whose own journal is missing.
    journals = names.select(F.col("jkey").alias("key")).filter(F.length("jkey") >= 10).distinct()
    by_journal = head.join(journals, "key", "left_semi")
    # Without either, a key that recurs in one paper, between other lines, and never as a line of prose.
    often = asked_rows(head)
    by_habit = head.join(often, ["library_id", "item_key", "key"], "left_semi")
    out = by_paper.unionByName(by_journal).unionByName(by_habit)
    return out.groupBy("row_id", "line").agg(F.max("numbered").alias("numbered"))


def asked_rows(head: DataFrame) -> DataFrame:
    rows = head.filter(F.length("key") >= 16).groupBy("library_id", "item_key", "key").agg(F.count_distinct("row_id").alias("rows"))
    return rows.filter(F.col("rows") >= RECUR).select("library_id", "item_key", "key")


def misread_han(both: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(row_id, line, before, seen, after, meant) of the Han characters whose neighbours go with the counterpart."""
    z = both.filter("kind = 'han'").select("row_id", "line", "before", F.col("word").alias("seen"), "after")
    seen = z.groupBy("before", "seen", "after").agg(F.count(F.lit(1)).alias("n"))
    left, right = seen.groupBy("before", "seen").agg(F.sum("n").alias("n")), seen.groupBy("seen", "after").agg(F.sum("n").alias("n"))
    ask = seen.join(z.sparkSession.createDataFrame(pairs, "seen string, meant string"), "seen").select("before", "seen", "after", "meant")
    for side, keys in (("l", ["before"]), ("r", ["after"])):
        t = left if side == "l" else right
        for name in ("seen", "meant"):
            ask = ask.join(t.select(*keys, F.col("seen").alias(name), F.col("n").alias(f"{side}_{name}")), [*keys, name], "left")
    total = lambda name: F.coalesce(f"l_{name}", F.lit(0)) + F.coalesce(f"r_{name}", F.lit(0))
    bad = ask.filter(total("meant") >= RARER * total("seen")).groupBy("before", "seen", "after").agg(F.max_by("meant", F.struct(total("meant"), "meant")).alias("meant"))
    return z.join(bad, ["before", "seen", "after"])


def rivals(groups: DataFrame, doubted: DataFrame) -> DataFrame:
    """(skeleton, form, n): the frequent forms of the groups that have several of them and a doubted word."""
    pure = F.rlike("word", F.lit(r"^[\p{L}‐-]+$"))
    forms = groups.filter(F.col("wordlike") & pure & (F.col("n") * RARER > F.col("best_n"))).select("skeleton", F.col("word").alias("form"), "n")
    several = forms.groupBy("skeleton").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("skeleton")
    return forms.join(several, "skeleton", "left_semi").join(doubted.select("skeleton").distinct(), "skeleton", "left_semi")


def bit_set(words_: DataFrame, least: int = 1 << 16) -> bytes:
    """words_(word) -> a set of bits in which three places of each word's hash are set. What the driver gets is of its size."""
    n = words_.count()
    size = max(least, min(BITS_MOST, 1 << (BITS_A_WORD * n).bit_length()))
    h = words_.select(F.xxhash64("word").alias("h"))
    at = h.select(F.explode(F.array(*[F.shiftrightunsigned("h", k).bitwiseAND(F.lit(size - 1)) for k in PLACES])).alias("at"))
    cells = at.groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS int))")).alias("bits"))
    got = cells.toPandas()
    out = np.zeros(size // 64, "i8")
    out[got["cell"].to_numpy("i8")] = got["bits"].to_numpy("i8")
    return out.astype("<i8").tobytes()


class Sieve:
    """Which words a bit set lets through; a worker asks once for a word."""

    def __init__(self, bits: bytes) -> None:
        self.bits, self.mask = bits, len(bits) * 8 - 1
        self.out: set[str] = set()
        self.through: set[str] = set()

    def __call__(self, have: set[str]) -> set[str]:
        for w in have - self.out - self.through:
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            places = [h >> k & self.mask for k in PLACES]
            (self.through if all(self.bits[p >> 3] >> (p & 7) & 1 for p in places) else self.out).add(w)
        found = have & self.through
        if len(self.out) + len(self.through) > KNOWN:
            self.out.clear()
            self.through.clear()
        return found


PLACES = (0, 18, 37)


def misread_words(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    return misread(chunks, groups, [])[0]


def misread(chunks: DataFrame, groups: DataFrame, pairs: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """((row_id, line, word, meant), (row_id, line, before, seen, after, meant)): the second pass, over words that can be doubted ones
    and Han characters that can be taken for others.

    The meant form is the most frequent of the group; where a group has several frequent forms, the one that stands most
    often beside the same words."""
    spark = chunks.sparkSession
    bad = (F.col("n") * RARER <= F.col("best_n")) & F.col("wordlike") & (F.col("word") != F.col("best"))
    doubted = cut(groups.filter(bad).select("word", "skeleton", F.col("best").alias("meant")))
    contested = cut(rivals(groups, doubted))
    sent = spark.sparkContext.broadcast((bit_set(doubted.select("word")), bit_set(contested.select(F.col("form").alias("word")))))  # BITS_MOST bits each at most
    src = spread(keep_columns(chunks, "row_id", "text").filter(F.length("text") > 0), "row_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Words that can be doubted and Han characters of a pair with what stands beside them; and how often a form that can be
        contested has a word before (line 0) or after it (line 1)."""
        odd_words, rival_words = map(Sieve, sent.value)
        asked = re.compile(f"[{''.join(sorted({c for p in pairs for c in p}))}]" if pairs else "(?!)")
        for pdf in batches:
            out: list[tuple] = []
            n: Counter = Counter()
            for i, text in zip(pdf["row_id"], pdf["text"]):
                have = set(words(text))
                out += [("han", i, k, c, x, y, 1) for k, x, c, y in neighbours(text, asked)]
                if contested_ := rival_words(have):
                    t = ["", *_WORD.findall(text.lower()), ""]
                    for k, w in enumerate(t):
                        if w in contested_:
                            n[w, 0, t[k - 1]] += 1
                            n[w, 1, t[k + 1]] += 1
                if odd := odd_words(have):
                    for k, line in enumerate(text.split("\n")):
                        if found := odd.intersection(words(line)):
                            t = ["", *_WORD.findall(line.lower()), ""]
                            for w in found:
                                at = t.index(w, 1) if w in t else 0
                                out.append(("odd", i, k, w, t[at - 1] if at else "", t[at + 1] if at else "", 0))
            out += [("rival", -1, side, w, x, None, c) for (w, side, x), c in n.items()]
            yield pd.DataFrame(out, columns=["kind", "row_id", "line", "word", "before", "after", "n"])

    both = cut(src.mapInPandas(run, "kind string, row_id long, line int, word string, before string, after string, n long"))
    seen = both.filter("kind = 'odd'").drop("kind", "n").join(doubted, "word")
    side = lambda k, c, v: both.filter((F.col("kind") == "rival") & (F.col("line") == k)).groupBy(F.col("word").alias("form"), F.col("before").alias(c)).agg(F.sum("n").alias(v))
    ask = seen.join(contested, "skeleton").select("word", "before", "after", "form", F.col("n").alias("form_n")).distinct()
    scored = ask.join(side(0, "before", "b"), ["form", "before"], "left").join(side(1, "after", "a"), ["form", "after"], "left")
    support = F.coalesce("b", F.lit(0)) + F.coalesce("a", F.lit(0))
    chosen = scored.groupBy("word", "before", "after").agg(F.max_by("form", F.struct(support, "form_n", "form")).alias("fitting"))
    return seen.join(chosen, ["word", "before", "after"], "left").select("row_id", "line", "word", F.coalesce("fitting", "meant").alias("meant")), misread_han(both, pairs)


def parted_words(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(row_id, line, noise): parted words; noise where the mark isn't part of the word."""
    p = found.filter("kind = 'parted'").select("row_id", "line", F.col("a").alias("joined"), F.col("b").alias("compound"), F.col("c").alias("mark"))
    size = groups.groupBy("skeleton").agg(F.sum("n").alias("n"))
    asked = p.select("joined", "compound").distinct()
    asked = asked.join(size.select(F.col("skeleton").alias("joined"), F.col("n").alias("j")), "joined", "left").join(size.select(F.col("skeleton").alias("compound"), F.col("n").alias("k")), "compound", "left")
    j, k = F.coalesce("j", F.lit(0)), F.coalesce("k", F.lit(0))
    noise = F.when((j == 0) & (k == 0), F.col("mark") != "-").otherwise(j >= k)
    return p.join(asked, ["joined", "compound"]).select("row_id", "line", noise.alias("noise"))


def misread_halves(found: DataFrame, groups: DataFrame, parted: DataFrame) -> DataFrame:
    """(row_id, line): words parted at a line end, not at a hyphen of their own, that are misread."""
    halves = found.filter("kind = 'halves'").select("row_id", "line", F.col("a").alias("skeleton"), F.col("b").alias("word"))
    best = groups.filter("wordlike").select("skeleton", "best", "best_n").dropna().distinct()
    own = groups.select("word", F.col("n").alias("own_n"))
    asked = halves.select("skeleton", "word").distinct().join(best, "skeleton").join(own, "word", "left")
    bad = asked.filter((F.col("word") != F.col("best")) & (F.coalesce("own_n", F.lit(0)) * RARER <= F.col("best_n"))).select("word")
    return halves.join(bad, "word", "left_semi").select("row_id", "line").join(parted.filter("noise").select("row_id", "line"), ["row_id", "line"], "left_semi")


def noise(chunks: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """The noise of every row, by kind."""
    found = cut(facts(chunks))
    groups = cut(word_groups(found))
    head = cut(headers(found, items))
    lines = head.select("row_id", "line")
    parted = cut(parted_words(found, groups))
    words_, han = misread(chunks, groups, han_pairs(found))
    return {
        "header": head,
        "folio": found.filter("kind = 'folio'").select("row_id", "line").unionByName(head.filter("numbered = 1").select("row_id", "line")).distinct(),
        "hyphen": parted,
        "halves": misread_halves(found, groups, parted),
        "word": words_.join(lines, ["row_id", "line"], "left_anti"),
        "han": han.join(lines, ["row_id", "line"], "left_anti"),
    }


def found_noise(kinds: dict[str, DataFrame]) -> DataFrame:
    """(row_id, noise_kind): one row per row and kind."""
    one = lambda d, k: d.select("row_id", F.lit(k).alias("noise_kind"))
    all_ = one(kinds["header"], "header").unionByName(one(kinds["folio"], "folio")).unionByName(one(kinds["hyphen"].filter("noise"), "hyphen"))
    return all_.unionByName(one(kinds["word"], "glyph")).unionByName(one(kinds["han"], "glyph")).unionByName(one(kinds["halves"], "glyph")).distinct()


def repaired(chunks: DataFrame, kinds: dict[str, DataFrame]) -> DataFrame:
    """(row_id, clean_text) of every row: scanned rows as paragraphs parted by a blank line, other rows as they are.

    Scanned rows are those with noise and those marked so. Lines are windows' rows here: what stands before a line decides
    whether it goes on with its paragraph, and with what between."""
    src = keep_columns(chunks, "row_id", "text", "enable_ocr")
    marked = found_noise(kinds).select("row_id").distinct().withColumn("noisy", F.lit(True))
    src = src.join(marked, "row_id", "left").withColumn("scanned", F.coalesce("noisy", F.lit(False)) | F.coalesce("enable_ocr", F.lit(False)))
    plain = src.filter(~F.col("scanned") | (F.coalesce(F.length("text"), F.lit(0)) == 0)).select("row_id", F.col("text").alias("clean_text"))
    han = F.regexp_count("text", F.lit(r"\p{IsHan}"))
    rows = src.filter(F.col("scanned") & (F.length("text") > 0)).select("row_id", "text", (han * 3 > F.length("text")).alias("han"))
    lines = rows.select("row_id", "han", F.posexplode(F.split(F.translate("text", "\f", ""), "\n")).alias("line", "s"))
    dropped = kinds["header"].select("row_id", "line").unionByName(kinds["folio"].select("row_id", "line")).distinct().withColumn("gone", F.lit(1))
    fixes = kinds["word"].select("row_id", "line", F.col("word").alias("x"), F.col("meant").alias("y")).unionByName(
        kinds["han"].select("row_id", "line", F.concat("before", "seen", "after").alias("x"), F.concat("before", "meant", "after").alias("y"))
    )
    fixes = fixes.groupBy("row_id", "line").agg(F.sort_array(F.collect_set(F.struct("x", "y"))).alias("fixes"))
    parted = kinds["hyphen"].groupBy("row_id", "line").agg(F.max("noise").alias("parted"))
    at = ["row_id", "line"]
    lines = lines.join(dropped, at, "left").join(fixes, at, "left").join(parted, at, "left")
    lines = lines.mapInPandas(_mend, "row_id long, han boolean, line int, s string, gone int, parted boolean")
    order = Window.partitionBy("row_id").orderBy("line")
    lines = lines.withColumn("gone_before", F.sum("gone").over(order)).filter((F.col("gone") == 0) & F.rlike("s", F.lit(r"\S")))
    before = lambda c: F.lag(c).over(order)
    ended = F.rlike(F.rtrim(before("s")), F.lit(r"[.。!?！？:：|…][\"'”’)）\]]*\s*$"))
    across = (F.col("gone_before") > before("gone_before")) & ~ended
    markup = r"^\s*(#|[-*•|]\s|\d+[.)]\s)"
    new = before("line").isNull() | ((F.col("line") > before("line") + 1) & ~across) | F.rlike("s", F.lit(markup)) | F.rlike(before("s"), F.lit(r"^\s*#"))
    glue = F.when(before("parted").isNotNull() | F.col("han"), "").otherwise(" ")
    lines = lines.select("row_id", "line", "s", "han", new.cast("int").alias("new"), glue.alias("glue"), F.coalesce(before("parted"), F.lit(False)).alias("after_parted"))
    lines = lines.withColumn("paragraph", F.sum("new").over(order))
    piece = F.when(F.col("han"), F.col("s")).otherwise(F.trim("s"))
    text = F.when(F.col("new") == 1, piece).otherwise(F.concat("glue", piece))
    paragraphs = lines.groupBy("row_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))).alias("ts"))
    paragraphs = paragraphs.select("row_id", "paragraph", F.trim(F.array_join(F.transform("ts", lambda x: x["t"]), "")).alias("t"))
    whole = paragraphs.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("paragraph", "t"))).alias("ts"))
    clean = whole.select("row_id", F.array_join(F.transform("ts", lambda x: x["t"]), "\n\n").alias("clean_text"))
    lost = rows.select("row_id").join(clean.select("row_id"), "row_id", "left_anti").select("row_id", F.lit("").alias("clean_text"))
    return plain.unionByName(clean).unionByName(lost)


def _mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Puts the meant forms into the lines and takes the mark of a parted word off."""
    for pdf in batches:
        out = []
        for s, fixes, parted in zip(pdf["s"], pdf["fixes"], pdf["parted"]):
            if fixes is not None:
                for f in fixes:
                    s = _replace(s, f["x"], f["y"])
            if parted is not None and parted == parted and parted:
                s = _PARTED.sub(lambda m: m[1], s)
            elif parted is not None and parted == parted:
                s = s.rstrip()
            out.append(s)
        yield pd.DataFrame({"row_id": pdf["row_id"], "han": pdf["han"], "line": pdf["line"], "s": out, "gone": pdf["gone"].fillna(0).astype(int), "parted": pdf["parted"]})


def _replace(line: str, x: str, y: str) -> str:
    if _HAN_ANY.search(x):
        return line.replace(x, y) if x in line else _loose(line, x, y)

    def cased(m: re.Match) -> str:
        w = m[0]
        return y.upper() if len(w) > 1 and w.isupper() else y[:1].upper() + y[1:] if w[:1].isupper() or w[:1].isdigit() and m.start() == 0 else y

    return re.sub(rf"(?<![^\W_]){re.escape(x)}(?![^\W_])", cased, line, flags=re.I)


def _loose(line: str, x: str, y: str) -> str:
    """A Han neighbour can stand in the line before or after, or behind a space."""
    for a, b in ((x[1:], y[1:]), (x[:-1], y[:-1])):
        if len(a) > 1 and a in line:
            return line.replace(a, b)
    i = next((k for k in (1, 0, 2) if k < len(x) and x[k] != y[k]), 1)
    return line.replace(x[i], y[i]) if line.count(x[i]) == 1 else line
