"""Checks of written notes against their sources: blocks and sentences, citations, risks of a claim, quotes found again.

Also keywords taken from a query when none are given, excerpts around a term, and typed chunks of a structured text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stacklight.functions import text as T
from stacklight.operators.textprep import sentences

# Wording that marks a risk, by kind: English words and phrases, which match whole; Han ones, which match anywhere;
# and forms with a place for a word or number.
ABSOLUTE = (
    ("cannot", "can not", "impossible", "impossibility", "never", "always", "entirely", "completely", "wholly", "fully", "totally", "absolutely", "eliminate", "eliminates", "eliminated", "eliminating",
     "elimination", "irreplaceable", "indispensable", "unique", "uniquely", "unrivalled", "unmatched", "maximize", "maximizes", "maximized", "maximizing", "maximise", "maximises", "maximised", "maximising",
     "minimize", "minimizes", "minimized", "minimizing", "minimise", "minimises", "minimised", "minimising", "ensure", "ensures", "ensured", "ensuring", "guarantee", "guarantees", "guaranteed", "overcome",
     "overcomes", "overcoming", "overcame", "solve", "solves", "solved", "prove", "proves", "proven", "proved", "definitive", "definitively", "unequivocal", "unequivocally", "conclusively", "superior", "optimal",
     "the best", "outperform", "outperforms", "outperformed", "outperforming", "preferable"),
    ("无法", "不可能", "完全消除", "彻底", "不可替代", "唯一", "保证", "确保", "必然", "总是", "从不", "最大化", "克服"), (),
)
RELATION = (
    ("orthogonal", "perpendicular", "parallel", "coincide", "coincides", "coincident", "coinciding", "normal to", "common", "shared", "identical", "equivalent", "opposite", "inverse", "inversely", "monotonic",
     "monotonically", "proportional", "independent of"),
    ("正交", "平行", "垂直", "共同", "相同", "等价", "相反", "反比", "单调"), (),
)
DIRECTION = (
    ("increase", "increases", "increased", "increasing", "decrease", "decreases", "decreased", "decreasing", "rise", "rises", "rising", "drop", "drops", "reduce", "reduces", "reduced", "reducing", "reduction",
     "enhance", "enhances", "enhanced", "enhancing", "weaken", "weakens", "weakened", "weakening", "strengthen", "strengthens", "strengthened", "strengthening", "suppress", "suppresses", "suppressed", "suppressing",
     "promote", "promotes", "promoted", "promoting", "improve", "improves", "improved", "improving", "degrade", "degrades", "degraded", "degrading", "degradation", "higher", "lower", "larger", "smaller", "greater",
     "shorter", "longer", "above", "below"),
    ("增加", "增大", "增强", "减少", "减小", "减弱", "升高", "降低", "提高", "抑制"), (),
)
NEGATION = (
    ("not", "none", "neither", "nor", "without", "free from", "fail to", "fails to", "failed to", "unable", "rather than", "instead of"),
    ("不能", "无法", "未能", "不会", "并非", "没有", "不再", "无需", "不足以", "不需要", "不使用", "不依赖", "不包含", "未采用"), (),
)
_DOUBT = (
    "may", "might", "can be a", "possible", "possibly", "possibility", "possibilities", "potential", "potentially", "perhaps", "promising", "preliminary", "attempt", "attempts", "attempted", "expect", "expects", "expected",
    "seem", "seems", "suggest", "suggests", "likely", "challenge", "challenges", "challenging", "difficult", "difficulty", "difficulties", "hard to", "bottleneck", "in principle", "not necessarily",
)
HEDGE = (
    (*_DOUBT, "could", "would", "propose", "proposes", "proposed", "proposal", "appear", "appears", "probably", "probable", "tend to", "tends to", "generally", "often", "usually", "sometimes", "typically", "normally",
     "mostly", "partial", "partially", "to some extent"),
    ("可能", "或许", "大概", "有望", "初步", "提出", "预期", "似乎", "困难", "挑战", "通常", "一般而言", "往往"), (),
)
COMMITTED = (
    (*_DOUBT, "appear to", "appears to", "proposed hypothesis", "proposed explanation", "proposed interpretation", "not a unique"),
    ("可能", "或许", "有望", "初步", "提出", "预期", "似乎", "困难", "挑战"), (),
)
CONDITION = (
    ("under", "when", "where", "provided", "as long as", "condition", "conditions", "assuming", "in the case of", "calculated", "measured"),
    ("条件", "假设", "计算得到", "测量"),
    (r"at\s+(?:an?\s+)?[\d$]", r"for\s+(?:a|an|the)\s+\w+\s+(?:specimen|sample|foil|crystal|case)\b", r"with\s+(?:a|an)\s+\w+\s+of\b"),
)
STRONG = ("absolute-language", "relation-word", "multi-chunk-fusion", "subject-not-in-cited-chunks", "hedge-dropped", "negation-dropped", "condition-dropped", "enumeration-shortened")
WEAK = ("direction-word", "quantity", "negation")
WEAK_AT_LEAST = 2
# Characters that join Han terms in a question; words that no query is about; weights of derived keywords.
HAN_GLUE = "的了是与及把被其该这那也都或吗呢且但而让所之很更最如何什么怎于我你他她它们请吧呀啊哪谁"
STOPWORDS = (
    "the", "and", "for", "with", "how", "what", "why", "does", "did", "are", "was", "were", "from", "into", "onto", "that", "this", "these", "those", "about", "during", "between", "over", "under", "its", "their",
    "can", "will", "would", "should",
)
TOKEN_WEIGHT, ALIGNED_WEIGHT, OFFSET_WEIGHT, MAX_PAIRS, MAX_KEYWORDS = 0.9, 0.3, 0.15, 8, 16


def pattern(wording: tuple) -> str:
    """One pattern of a wording, for Java and for DuckDB alike."""
    words, han, forms = wording
    return rf"(?i)\b(?:{'|'.join(w.replace(' ', r'\s+') for w in words)})\b|{'|'.join(han)}" + "".join(rf"|\b{f}" for f in forms)


def says(text: Column, wording: tuple) -> Column:
    return F.rlike(text, F.lit(pattern(wording)))


def blocks(note: str) -> list[tuple[str, str]]:
    """(kind, text) of a Markdown note: fences, comments, headings, quotes, tables, list items and prose."""
    out: list[tuple[str, str]] = []
    fence = False
    held: list[str] = []

    def close() -> None:
        if held:
            out.append(("prose", " ".join(held)))
            held.clear()

    for line in re.sub(r"<!--.*?-->", "", note, flags=re.S).split("\n"):
        s = line.strip()
        if s.startswith("```"):
            close()
            fence = not fence
        elif fence:
            out.append(("code", line))
        elif not s:
            close()
        else:
            kind = "heading" if re.match(r"#{1,6}\s", s) else "quote" if s.startswith(">") else "table" if s.startswith("|") else "item" if re.match(r"(?:[-*+]|\d{1,3}[.)])\s", s) else "prose"
            if kind == "prose":
                held.append(s)
            else:
                close()
                out.append((kind, re.sub(r"^(?:#{1,6}|>+|[-*+]|\d{1,3}[.)])\s*", "", s)))
    close()
    return out


def note_sentences(note: str) -> list[tuple[int, int, str, str]]:
    """(block, sentence, sentence text, block text) of prose and items."""
    return [(b, k, s, t) for b, (kind, t) in enumerate(blocks(note)) if kind in ("prose", "item") for k, s in enumerate(sentences(t))]


def with_citations(lines: DataFrame) -> DataFrame:
    """lines with ``cited``, the chunk ids of each sentence. A sentence without citations has its block's."""
    own = T.citations(F.col("sentence"))
    return lines.withColumn("cited", F.when(F.size(own) > 0, own).otherwise(T.citations(F.col("block_text"))))


def audit(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """lines(note, block, k, sentence, block_text), chunks(note, chunk_id, text) -> (note, block, k, risks) of the sentences worth a
    quotation: any strong risk, or two weak ones."""
    x = with_citations(lines)
    src = x.select("note", "block", "k", F.explode("cited").alias("chunk_id")).join(chunks, ["note", "chunk_id"])
    src = src.groupBy("note", "block", "k").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("source"))  # the cited chunks of one sentence
    x = x.filter(F.length("sentence") >= 12).join(src, ["note", "block", "k"], "left")
    s, o = F.col("sentence"), F.coalesce("source", F.lit(""))
    bare = F.regexp_replace(s, r"(?i)[\[(（]?\s*(?:chunks?|块|段)\s*[:：#]?\s*\d[\d\s,、-]*[\])）]?|第\s*\d+\s*[块段]", " ")
    number = F.rlike(bare, F.lit(r"\d"))
    names = F.filter(F.regexp_extract_all(bare, F.lit(r"\b[A-Z][A-Z0-9-]{2,}\b"), F.lit(0)), lambda n: ~F.contains(F.upper(o), n))
    items = lambda c: F.size(F.split(c, r"(?i),|、|，|;|；|\band\b"))
    tests = {
        "absolute-language": says(s, ABSOLUTE) & ~says(o, ABSOLUTE),
        "relation-word": says(s, RELATION),
        "multi-chunk-fusion": F.regexp_count(s, F.lit(r"(?i)\bchunks?\b|第\s*\d+\s*[块段]")) > 1,
        "subject-not-in-cited-chunks": (F.length(o) > 0) & (F.size(names) > 0),
        "hedge-dropped": says(o, COMMITTED) & ~says(s, HEDGE),
        "negation-dropped": says(o, NEGATION) & ~says(s, NEGATION) & number,
        "condition-dropped": number & says(o, CONDITION) & ~says(s, CONDITION),
        "enumeration-shortened": F.rlike(s, F.lit(r"(?i)\b(?:include|includes|including|namely|such as)\b|包括|例如")) & (F.length(o) > 0) & (items(s) + 1 < items(o)) & F.rlike(o, F.lit(r"(?i)\b(?:include|includes|including|namely|such as)\b|包括|例如")),
        "direction-word": says(s, DIRECTION),
        "quantity": number,
        "negation": says(s, NEGATION),
    }
    risks = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests.items()]), lambda r: r.isNotNull())
    strong = F.exists(risks, lambda r: r.isin(*STRONG))
    return x.withColumn("risks", risks).filter(strong | (F.size("risks") >= WEAK_AT_LEAST)).select("note", "block", "k", "risks")


def fallback_keywords(query: str) -> list[tuple[str, float, str]]:
    """(text, weight, origin) of a query without keywords: words; Han runs parted at joining characters, short ones whole and
    longer ones as pairs, the pairs at even places first."""
    whole: list[str] = []
    even: list[str] = []
    odd: list[str] = []
    for token in re.findall(r"[^\W_]+", query.lower()):
        if not re.search(f"[{T.HAN}]", token):
            if len(token) > 1 and token not in STOPWORDS:
                whole.append(token)
            continue
        for part in re.split(f"[{HAN_GLUE}]+", token):
            if part and len(part) <= 6:
                whole.append(part)
            if len(part) >= 4:
                for i in range(len(part) - 1):
                    (odd if i % 2 else even).append(part[i : i + 2])
    out: dict[str, tuple[float, str]] = {}
    for t in whole:
        out.setdefault(t, (TOKEN_WEIGHT, "token"))
    out = dict(list(out.items())[:MAX_KEYWORDS])
    pairs = 0
    for t, w in [*((t, ALIGNED_WEIGHT) for t in even), *((t, OFFSET_WEIGHT) for t in odd)]:
        if t not in out and pairs < MAX_PAIRS and len(out) < MAX_KEYWORDS:
            out[t] = (w, "ngram")
            pairs += 1
    return [(t, w, o) for t, (w, o) in out.items()] or [(query.strip(), TOKEN_WEIGHT, "token")]


def keyword_source(given: list[str] | None, query: str) -> tuple[str, list[tuple[str, float, str]]]:
    """Where keywords come from, and their entries."""
    from stacklight.operators.lexical import normalize_keywords

    own = normalize_keywords(given or [])
    return ("provided", [(k, 1.0, "provided") for k in own]) if own else ("derived", fallback_keywords(query))


def excerpt(text: Column, term: str, reach: int = 90) -> Column:
    """Text around the first hit of a term, spaces collapsed, with ellipses where it is cut."""
    s = T.squeeze(text)
    at = F.instr(F.lower(s), term.lower())
    start = F.greatest(at - reach, F.lit(1))
    part = F.substring(s, start, F.least(at - 1, F.lit(reach)) + len(term) + reach)
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(start + F.length(part) <= F.length(s), "…").otherwise("")))


_latex = ((re.compile(r"\\(?:mathrm|textrm|text|mathit|mathbf)\s*\{([^{}]*)\}"), r"\1"), (re.compile(r"\\(?:[,;:! ]|quad\b|qquad\b)|~"), " "), (re.compile(r"\$([^$]*)\$"), r"\1"))


def canonical_source(text: str) -> str:
    """LaTeX wrappers of units off, maths spacing as spaces, one space between a number and its unit, spaces collapsed."""
    for p, r in _latex:
        text = p.sub(r, text)
    text = re.sub(rf"(\d)\s*({T.UNITS.replace(chr(92) + '.', '[.]')})(?![A-Za-z])", r"\1 \2", text)
    return " ".join(text.split())


def find_quote(source: str, quote: str) -> tuple[int, int] | None:
    """(start, end) in the source of a quote that stands in it once spacing, units and case of spacing are made regular."""
    want = canonical_source(quote)
    if not want:
        return None
    if canonical_source(source).find(want) < 0:
        return None
    lo, hi = 0, len(source)
    while lo < hi:  # the shortest head of the source that still holds the quote
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if want in canonical_source(source[:mid]) else (mid + 1, hi)
    end, a, z = lo, 0, lo
    while a < z:  # and its longest cut from the front
        mid = (a + z + 1) // 2
        a, z = (mid, z) if want in canonical_source(source[mid:end]) else (a, mid - 1)
    return a, end


def mismatch(source: str, quote: str, context: int = 60, tail: int = 40) -> dict | None:
    """Where a quote leaves its source: the longest prefix found, what follows on both sides; null where it is too short."""
    from stacklight.operators.textprep import longest_prefix

    s, q = canonical_source(source), canonical_source(quote)
    n = longest_prefix(q, s)
    if n < 12 or n == len(q):
        return None
    at = s.find(q[:n]) + n
    return {"matched": q[:n][-tail:], "expected": s[at : at + context], "found": q[n : n + context]}


def structure(text: str, least: int = 50, most: int = 500, overlap: int = 50) -> list[tuple[str, str, str]]:
    """(type, title, text) units of a paper: abstract, keywords, sections or paragraphs up to its references. Neighbours of a type
    are joined while they fit; a unit above ``most`` is cut at sentences, each piece beginning with the sentence before it."""
    from stacklight.operators.sections import references_boundary
    from stacklight.operators.textprep import hard_split

    end = references_boundary(text)
    body = text[: end if end is not None else len(text)]
    units: list[tuple[str, str, str]] = []
    m = re.search(r"^(?:摘\s*要|abstract)\s*[:：]?\s*(.*?)(?=\n\s*\n|关键词|key\s*words|\Z)", body, re.I | re.S | re.M)
    start = 0
    if m and len(m[0].strip()) >= least:
        units.append(("abstract", "", m[0].strip()))
        start = m.end()
    m = re.compile(r"^(?:关键词|key\s*words)\s*[:：]\s*(.*?)(?=\n\s*\n|\Z)", re.I | re.S | re.M).search(body, start)
    if m and len(m[0].strip()) >= 20:
        units.append(("keywords", "", m[0].strip()))
        start = m.end()
    heads = [h for h in re.finditer(r"^(?:#{1,3}\s*|[一二三四五六七八九十]+[、.．]\s*|\d+(?:\.\d+)?[.．]?\s+)(\S.{1,49})$", body, re.M) if h.start() >= start]
    if heads:
        cuts = [start, *(h.start() for h in heads), len(body)]
        units += [("section" if k else "paragraph", heads[k - 1][1].strip() if k else "", body[a:z].strip()) for k, (a, z) in enumerate(zip(cuts, cuts[1:]))]
    else:
        units += [("paragraph", "", p.strip()) for p in re.split(r"\n\s*\n+", body[start:])]
    joined: list[tuple[str, str, str]] = []
    for kind, title, t in (u for u in units if u[2]):
        if joined and joined[-1][0] == kind and kind == "paragraph" and len(joined[-1][2]) + len(t) + 2 <= most:
            joined[-1] = (kind, title, f"{joined[-1][2]}\n\n{t}")
        else:
            joined.append((kind, title, t))
    out = []
    for kind, title, t in joined:
        if len(t) <= most:
            out.append((kind, title, t))
            continue
        held: list[str] = []
        for s in [p for x in sentences(t) for p in (hard_split(x, most - overlap) if len(x) > most else [x])]:
            if held and sum(map(len, held)) + len(held) + len(s) > most:
                out.append((kind, title, " ".join(held)))
                held = held[-1:] if len(held[-1]) + len(s) < most else []
            held.append(s)
        out.append((kind, title, " ".join(held)))
    return out
